import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import evaluate as va
from voxloom.operators import evidence as ev


def metrics(logits, blank=0):
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top, ids = p.max(axis=1), p.argmax(axis=1)
    speech = ids != blank
    safe = np.maximum(p, 1e-12)
    h = -(safe * np.log(safe)).sum(axis=1) / math.log(p.shape[1])
    return {
        "mean_non_blank_confidence": top[speech].mean() if speech.any() else 0.0,
        "min_non_blank_confidence": top[speech].min() if speech.any() else 0.0,
        "non_blank_entropy": h[speech].mean() if speech.any() else 1.0,
        "uncertain_non_blank_ratio": (top[speech] < 0.7).mean() if speech.any() else 1.0,
        "blank_prediction_ratio": (~speech).mean(),
        "mean_blank_probability": p[:, blank].mean(),
        "non_blank_token_rate": speech.mean(),
    }


def test_metrics_and_empty_defaults(spark):
    rng = np.random.default_rng(0)
    data = {("u", "bg"): rng.normal(size=(9, 5)) * 4, ("u", "en"): rng.normal(size=(9, 5)) * 30}
    silent = np.full((4, 5), -3.0)
    silent[:, 0] = 9.0
    data[("s", "bg")] = silent
    rows = [(u, m, i, f.tolist()) for (u, m), x in data.items() for i, f in enumerate(x)]
    df = spark.createDataFrame(rows, "utt_id string, model string, frame_idx long, logits array<double>")
    scored = ev.frame_metrics(df)
    for r in ev.utterance_metrics(scored).collect():
        for name, want in metrics(data[(r["utt_id"], r["model"])]).items():
            assert r[name] == pytest.approx(want), (r["utt_id"], name)
    paired = ev.paired_evidence(scored).collect()
    assert [r["utt_id"] for r in paired] == ["u"]
    a, b = metrics(data[("u", "bg")]), metrics(data[("u", "en")])
    assert paired[0]["entropy_delta"] == pytest.approx(a["non_blank_entropy"] - b["non_blank_entropy"])


def test_routes_at_the_boundaries(spark):
    df = spark.createDataFrame([(0.003,), (0.0031,), (0.0429,), (0.043,), (-0.117039,)], "d double")
    got = [r["r"] for r in df.select(ev.route_by_boundaries(F.col("d")).alias("r")).collect()]
    assert got == ["bg", "mixed", "mixed", "en", "bg"]


def test_nothing_routed_directly(spark):
    df = spark.createDataFrame([("BG", "mixed"), ("EN", "mixed")], "t string, r string")
    row = va.coverage_report(df, "t", "r").first()
    assert (row["direct_accuracy"], row["bg_direct_accuracy"], row["coverage"]) == (0.0, 1.0, 0.0)


def test_slices_match_integer_boundaries(spark):
    for frames in (1, 5, 16, 23):
        rows = [("u", "bg", i, [float(i % 3 == 0), 1.0 + i, 0.5]) for i in range(frames)]
        df = spark.createDataFrame(rows, "utt_id string, model string, frame_idx long, logits array<double>")
        got = {r["segment"]: r["frame_count"] for r in ev.segment_metrics(ev.frame_metrics(df)).collect()}
        bounds = np.linspace(0, frames, 17, dtype=int)
        want = {k: max(int(bounds[k + 1]), min(int(bounds[k]) + 1, frames)) - int(bounds[k]) for k in range(16)}
        assert got == want


def test_user_supplied_scorer(spark):
    import pandas as pd

    from voxloom.operators.plugins import score_frames

    def scorer(batch):
        rows = [(u, m, i, [0.0, float(i), 1.0]) for u in batch["utt_id"] for m in ("bg", "en") for i in range(3)]
        return pd.DataFrame(rows, columns=["utt_id", "model", "frame_idx", "logits"])

    frames = score_frames(spark.createDataFrame([(1,), (2,)], "utt_id long"), scorer)
    assert ev.paired_evidence(ev.frame_metrics(frames)).count() == 2
