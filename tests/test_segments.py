from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import segments as sg
from voxloom.operators.grouped import map_sorted_groups
from voxloom.operators.phrase_machine import BlockRun, SegmentRules
from voxloom.streaming import phrases as ph
from voxloom.streaming.replay import drain

SHORT = SegmentRules(max_blocks=30, end_silence=4, pre_roll=6)


def sequential(voiced, rules):
    """The rule block by block."""
    pre, votes = deque(maxlen=rules.pre_roll), deque(maxlen=rules.window)
    active, silent, length, out = False, 0, 0, []
    for i, v in enumerate(voiced):
        if active:
            length += 1
        else:
            pre.append(i)
            votes.append(v)
            if len(votes) < rules.window or sum(votes) < rules.required:
                continue
            active, length, silent = True, len(pre), 0
            votes.clear()
        silent = 0 if v else silent + 1
        if silent >= rules.end_silence:
            out.append((i, length, "vad_end"))
        elif length >= rules.max_blocks:
            out.append((i, length, "max_duration"))
        else:
            continue
        active = False
        pre.clear()
        votes.clear()
    return out


def stretches(rng, n, p):
    v = rng.random(n) < p
    return np.where((np.arange(n) // rng.integers(5, 60)) % 2 == 0, v, rng.random(n) < 0.05)


@pytest.mark.parametrize("rules", [SegmentRules(), SHORT, SegmentRules(window=3, required=2, pre_roll=2, end_silence=3, max_blocks=9)])
def test_machine_in_chunks_equals_sequential_pass(rules):
    rng = np.random.default_rng(0)
    for trial in range(40):
        voiced = stretches(rng, int(rng.integers(1, 900)), rng.choice([0.3, 0.6, 0.97]))
        size, state, got = rules.max_blocks + int(rng.integers(0, 50)), 0, []
        for at in range(0, len(voiced), size):
            halo = max(0, at - rules.max_blocks)
            run = BlockRun(voiced[halo:at + size], at - halo, rules)
            phrases, after = run.run(state)
            exits = run.exits()
            assert (exits[0] if len(exits) == 1 else exits[state]) == after
            got += [(halo + end, length, reason) for end, length, reason in phrases]
            state = after
        assert got == sequential(voiced, rules)


def device_blocks(seed=4, sizes=(900, 35, 1, 400)):
    rng = np.random.default_rng(seed)
    parts = []
    for device, n in enumerate(sizes):
        parts.append(pd.DataFrame({
            "device_id": device, "block_idx": np.arange(n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 100, unit="ms"),
            "voiced": stretches(rng, n, 0.8), "energy": rng.random(n),
        }))
    return pd.concat(parts, ignore_index=True)


def expected(pdf, rules):
    out = []
    for device, g in pdf.groupby("device_id"):
        e = g["energy"].to_numpy()
        for end, length, reason in sequential(g["voiced"].to_numpy(), rules):
            begin = end - length + 1
            out.append((device, begin, end, reason, round(float(np.sqrt(e[begin:end + 1].mean())), 9)))
    return sorted(out)


def found(df):
    return sorted(
        (r["device_id"], r["start_idx"], r["end_idx"], r["end_reason"], round(r["rms"], 9)) for r in df.collect()
    )


@pytest.mark.parametrize("chunk,fan", [(30, 2), (30, 7), (64, 1024), (4096, 1024)])
def test_segmentation_does_not_depend_on_chunks(spark, chunk, fan):
    pdf = device_blocks()
    df = spark.createDataFrame(pdf).repartition(7)
    assert found(sg.segment_phrases(df, SHORT, chunk, fan)) == expected(pdf, SHORT)


def test_stream_equals_batch(spark, tmp_path):
    pdf = device_blocks(seed=8, sizes=(300, 90, 5))
    schema = "device_id bigint, block_idx bigint, ts timestamp, voiced boolean, energy double"
    for i, (_, part) in enumerate(pdf.groupby(pdf["block_idx"] // 70)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )
    assert found(drain(ph.segment_stream(source.withWatermark("ts", "1 day"), SHORT), "test-phrases").rows) == expected(pdf, SHORT)


def test_windows_do_not_depend_on_chunks(spark):
    pdf = device_blocks(seed=2, sizes=(260, 40))
    df = spark.createDataFrame(pdf)
    small = {(r["device_id"], r["block_idx"]): (r["votes"], r["onset"]) for r in sg.onset_votes(df, chunk=16).collect()}
    for device, g in pdf.groupby("device_id"):
        v = g["voiced"].to_numpy()
        for i in range(len(v)):
            w = v[max(0, i - 3):i + 1]
            assert small[(device, i)] == (int(w.sum()), len(w) == 4 and w.sum() >= 3)
    runs = {(r["device_id"], r["block_idx"]): r["silent_blocks"] for r in sg.silence_runs(df, chunk=16).collect()}
    for device, g in pdf.groupby("device_id"):
        run = 0
        for i, v in enumerate(g["voiced"]):
            run = 0 if v else run + 1
            assert runs[(device, i)] == run


def test_prefix_schedule(spark):
    def checks(n, energy=1.0):
        df = spark.createDataFrame([(1, i, energy) for i in range(n)], "p long, pos long, e double")
        return sorted((r["prefix"], r["is_final"], r["submitted"]) for r in sg.prefix_schedule(df, ["p"], "pos", "e").collect())

    assert checks(9) == [(9, True, True)]
    assert checks(20) == [(15, False, True), (20, False, True)]
    assert checks(22) == [(15, False, True), (20, False, True), (22, True, True)]
    assert [c[0] for c in checks(90)] == [15, 20, 25, 30, 35, 40]
    assert all(not c[2] for c in checks(20, 1e-6))


def capture(voiced, window=3, required=3, pre_roll=3, start_timeout=12, end_silence=4, max_blocks=20, post_roll=2):
    pre, votes, state, count, silent = deque(maxlen=pre_roll), deque(maxlen=window), "wait", 0, 0
    onset = None
    for i, v in enumerate(voiced):
        if state == "wait":
            pre.append(i)
            votes.append(v)
            if len(votes) == window and sum(votes) >= required:
                state, count, silent, onset = "rec", len(pre), 0, i
                continue
            if i + 1 >= start_timeout:
                return "NO_SPEECH", None, i, None
        else:
            count += 1
            silent = 0 if v else silent + 1
            if silent >= end_silence:
                return "END_SILENCE", onset, i, count - max(0, silent - post_roll)
            if count >= max_blocks:
                return "MAX_DURATION", onset, i, count - max(0, silent - post_roll)
    return "OPEN", onset, None, None


def test_energy_captures(spark):
    rng = np.random.default_rng(6)
    sessions = {s: stretches(rng, int(rng.integers(1, 60)), rng.choice([0.2, 0.7, 0.95])) for s in range(60)}
    rows = [(s, i, bool(v)) for s, vs in sessions.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s long, i long, v boolean")
    got = sg.energy_captures(df, ["s"], "i", "v", start_timeout=12, end_silence=4, max_blocks=20).collect()
    for r in got:
        assert (r["stop_reason"], r["onset_idx"], r["stop_idx"], r["kept_blocks"]) == capture(sessions[r["s"]])
    assert len(got) == 60


def test_pause_gate_resets(spark):
    rows = [(1, i, c) for i, c in enumerate([None, "pause", None, None, "resume", None, "pause", "resume", None])]
    df = spark.createDataFrame(rows, "d long, i long, c string").withColumn("b", F.floor(F.col("i") / 3))
    kept = sorted((r["i"], r["epoch"]) for r in sg.gate_pauses(df, "d", ["i"], "b", "c").collect())
    assert kept == [(0, 0), (5, 1), (8, 2)]


def test_delivery(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    phrases = [(1, i, start + timedelta(minutes=10 * i)) for i in range(8)]
    decisions = [
        (1, i, start + timedelta(minutes=10 * i, seconds=s), hit, f"heard {i}")
        for i in range(8) for s, hit in ((1, i % 2 == 0), (5, i % 2 == 0))
    ]
    p_schema, d_schema = "device_id long, phrase_id long, end_ts timestamp", (
        "device_id long, phrase_id long, ts timestamp, detected boolean, wake_text string"
    )
    spark.createDataFrame(phrases, p_schema).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame(decisions, d_schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    out = drain(
        ph.deliver_confirmed(
            spark.readStream.schema(p_schema).parquet(str(tmp_path / "p")).withWatermark("end_ts", "10 minutes"),
            spark.readStream.schema(d_schema).parquet(str(tmp_path / "d")).withWatermark("ts", "10 minutes"),
        ),
        "test-delivery",
    ).rows.collect()
    delivered = sorted(r["phrase_id"] for r in out if r["outcome"] == "delivered")
    discarded = {r["phrase_id"] for r in out if r["outcome"] == "discarded"}
    # The last ones wait for a watermark past them.
    assert {0, 2, 4} <= set(delivered) <= {0, 2, 4, 6} and len(set(delivered)) == len(delivered)
    assert discarded <= {1, 3, 5, 7} and {1, 3} <= discarded


def test_late_blocks_are_dropped_and_counted(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    schema = "device_id long, block_idx long, ts timestamp"
    rows = [(1, i, start + timedelta(minutes=10 * i)) for i in range(6)]
    # Spark drops by the watermark of the batch before, hence one batch between.
    tick = [(1, 6, start + timedelta(hours=1))]
    late = [(1, 100, start - timedelta(hours=2)), (1, 6, tick[0][2]), (1, 7, start + timedelta(hours=3))]
    for i, part in enumerate((rows, tick, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )
    done = drain(ph.drop_late(source.withWatermark("ts", "30 minutes"), ["device_id", "block_idx"]), "late")
    assert sorted(r["block_idx"] for r in done.rows.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert done.late == 1


def test_groups_stay_whole_over_a_join_on_their_keys(spark):
    # A shuffle join whose hot partition adaptive execution reads in pieces.
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).cast("long")
        rows = spark.range(0, 40_000, 1, 4).select(key.alias("k"), F.col("id").alias("i"))
        joined = rows.join(spark.range(40).select(F.col("id").alias("k")), "k")
        got = map_sorted_groups(
            joined, ["k"], ["i"], lambda g: [(int(g["k"][0]), len(g["i"]))], "k long, n long"
        ).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(k, 21_000 if k == 7 else 1000) for k in range(1, 40, 2)]
