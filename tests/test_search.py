import numpy as np
import pandas as pd
import pytest

from voxloom.operators import search as se


def thresholds(values, epsilon=True):
    u = sorted(set(values))
    if len(u) == 1:
        e = max(abs(u[0]) * 1e-6, 1e-9)
        return [u[0] - e, u[0] + e] if epsilon else u
    return [u[0] - (u[1] - u[0]) / 2] + [(a + b) / 2 for a, b in zip(u, u[1:])] + [u[-1] + (u[-1] - u[-2]) / 2]


def score(labels, is_bg):
    bg = labels == "BG"
    bo, eo = int((bg & is_bg).sum()), int((~bg & ~is_bg).sum())
    bw, ew = int(bg.sum()) - bo, int((~bg).sum()) - eo
    ba = bo / (bo + bw) if bo + bw else 0.0
    ea = eo / (eo + ew) if eo + ew else 0.0
    return ((ba + ea) / 2, min(ba, ea), -max(bw, ew), -(bw + ew))


def brute_single(pdf, features):
    rules = []
    for f in sorted(features):
        for thr in thresholds(pdf[f]):
            for less in (True, False):
                hit = pdf[f] < thr if less else pdf[f] > thr
                rules.append((score(pdf["label"], hit), f, thr, less))
    return rules


def best(rules):
    top = rules[0]
    for r in rules:
        if r[0] > top[0]:
            top = r
    return top


def sample(seed, n=40, flat=False):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "sample_id": np.arange(n),
        "label": np.where(rng.random(n) < 0.4, "BG", "EN"),
        "a": np.round(rng.normal(size=n), 1),
        "b": rng.integers(0, 4, n).astype(float),
        "c": np.full(n, 2.5) if flat else np.round(rng.uniform(size=n), 2),
    })
    return pdf


def spark_long(spark, pdf):
    wide = spark.createDataFrame(pdf)
    return wide, wide.unpivot(["sample_id", "label"], ["a", "b", "c"], "feature", "value")


@pytest.mark.parametrize("seed,flat", [(1, False), (2, True), (3, False)])
def test_single_top_and_pair_rules(spark, seed, flat):
    pdf = sample(seed, flat=flat)
    wide, long = spark_long(spark, pdf)
    rules = se.single_rules(long, []).cache()
    want = best(brute_single(pdf, "abc"))
    got = se.best_single_rule(rules, []).first()
    assert (got["feature"], got["bg_when_less"]) == (want[1], want[3])
    assert got["threshold"] == pytest.approx(want[2])

    top = []
    for f in "abc":
        mine = [r for r in brute_single(pdf, "abc") if r[1] == f]
        top += sorted(mine, key=lambda r: r[0], reverse=True)[:4]
    got_top = se.top_rules(rules, []).orderBy("feature", "rank").collect()
    assert [(r["feature"], round(r["threshold"], 9), r["bg_when_less"]) for r in got_top] == [
        (r[1], round(r[2], 9), r[3]) for r in top
    ]

    pairs = []
    for i, x in enumerate(top):
        for y in top[i + 1:]:
            if x[1] == y[1]:
                continue
            hx = pdf[x[1]] < x[2] if x[3] else pdf[x[1]] > x[2]
            hy = pdf[y[1]] < y[2] if y[3] else pdf[y[1]] > y[2]
            for use_and in (True, False):
                pairs.append((score(pdf["label"], hx & hy if use_and else hx | hy), x, y, use_and))
    want_pair = best(pairs)
    got_pair = se.best_pair_rule(wide, se.top_rules(rules, []), ["a", "b", "c"], []).first()
    assert (got_pair["feature_1"], got_pair["feature_2"], got_pair["use_and"]) == (
        want_pair[1][1], want_pair[2][1], want_pair[3]
    )
    assert got_pair["threshold_1"] == pytest.approx(want_pair[1][2])
    assert got_pair["balanced_accuracy"] == pytest.approx(want_pair[0][0])


def brute_two_boundary(pdf):
    cands = thresholds(pdf["value"], epsilon=False)
    top = None
    v, bg = pdf["value"].to_numpy(), (pdf["label"] == "BG").to_numpy()
    for lo in cands:
        for hi in cands:
            if lo >= hi:
                continue
            low, high = v <= lo, (v > lo) & (v >= hi)
            direct = low | high
            right = (low & bg) | (high & ~bg)
            bd, ed = (direct & bg).sum(), (direct & ~bg).sum()
            s = (
                -int((direct & ~right).sum()),
                min((right & bg).sum() / bd if bd else 1.0, (right & ~bg).sum() / ed if ed else 1.0),
                right.sum() / direct.sum() if direct.sum() else 0.0,
                direct.sum() / len(pdf),
            )
            if top is None or s > top[0]:
                top = (s, lo, hi)
    return top


def test_two_boundary_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    cases = []
    for k in range(30):
        n = int(rng.integers(2, 14))
        v = np.round(rng.normal(size=n), int(rng.integers(0, 2)))
        kind = k % 5
        label = np.where(rng.random(n) < 0.5, "BG", "EN")
        if kind == 1:  # separable
            label = np.where(v <= np.median(v), "BG", "EN")
        if kind == 2:
            label[:] = "EN"
        if kind == 3:
            label[:] = "BG"
        if kind == 4:  # the wrong way round
            label = np.where(v <= np.median(v), "EN", "BG")
        cases.append(pd.DataFrame({"k": k, "value": v, "label": label}))
    df = spark.createDataFrame(pd.concat(cases, ignore_index=True))
    got = {r["k"]: r for r in se.best_two_boundary(df, ["k"]).collect()}
    for pdf in cases:
        k, want = int(pdf["k"].iloc[0]), brute_two_boundary(pdf)
        if want is None:
            assert k not in got
            continue
        assert got[k]["bg_boundary"] == pytest.approx(want[1]), (k, want)
        assert got[k]["en_boundary"] == pytest.approx(want[2]), (k, want)
        assert got[k]["coverage"] == pytest.approx(want[0][3])


def test_neighbouring_doubles(spark):
    """The midpoint of two adjacent doubles is one of them."""
    a = 1.0
    b = float(np.nextafter(a, 2.0))
    pdf = pd.DataFrame({"label": ["BG", "EN", "BG"], "value": [a, b, b]})
    got = se.candidate_thresholds(spark.createDataFrame(pdf), []).toPandas()
    for _, r in got.iterrows():
        for name, label in (("bg", "BG"), ("en", "EN")):
            mine = pdf[pdf.label == label]["value"]
            assert r[f"{name}_le"] == (mine <= r["threshold"]).sum()
            assert r[f"{name}_lt"] == (mine < r["threshold"]).sum()


def test_fold_split(spark):
    rows = [(1, "BG", "p"), (2, "BG", "p"), (3, "EN", "p"), (4, "EN", "q"), (5, "EN", "q"), (6, "EN", "q")]
    df = spark.createDataFrame(rows, "sample_id long, label string, prompt string")
    got = {r["sample_id"]: (r["fold"], r["violation"]) for r in se.two_fold_split(df, "sample_id").collect()}
    assert got[1] == ("A", None) and got[2] == ("B", None)
    assert all(got[i] == (None, "not_two_repetitions") for i in (3, 4, 5, 6))
