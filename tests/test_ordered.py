import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators.ordered import (
    bucket_running, order_statistics, ranked_counts, split_bucket, with_halo,
)
from voxloom.operators.telemetry import interval_peaks


def skewed(n=4000, seed=1):
    """One key holds most rows and half of the values are equal."""
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n)),
        "i": np.arange(n),
        "v": np.where(rng.random(n) < 0.5, 7.0, np.round(rng.normal(size=n), 2)),
    })


def test_split_bucket_counts_points_below(spark):
    values = np.linspace(-1, 11, 97)
    for count in (0, 1, 5, 64, 65, 200):
        splits = sorted(np.random.default_rng(count).uniform(0, 10, count).tolist())
        df = spark.createDataFrame(pd.DataFrame({"v": values}))
        got = df.select("v", split_bucket(F.col("v"), splits).alias("b")).toPandas()
        want = [int(sum(s < v for s in splits)) for v in got["v"]]
        assert got["b"].tolist() == want, count


@pytest.mark.parametrize("splits", [None, [], [7.0], [-1.0, 0.0, 0.5, 7.0]])
def test_ranked_counts(spark, splits):
    pdf = skewed()
    got = ranked_counts(
        spark.createDataFrame(pdf), ["k"], "v", {"n": F.lit(1)}, splits=splits
    ).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = pdf.groupby(["k", "v"]).size().rename("n").reset_index()
    want["cum_n"] = want.groupby("k")["n"].cumsum()
    want["prev_value"] = want.groupby("k")["v"].shift(1)
    want["next_value"] = want.groupby("k")["v"].shift(-1)
    for c in ("k", "v", "n", "cum_n", "prev_value", "next_value"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float))


@pytest.mark.parametrize("parts", [2, 7, 300])
def test_order_statistics(spark, parts):
    pdf = skewed()
    got = order_statistics(
        spark.createDataFrame(pdf), ["k"], "v", linear={"p25": 0.25, "p50": 0.5, "p99": 0.99},
        upper_median="up", parts=parts,
    ).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v = np.sort(g["v"].to_numpy())
        assert got.loc[k, "n"] == len(v) and got.loc[k, "up"] == v[len(v) // 2]
        for name, f in (("p25", 25), ("p50", 50), ("p99", 99)):
            assert got.loc[k, name] == pytest.approx(np.percentile(v, f))


def test_bucket_running(spark):
    pdf = skewed(600)
    pdf["b"] = pdf["i"] // 50
    pdf["mark"] = np.where(pdf["v"] > 0.5, pdf["i"], np.nan)
    df = spark.createDataFrame(pdf).withColumn("mark", F.when(~F.isnan("mark"), F.col("mark")))
    got = bucket_running(
        df, ["k"], "b", ["i"], sums={"s": F.lit(1)}, lasts={"l": F.col("mark")}, maxes={"m": F.col("v")},
        before={"p": F.col("i")},
    ).toPandas().sort_values("i").reset_index(drop=True)
    g = pdf.groupby("k")
    np.testing.assert_array_equal(got["s"], g.cumcount() + 1)
    np.testing.assert_allclose(got["m"], g["v"].cummax())
    np.testing.assert_allclose(got["l"].astype(float), g["mark"].ffill())
    np.testing.assert_allclose(got["p"].astype(float), g["i"].shift(1))


def test_halo_copies_only_the_rows_before_a_chunk(spark):
    df = spark.range(25).withColumnRenamed("id", "i")
    got = with_halo(df, "i", 10, 3).toPandas()
    for c in (1, 2):
        halo = got[(got["chunk"] == c) & got["is_halo"]]["i"].tolist()
        assert sorted(halo) == [c * 10 - 3, c * 10 - 2, c * 10 - 1]
    assert sorted(got[~got["is_halo"]]["i"]) == list(range(25))
    with pytest.raises(ValueError):
        with_halo(df, "i", 2, 3)


def test_interval_peaks_match_a_pairwise_join(spark):
    rng = np.random.default_rng(5)
    samples = pd.DataFrame({"d": rng.integers(0, 2, 400), "at": rng.integers(0, 5000, 400), "v": rng.normal(size=400)})
    ops = pd.DataFrame({"op_id": np.arange(150), "d": rng.integers(0, 2, 150), "start_at": rng.integers(0, 5000, 150)})
    ops["end_at"] = ops["start_at"] + rng.choice([0, 1, 2, 3, 7, 8, 64, 100, 1023, 1024, 3000], 150)
    got = interval_peaks(
        spark.createDataFrame(samples), spark.createDataFrame(ops), "d", value="v"
    ).toPandas().set_index("op_id")["sample_peak"]
    for _, o in ops.iterrows():
        inside = samples[(samples.d == o.d) & (samples["at"] >= o.start_at) & (samples["at"] <= o.end_at)]["v"]
        value = got.loc[o.op_id]
        assert (np.isnan(value) and inside.empty) or value == pytest.approx(inside.max())
