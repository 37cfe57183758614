"""Latency, memory and detector summaries over telemetry rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.arrays import percent
from voxloom.operators.ordered import bucket_running, order_statistics, split_bucket, value_splits
from voxloom.session import materialise

# Block sizes 1, 16, ... 16^8: enough for 2^36 samples of a key.
LEVELS = 9


def phase_latency(df: DataFrame, phase: str, seconds: str) -> DataFrame:
    """n, upper median (``sorted[n // 2]``) and maximum per phase."""
    return order_statistics(
        df, [phase], seconds, upper_median="median_seconds", whole_key={"max": "max_seconds"}
    )


def detector_summary(df: DataFrame, positive: Column, delivered: Column, delay: Column) -> DataFrame:
    """Detected, false accepts, and upper median / maximum delay of the hits."""
    rows = df.select(positive.alias("pos"), delivered.alias("hit"), delay.alias("delay"))
    counts = rows.agg(
        F.count_if(F.col("pos") & F.col("hit")).alias("detected"),
        F.count_if("pos").alias("positives"),
        F.count_if(~F.col("pos") & F.col("hit")).alias("false_accepts"),
        F.count_if(~F.col("pos")).alias("negatives"),
        F.max(F.when(F.col("pos") & F.col("hit"), F.col("delay"))).alias("delay_max"),
    )
    median = order_statistics(
        rows.where("pos AND hit").withColumn("_k", F.lit(0)), ["_k"], "delay", upper_median="delay_median"
    ).select("delay_median")
    # Both sides are global aggregates: one row each.
    return counts.join(F.broadcast(median), F.lit(True), "left")


def headroom(df: DataFrame, used: str, total: str, need: float) -> DataFrame:
    """Free memory, usage percent and whether a step must be skipped."""
    free = F.col(total) - F.col(used)
    return df.withColumn("free_mb", free).withColumn(
        "used_percent", percent(F.col(used), F.col(total))
    ).withColumn("skip", F.col("free_mb") < need)


def interval_peaks(
    samples: DataFrame,
    ops: DataFrame,
    key: str,
    at: str = "at",
    value: str = "value",
    op_id: str = "op_id",
    start: str = "start_at",
    end: str = "end_at",
) -> DataFrame:
    """Largest sample per operation interval, without joining samples to operations.

    Samples are numbered in time order per key, and an operation becomes a
    range of numbers. Maxima of aligned blocks of 16, 256, ... numbers add a
    fifteenth to the samples; a range is a few dozen whole blocks and single
    samples, found by equality. Overlapping operations and dense samples cost
    their sum, never their product, and no key is sorted in one task.
    Operations without a sample have a null peak; rows with a null key are absent.
    """
    kind = dict(ops.dtypes)[op_id]
    none = F.lit(None)
    lines = samples.select(
        F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(1).alias("_tie"),
        F.col(value).alias("_v"), none.cast(kind).alias("_op"), F.lit(1).alias("_one"),
    ).unionByName(
        ops.select(
            F.col(key).alias("_key"), F.col(op_id).alias("_op"),
            # A start comes before the samples of its time, an end after them.
            F.explode(F.array(
                F.struct(F.col(start).alias("_t"), F.lit(0).alias("_tie")),
                F.struct(F.col(end).alias("_t"), F.lit(2).alias("_tie")),
            )).alias("m"),
        ).select(
            "_key", "m._t", "m._tie", none.cast(dict(samples.dtypes)[value]).alias("_v"), "_op", F.lit(0).alias("_one"),
        )
    ).where("_key IS NOT NULL AND _t IS NOT NULL")
    splits = value_splits(samples.select(F.col(at).alias("_t")), "_t")
    placed = lines.withColumn("_b", split_bucket(F.col("_t").cast("double"), splits))
    seen = materialise(
        bucket_running(placed, ["_key"], "_b", ["_t", "_tie"], sums={"_n": F.col("_one")}).select(
            "_key", "_tie", "_v", "_op", "_n"
        ),
        "numbered",
    )
    single = seen.where("_tie = 1").select("_key", F.lit(0).alias("_level"), (F.col("_n") - 1).alias("_at"), F.col("_v").alias("_peak"))
    first = single.groupBy("_key", F.shiftright("_at", 4).alias("_at")).agg(F.max("_peak").alias("_peak"))
    above = first.select(
        "_key", "_peak", F.explode(F.array(*[
            F.struct(F.lit(level).alias("_level"), F.shiftright("_at", 4 * (level - 1)).alias("_at")) for level in range(1, LEVELS)
        ])).alias("b"),
    ).groupBy("_key", "b._level", "b._at").agg(F.max("_peak").alias("_peak"))
    blocks = single.unionByName(above.select("_key", "_level", "_at", "_peak"))

    ranges = seen.where("_tie <> 1").groupBy("_key", "_op").agg(
        F.max(F.when(F.col("_tie") == 0, F.col("_n"))).alias("_lo"), F.max(F.when(F.col("_tie") == 2, F.col("_n"))).alias("_hi")
    )
    empty = F.array().cast("array<struct<_level:int,_at:bigint>>")

    def numbers(low: Column, high: Column, level: int) -> Column:
        """Blocks low..high-1 of a level."""
        return F.when(
            low < high,
            F.transform(F.sequence(low, high - 1), lambda i: F.struct(F.lit(level).alias("_level"), i.cast("long").alias("_at"))),
        ).otherwise(empty)

    parts = ranges
    for level in range(LEVELS):
        low, high = F.col("_lo"), F.col("_hi")
        up, down = F.shiftright(low + 15, 4), F.shiftright(high, 4)
        inner = up < down
        last = level == LEVELS - 1
        edges = numbers(low, high, level) if last else F.when(
            inner, F.concat(numbers(low, up * 16, level), numbers(down * 16, high, level))
        ).otherwise(numbers(low, high, level))
        parts = parts.withColumn(f"_p{level}", edges).withColumns({
            "_lo": F.when(inner, up).otherwise(0).cast("long"), "_hi": F.when(inner, down).otherwise(0).cast("long"),
        })
    wanted = parts.select("_key", "_op", F.explode_outer(F.concat(*[f"_p{level}" for level in range(LEVELS)])).alias("b")).select(
        "_key", "_op", "b._level", "b._at"
    )
    return wanted.join(blocks, ["_key", "_level", "_at"], "left").groupBy(F.col("_op").alias(op_id)).agg(
        F.max("_peak").alias("sample_peak")
    )


def operation_peaks(samples: DataFrame, ops: DataFrame, key: str, before: str, after: str, op_id: str = "op_id") -> DataFrame:
    """Peak of the readings before, after and during each operation."""
    inside = interval_peaks(samples, ops, key, op_id=op_id)
    return ops.join(inside, op_id, "left").withColumn(
        "observed_peak", F.greatest(before, after, "sample_peak")
    )


def stage_breakdown(spans: DataFrame, request: str, stage: str, seconds: str, stages: Sequence[str]) -> DataFrame:
    """Seconds per stage and in total, one row per request."""
    return spans.groupBy(request).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(seconds))), F.lit(0.0)).alias(f"{s}_s")
            for s in stages
        ],
        F.sum(seconds).alias("total_s"),
    )


def cold_warm(runs: DataFrame, subject: str, order: Sequence[str], bucket: str, seconds: str, used: str) -> DataFrame:
    """Cold load, first and second warm run and reload per subject, with memory deltas.

    The first four runs of a subject by order; numbering carries counts across
    buckets instead of sorting a subject in one task.
    """
    numbered = bucket_running(runs, [subject], bucket, order, sums={"_n": F.lit(1)}).where("_n <= 4")

    def nth(n: int, column: str) -> Column:
        return F.max(F.when(F.col("_n") == n, F.col(column)))

    names = ("cold", "first", "second", "reload")
    return numbered.groupBy(subject).agg(
        *[nth(i, seconds).alias(f"{name}_s") for i, name in enumerate(names, 1)],
        nth(1, used).alias("baseline_mb"),
        *[(nth(i, used) - nth(1, used)).alias(f"{name}_delta_mb") for i, name in enumerate(names, 1) if i > 1],
    )


def repeat_spread(runs: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str) -> DataFrame:
    """How far repeated runs of one input differ."""
    rank = F.struct(*order)
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.min_by(seconds, rank).alias("first_s"),
        F.max_by(seconds, rank).alias("last_s"),
        (F.max(seconds) - F.min(seconds)).alias("spread_s"),
    ).where("runs > 1")


def window_peaks(samples: DataFrame, ts: str, keys: Sequence[str], value: str, width: str) -> DataFrame:
    """Peak reading per tumbling window; works on batch and streaming rows."""
    return samples.groupBy(F.window(ts, width).alias("_w"), *keys).agg(
        F.max(value).alias("peak"), F.count("*").alias("n")
    ).select(F.col("_w.start").alias("window_start"), *keys, "peak", "n")


def late_rows(rows: DataFrame, keys: Sequence[str], bucket: str, arrival: Sequence[str], ts: str, delay_s: int) -> DataFrame:
    """Rows that arrive more than ``delay_s`` behind the newest time seen before."""
    seen = bucket_running(rows, keys, bucket, arrival, maxes={"_newest": F.col(ts)})
    return seen.withColumn("late", F.col(ts) < F.col("_newest") - F.make_interval(secs=F.lit(delay_s))).drop("_newest")
