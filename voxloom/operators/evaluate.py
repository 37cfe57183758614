"""Evaluation reports: accuracy, coverage, word error, throughput, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import wer_words, with_word_distance
from voxloom.operators.ordered import order_statistics


def confusion_counts(df: DataFrame, truth: str, pred: str, labels: Sequence[str] = ("BG", "EN")) -> DataFrame:
    """Right and wrong counts per class in one row, and rows of no known class."""
    t, p = F.col(truth), F.col(pred)
    aggs = []
    for label in labels:
        aggs += [
            F.count_if((t == label) & (p == label)).alias(f"{label.lower()}_ok"),
            F.count_if((t == label) & ~p.eqNullSafe(label)).alias(
                f"{label.lower()}_wrong"
            ),
        ]
    aggs.append(F.count_if(~F.coalesce(t.isin(*labels), F.lit(False))).alias("unexpected"))
    return df.agg(*aggs)


def accuracy_rollup(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Correct, total and accuracy overall (label null) and per class."""
    hit = F.col(truth).eqNullSafe(F.col(pred))
    return (
        df.rollup(truth)
        .agg(F.count_if(hit).alias("correct"), F.count("*").alias("total"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def coverage_report(df: DataFrame, truth: str, route: str, keys: Sequence[str] = ()) -> DataFrame:
    """Three-way routing result: direct, correct, wrong, mixed; whole and per class.

    With nothing routed directly the overall accuracy is 0 while a class
    accuracy is 1: an unrouted class was never misrouted.
    """
    t, r = F.upper(F.col(truth)), F.upper(F.col(route))
    direct, correct = r != "MIXED", t == r
    aggs = [
        F.count("*").alias("total"),
        F.count_if(direct).alias("direct_total"),
        F.count_if(direct & correct).alias("direct_correct"),
        F.count_if(direct & ~correct).alias("direct_wrong"),
        F.count_if(~direct).alias("mixed"),
    ]
    for label in ("BG", "EN"):
        name, here = label.lower(), t == label
        aggs += [
            F.count_if(here & direct).alias(f"{name}_direct"),
            F.count_if(here & direct & correct).alias(f"{name}_correct"),
            F.count_if(here & direct & ~correct).alias(f"{name}_wrong"),
            F.count_if(here & ~direct).alias(f"{name}_mixed"),
        ]

    def ratio(a: str, b: str, empty: float) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(empty))

    return df.groupBy(*keys).agg(*aggs).select(
        "*",
        ratio("direct_total", "total", 0.0).alias("coverage"),
        ratio("direct_correct", "direct_total", 0.0).alias("direct_accuracy"),
        ratio("bg_correct", "bg_direct", 1.0).alias("bg_direct_accuracy"),
        ratio("en_correct", "en_direct", 1.0).alias("en_direct_accuracy"),
    )


def route_crosstab(df: DataFrame, track: str, route: str, routes: Sequence[str]) -> DataFrame:
    """Routes per track; mixed tracks are counted but never scored."""
    counts = df.groupBy(track).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(route) == r).alias(f"n_{r.lower()}") for r in routes],
        F.count_if(F.col(route) == F.col(track)).alias("_hits"),
    )
    return counts.withColumn(
        "accuracy", F.when(F.col(track) != "MIXED", F.col("_hits") / F.col("total"))
    ).drop("_hits")


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, quartiles, max and mean per key; quartiles are exact."""
    return order_statistics(
        df, keys, value, linear={"p25": 0.25, "median": 0.5, "p75": 0.75},
        whole_key={"min": "min_value", "max": "max_value", "avg": "mean_value"},
    )


def class_separation(df: DataFrame, label: str, value: str, low: str = "BG", high: str = "EN") -> DataFrame:
    """Gap and midpoint between two classes, or the span of their overlap."""
    lo_max, hi_min = F.col("low_max"), F.col("high_min")
    clean = lo_max < hi_min
    return df.agg(
        F.max(F.when(F.col(label) == low, F.col(value))).alias("low_max"),
        F.min(F.when(F.col(label) == high, F.col(value))).alias("high_min"),
    ).select(
        "low_max",
        "high_min",
        clean.alias("separated"),
        F.when(clean, hi_min - lo_max).alias("gap"),
        F.when(clean, (lo_max + hi_min) / 2.0).alias("midpoint"),
        F.when(~clean, lo_max - hi_min).alias("overlap"),
    )


def feature_ranking(long: DataFrame, low: str = "BG", high: str = "EN") -> DataFrame:
    """Difference of class medians over the pooled deviation, per feature.

    ``long`` has (feature, label, value).
    """
    medians = order_statistics(long, ["feature", "label"], "value", linear={"median": 0.5})
    pooled = long.where(F.col("label").isin(low, high)).groupBy("feature").agg(
        F.stddev_pop("value").alias("sigma")
    )
    both = medians.groupBy("feature").agg(
        F.max(F.when(F.col("label") == low, F.col("median"))).alias("low_median"),
        F.max(F.when(F.col("label") == high, F.col("median"))).alias("high_median"),
    )
    return both.join(pooled, "feature").select(
        "feature",
        "low_median",
        "high_median",
        (F.col("low_median") - F.col("high_median")).alias("difference"),
        F.when(
            F.col("sigma") > 0, F.abs(F.col("low_median") - F.col("high_median")) / F.col("sigma")
        ).otherwise(F.lit(0.0)).alias("score"),
    )


def throughput(df: DataFrame, mode: str, processing: Column, audio: Column) -> DataFrame:
    """Totals, mean time and real-time factor per mode and combined (mode null)."""
    return (
        df.select(mode, processing.alias("p"), audio.alias("a"))
        .rollup(mode)
        .agg(F.count("*").alias("n"), F.sum("p").alias("processing_total"), F.sum("a").alias("audio_total"))
        .withColumn("processing_avg", F.col("processing_total") / F.col("n"))
        .withColumn("rtf", F.try_divide(F.col("processing_total"), F.col("audio_total")))
    )


def throughput_by_category(df: DataFrame, category: str, processing: Column, audio: Column) -> DataFrame:
    """Per-category totals; a row or category without audio has factor 0."""

    def guarded(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return (
        df.select(category, processing.alias("p"), audio.alias("a"))
        .withColumn("row_rtf", guarded(F.col("p"), F.col("a")))
        .groupBy(category)
        .agg(
            F.count("*").alias("n"),
            F.sum("p").alias("processing_total"),
            F.sum("a").alias("audio_total"),
            F.avg("row_rtf").alias("mean_row_rtf"),
            F.count_if(F.col("a") <= 0).alias("no_audio"),
        )
        .withColumn("rtf", guarded(F.col("processing_total"), F.col("audio_total")))
    )


def score_words(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds errors, reference_words, wer and status to (reference, hypothesis) rows.

    Whole texts are scored. An empty reference is an error row, not a zero.
    """
    worded = (
        pairs.withColumn("_r", wer_words(F.col(reference)))
        .withColumn("_h", wer_words(F.col(hypothesis)))
        .withColumn("reference_words", F.size("_r").cast("long"))
    )
    return (
        with_word_distance(worded, "_r", "_h", "_distance")
        .withColumn("errors", F.when(F.col("reference_words") > 0, F.col("_distance")))
        .withColumn("wer", F.try_divide(F.col("errors"), F.col("reference_words")))
        .withColumn("status", F.when(F.col("reference_words") > 0, "ok").otherwise("empty_reference"))
        .drop("_r", "_h", "_distance")
    )


def word_error_report(scored: DataFrame, group: str) -> DataFrame:
    """Corpus and macro word error, exact matches and maximum, per group and overall."""
    return (
        scored.where(F.col("status") == "ok")
        .rollup(group)
        .agg(
            F.count("*").alias("n"),
            F.sum("errors").alias("errors"),
            F.sum("reference_words").alias("reference_words"),
            F.avg("wer").alias("macro_wer"),
            F.max("wer").alias("max_wer"),
            F.count_if(F.col("errors") == 0).alias("exact"),
        )
        .withColumn("corpus_wer", F.col("errors") / F.col("reference_words"))
    )


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """A mergeable quantile sketch per key: kilobytes whatever the number of rows.

    With ``k`` of 400 the rank of an estimate is off by less than 1 % of the
    rows with high confidence. Stored sketches answer for any span of keys.
    """
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketched_summary(sketches: DataFrame, keys: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """``n`` and approximate quantiles per key from stored sketches alone."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(
        *keys, F.kll_sketch_get_n_double("_s").alias("n"),
        *[F.kll_sketch_get_quantile_double("_s", F.lit(f)).alias(name) for name, f in fractions.items()],
    )
