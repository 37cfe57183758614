"""Data contracts: rows keep a list of violations, or a strict run fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def violation_list(*checks: tuple[Column, str]) -> Column:
    """Names of all broken checks, in the given order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), name) for cond, name in checks])
    )


def flag_duplicates(df: DataFrame, keys: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """Marks rows whose key occurs more than once (null-safe key).

    Keys are counted with map-side combine and only the repeated ones go on to
    the join, so a hot key costs one counted row per task.
    """
    repeated = (
        df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
        .withColumn("_rep", F.lit(True))
    )
    cond = None
    for k in keys:
        part = df[k].eqNullSafe(repeated[f"_k_{k}"])
        cond = part if cond is None else cond & part
    return df.join(repeated, cond, "left").select(
        *[df[c] for c in df.columns], F.coalesce("_rep", F.lit(False)).alias(out)
    )


def enforce(df: DataFrame, violations: str = "violations", strict: bool = False) -> DataFrame:
    """With ``strict`` the job fails on the first row that breaks a check."""
    if not strict:
        return df
    message = F.concat(F.lit("contract broken: "), F.array_join(violations, ","))
    return df.withColumn(
        violations,
        F.when(F.size(violations) == 0, F.col(violations)).otherwise(
            F.raise_error(message).cast("array<string>")
        ),
    )


def validate_manifest(
    df: DataFrame, filename: str, label: str, text: str, labels: Sequence[str] = ("BG", "EN")
) -> DataFrame:
    """Manifest rows with all violations: names present and unique, known labels, text."""
    named = df.withColumn("_name", F.trim(F.coalesce(F.col(filename), F.lit(""))))
    flagged = flag_duplicates(named, ["_name"], "_dup")
    name = F.col("_name")
    return flagged.withColumn(
        "violations",
        violation_list(
            (name == "", "missing_filename"),
            (F.col("_dup") & (name != ""), "duplicate_filename"),
            (~F.coalesce(F.upper(F.trim(F.col(label))).isin(*labels), F.lit(False)), "invalid_label"),
            (F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "missing_text"),
        ),
    ).drop("_name", "_dup")


def balance_check(df: DataFrame, label: str, expected: dict[str, int]) -> DataFrame:
    """Observed class sizes against expected ones; unknown classes are listed too."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "want_label string, expected bigint")
    got = df.groupBy(F.col(label).alias("got_label")).agg(F.count("*").alias("observed"))
    return want.join(got, F.col("want_label") == F.col("got_label"), "full").select(
        F.coalesce("want_label", "got_label").alias("label"),
        F.coalesce("expected", F.lit(0)).cast("long").alias("expected"),
        F.coalesce("observed", F.lit(0)).alias("observed"),
    ).withColumn(
        "violation",
        F.when(F.col("expected") == 0, "unexpected_label").when(
            F.col("expected") != F.col("observed"), "wrong_count"
        ),
    )


def capture_quality(
    duration: Column, rms: Column, min_s: float = 1.5, max_s: float = 8.0, min_rms: float = 0.008
) -> Column:
    """All reasons a capture is rejected for, empty when it is accepted."""
    return violation_list(
        (duration < min_s, "too_short"), (duration > max_s, "too_long"), (rms < min_rms, "too_quiet")
    )
