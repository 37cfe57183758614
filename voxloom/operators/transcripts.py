"""Transcript rows: segment joining and choosing a run by route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import SPACE_CLASS


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}|{SPACE_CLASS}$", "")


def join_segments(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Trimmed non-blank segments of one transcript, joined in order."""
    trimmed = df.withColumn("_t", strip_space(F.col(text)))
    return trimmed.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct(order, "_t")))),
                lambda s: s["_t"],
            ),
            " ",
        ).alias(text)
    )


def select_by_route(
    runs: DataFrame, key: str, mode: str, route: str, columns: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Of several runs per key, the values of the run whose mode is the route.

    ``route`` is a column every run of a key carries; a key without the
    matching run keeps nulls. Values are those of one whole run: of several
    with that mode the first by ``order`` (else by the values), flagged as
    ``duplicate_run``.
    """
    hit = F.coalesce(F.col(mode) == F.col(route), F.lit(False))
    rank = [*order, *[c for c in columns if c not in order]]
    return runs.groupBy(key).agg(
        F.min(route).alias(route),
        F.min(F.when(hit, F.struct(*rank))).alias("_row"),
        (F.count_if(hit) > 1).alias("duplicate_run"),
    ).select(key, route, *[F.col(f"_row.{c}").alias(c) for c in columns], "duplicate_run")
