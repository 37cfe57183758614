"""Order-dependent work without putting one key into one task.

A window over ``partitionBy(key)`` sorts a whole key in one task, which fails
when a key holds a third of the table. Everything here splits a key further
into ordered buckets, runs the window inside a bucket, and carries a small
per-bucket summary from one bucket to the next. The summary has one row per
(key, bucket), so the only window that sees a whole key sees summaries.
Rows with a null key or bucket form a group of their own, like in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.session import materialise, parallelism

_FANOUT = 64


# A join side below this many rows is broadcast; above it the join shuffles.
BROADCAST_ROWS = 200_000
# Bounds the sketch, the literals in the plan and what the driver receives.
MAX_PARTS = _FANOUT * _FANOUT


def value_profile(
    df: DataFrame, keys: Sequence[str], value: str, parts: int | None = None
) -> tuple[list[float], int]:
    """Equi-depth split points of a numeric column and the rough number of keys.

    Two mergeable sketches in one job, so the driver receives at most
    ``parts`` numbers whatever the size of the table. Both only decide how the
    work is spread; results are exact for any outcome.
    """
    parts = min(max(parts or parallelism(df.sparkSession), 2), MAX_PARTS)
    fractions = [i / parts for i in range(1, parts)]
    n_keys = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(1)
    row = df.agg(
        F.percentile_approx(F.col(value).cast("double"), fractions, 5 * parts).alias("s"),
        n_keys.alias("k"),
    ).first()
    return sorted(set(row["s"] or [])), row["k"]


def checked_broadcast(df: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A small aggregate as a join side: broadcast only if its row count allows.

    The aggregate is written once and counted; above the limit it is returned
    without a hint and the join shuffles.
    """
    stored = materialise(df, label)
    return F.broadcast(stored) if stored.count() <= limit else stored


def value_splits(df: DataFrame, value: str, parts: int | None = None) -> list[float]:
    return value_profile(df, [], value, parts)[0]


def _search_tree(value: Column, points: Sequence[float], low: int, high: int) -> Column:
    """Binary search over literal points as nested conditions."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value > points[mid], _search_tree(value, points, mid + 1, high)).otherwise(
        _search_tree(value, points, low, mid)
    )


def split_bucket(value: Column, splits: Sequence[float]) -> Column:
    """Number of split points below ``value``: monotone in the value."""
    if not splits:
        return F.lit(0)
    if len(splits) <= _FANOUT:
        return _search_tree(value, splits, 0, len(splits))
    # Many split points: pick a group of them by tree, then count inside it.
    groups = [list(splits[i:i + _FANOUT]) for i in range(0, len(splits), _FANOUT)]
    ends = [g[-1] for g in groups[:-1]]
    coarse = _search_tree(value, ends, 0, len(ends))
    table = F.array(*[F.array(*[F.lit(p) for p in g]) for g in groups])
    inside = F.size(F.filter(F.get(table, coarse), lambda s: s < value))
    return coarse * F.lit(_FANOUT) + inside


def ranked_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (keys, distinct value) with running and total sums.

    Adds, for every ``name`` in ``sums``: ``name`` (at this value),
    ``cum_name`` (values <= this one), ``total_name`` (whole key); plus the
    neighbouring distinct values ``prev_value`` / ``next_value``.
    """
    keys = list(keys)
    if splits is None:
        splits = value_splits(df, value)
    names = list(sums)
    grouped = (
        df.groupBy(*keys, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumn("_b", split_bucket(F.col(value), splits))
    )
    totals = grouped.groupBy(*keys, "_b").agg(
        *[F.sum(n).alias(f"_s_{n}") for n in names],
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = whole.orderBy("_b")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(whole).alias(f"total_{n}") for n in names],
        F.lag("_hi").over(ordered).alias("_before"),
        F.lead("_lo").over(ordered).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = grouped.select(
        "*",
        *[F.sum(n).over(running).alias(f"_l_{n}") for n in names],
        F.lag(value).over(inside).alias("_p"),
        F.lead(value).over(inside).alias("_n"),
    )
    return local.join(carry, keys + ["_b"]).select(
        *keys,
        value,
        *names,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(f"cum_{n}") for n in names],
        *[f"total_{n}" for n in names],
        F.coalesce("_p", "_before").alias("prev_value"),
        F.coalesce("_n", "_after").alias("next_value"),
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    linear: dict[str, float] | None = None,
    upper_median: str | None = None,
    parts: int | None = None,
    whole_key: dict[str, str] | None = None,
) -> DataFrame:
    """Exact quantiles per key by distributed selection.

    ``whole_key`` names outputs for 'min', 'max' and 'avg' of the key's values,
    which the bucket counters carry along.

    ``linear`` maps an output name to a fraction (linear interpolation over
    n-1); ``upper_median`` names an output holding ``sorted[n // 2]``.

    Rows are counted per (key, value bucket), which shuffles counters only.
    The counters tell which buckets hold a wanted rank, and just the rows of
    those buckets are sorted.
    """
    keys, linear = list(keys), linear or {}
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    splits, n_keys = value_profile(rows, keys, value, parts or 8 * parallelism(df.sparkSession))
    rows = rows.withColumn("_b", split_bucket(F.col(value), splits))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    whole_key = whole_key or {}
    makers = {"min": (F.min, F.min), "max": (F.max, F.max), "avg": (F.sum, F.sum)}
    counters = rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), *[makers[k][0](value).alias(f"_w_{k}") for k in whole_key]
    ).select(
        *keys,
        "_b",
        F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.col("_n"),
        F.sum("_n").over(whole).alias("total"),
        *[makers[k][1](f"_w_{k}").over(whole).alias(f"_w_{k}") for k in whole_key],
    ).withColumn("_before", F.col("_upto") - F.col("_n"))
    carried = [f"_w_{k}" for k in whole_key]

    total = F.col("total")
    ranks: dict[str, Column] = {}
    for name, fraction in linear.items():
        pos = (total - 1) * F.lit(float(fraction))
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(pos), F.ceil(pos)
    if upper_median:
        ranks[upper_median] = F.floor(total / 2)
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("_before") <= r) & (r < F.col("_upto")) for r in ranks.values()],
    )
    targets = counters.where(wanted).select(*keys, "_b", "_before", "total", *carried)
    # Every key has at most one target bucket per rank.
    if n_keys * len(ranks) <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    hits = rows.join(targets, keys + ["_b"]).groupBy(*keys, "_b", "_before", "total", value).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in carried]
    )
    inside = (
        Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = hits.withColumn("_last", F.col("_before") + F.sum("_n").over(inside) - 1)
    first, last = F.col("_last") - F.col("_n") + 1, F.col("_last")
    out = placed.groupBy(*keys).agg(
        F.max("total").alias("n"),
        *[
            F.max(F.when((first <= r) & (r <= last), F.col(value))).alias(name)
            for name, r in ranks.items()
        ],
        *[F.max(c).alias(c) for c in carried],
    )
    exprs = []
    for name, fraction in linear.items():
        pos = (F.col("n") - 1) * F.lit(float(fraction))
        weight = pos - F.floor(pos)
        exprs.append(
            F.when(F.floor(pos) == F.ceil(pos), F.col(f"_lo_{name}"))
            .otherwise(F.col(f"_lo_{name}") * (1 - weight) + F.col(f"_hi_{name}") * weight)
            .alias(name)
        )
    ends = [
        (F.col(f"_w_{k}") / F.col("n") if k == "avg" else F.col(f"_w_{k}")).alias(name) for k, name in whole_key.items()
    ]
    return out.select(*keys, "n", *exprs, *([upper_median] if upper_median else []), *ends)


def bucket_running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values along ``keys`` in bucket order.

    ``sums`` and ``maxes`` are inclusive running aggregates, ``lasts`` the last
    non-null value up to and including the row, ``before`` the last non-null
    value of an earlier row. ``bucket`` must be non-decreasing in ``order``
    inside a key. Only one summary row per bucket crosses a bucket border.
    """
    keys, order = list(keys), list(order)
    sums, lasts, maxes, before = sums or {}, lasts or {}, maxes or {}, before or {}
    carried = {**lasts, **before}
    base = df.select(
        "*",
        *[c.alias(f"_x_{n}") for n, c in {**sums, **maxes, **carried}.items()],
    )
    # A single fixed-width order column keeps the summary a hash aggregate.
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summary = base.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(f"_x_{n}").alias(f"_s_{n}") for n in maxes],
        *[
            F.max_by(F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull(), rank)).alias(f"_s_{n}")
            for n in carried
        ],
    )
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in maxes],
        *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_s_{n}") for n in carried],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    strictly = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        "*",
        *[F.sum(f"_x_{n}").over(running).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_x_{n}").over(running).alias(f"_l_{n}") for n in maxes],
        *[F.last(f"_x_{n}", ignorenulls=True).over(running).alias(f"_l_{n}") for n in lasts],
        *[F.last(f"_x_{n}", ignorenulls=True).over(strictly).alias(f"_l_{n}") for n in before],
    )
    # Null keys and null buckets keep their rows.
    other = carry.select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, bucket)], *[c for c in carry.columns if c.startswith("_s_")]
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, bucket)]
    )
    return local.join(other, same).select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.col(f"_s_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_s_{n}").alias(n) for n in maxes],
        *[F.coalesce(f"_l_{n}", f"_s_{n}").alias(n) for n in carried],
    )


def time_bucketed(df: DataFrame, ts: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with equi-depth time buckets, for ``bucket_running`` in time order.

    Calendar buckets grow with the data; these split its times evenly, so a
    busy day becomes many buckets. Rows without a time are in bucket null.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    splits = value_splits(df.select(us.alias("_us")), "_us", parts)
    return df.withColumn(name, F.when(us.isNotNull(), split_bucket(us.cast("double"), splits)))


def with_halo(
    df: DataFrame, index: str, span: int, before: int, chunk: str = "chunk"
) -> DataFrame:
    """Cut a dense index into chunks that also see the rows just before them.

    Every row lands in chunk ``index div span``; the last ``before`` rows of a
    chunk are copied into the next one with ``is_halo`` set. ``before`` must
    not exceed ``span``, so a row is copied at most once.
    """
    if before > span:
        raise ValueError("halo longer than a chunk")
    home = F.floor(F.col(index) / span).cast("long")
    near_end = F.pmod(F.col(index), F.lit(span)) >= span - before
    return (
        df.withColumn("_home", home)
        .withColumn(
            chunk,
            F.explode(
                F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
            ),
        )
        .withColumn("is_halo", F.col(chunk) != F.col("_home"))
        .drop("_home")
    )
