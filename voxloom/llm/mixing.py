"""Mixing sources to target weights by capped water-filling.

A budget is shared by weight; a source whose share exceeds its cap (a maximum
number of epochs over its own size) is clamped there and the excess goes to
the others by weight, until no source is above its cap. Whole repetitions are
taken of every document, the fractional one from a seeded order of the
documents until the source's target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.session import materialise
from voxloom.llm.common import private

# Hash buckets of a source, over which running sums are taken first.
_HEX = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and \\t \\n \\v \\f \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, source: str, cycle: tuple = (5, 2, 1)) -> DataFrame:
    """Weights by the sources' order (code points, null last), repeating ``cycle``.

    Ranks come from per-bucket counts of a range-sorted table, so no task
    orders all sources.
    """
    spread = sources.select(source).repartitionByRange(F.col(source).isNull(), F.col(source))
    held = materialise(
        spread.select(source, F.spark_partition_id().alias("_p")), "sources"
    )
    counts = held.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row per range partition: bounded by the number of partitions.
    before = counts.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_p", "_before")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(source).asc_nulls_last()))
    rank = F.col("_before") + inside - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int")
    )
    return held.join(before, "_p").withColumn("weight", weight).select(source, "weight")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``.

    Each round is one aggregate with a one-row result: the level at which the
    sources below their caps share what the clamped ones leave. A source once
    clamped stays so, therefore rounds end; rows stay distributed throughout.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    budget = share * (sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, clamped = None, -1
    while True:
        is_clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(is_clamped, 1).otherwise(0)).alias("clamped"),
            F.sum(F.when(is_clamped, F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(is_clamped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["clamped"] == clamped or not row["weight"]:
            break
        clamped = row["clamped"]
        level = (budget - row["full"] * epochs) / row["weight"]
    level = 0.0 if level is None else level
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    epochs: float = 2.0,
    cycle: tuple = (5, 2, 1),
    seed: int = 7,
) -> DataFrame:
    """How many words the mix takes of every document.

    Columns: the key, ``size`` (words), ``source_size``, ``target`` (the
    source's), ``taken`` (words taken, repeats counted; at most
    ``epochs * size``). A null text has size 0 and takes 0; null sources are
    one source, last in order; rows with equal keys are taken one by one in
    order of size; an empty table gives no rows. Other columns are ignored.

    A source's documents are put in the order of a seeded hash of their key.
    The words before a document in that order are known from sums per hash
    bucket (a window over at most 4096 counters of a source) and, only in the
    one bucket where the target falls, from the documents before it: a source
    with a third of all rows is never sorted in one task.
    """
    name = private(docs, "source")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    sized = materialise(
        docs.select(
            F.col(f"`{key}`").alias(key),
            F.col(f"`{source}`").alias(name),
            word_count(F.col(f"`{text}`")).alias("size"),
            order.alias("_order"),
        ).withColumn("_bucket", F.substring("_order", 1, _HEX)),
        "sizes",
    )
    buckets = materialise(
        sized.groupBy(name, "_bucket").agg(F.sum("size").alias("_words")), "buckets"
    )
    sizes = buckets.groupBy(name).agg(F.sum("_words").alias("source_size"))
    weights = cycled_weights(sizes, name, cycle)
    sources = materialise(
        sizes.join(weights, sizes[name].eqNullSafe(weights[name])).drop(weights[name]), "sources"
    )
    filled = water_fill(sources, share, epochs)
    # Repetitions: whole ones for all, the rest in hash order up to the target.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = (
        filled.withColumn("_whole", whole.cast("long"))
        .withColumn("_rest", F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))
        .select(name, "source_size", "target", "_whole", "_rest")
    )
    run = Window.partitionBy(name).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        buckets.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
        .join(filled.withColumnRenamed(name, "_s"), F.col(name).eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_left", F.col("_rest") - F.col("_before"))
        .withColumn(
            "_state",
            F.when(F.col("_left") >= F.col("_words"), 2).when(F.col("_left") > 0, 1).otherwise(0),
        )
        .select(
            F.col(name).alias("_s"), F.col("_bucket").alias("_b"),
            "source_size", "target", "_whole", "_left", "_state",
        )
    )
    rows = sized.join(marked, F.col(name).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    # Only a source's one split bucket is ordered row by row.
    running = (
        Window.partitionBy(name, "_bucket")
        .orderBy("_order", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    split = (
        rows.where("_state = 1")
        .withColumn("_ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_ahead"))))
        .drop("_ahead")
    )
    flat = rows.where("_state <> 1").withColumn("_extra", F.when(F.col("_state") == 2, F.col("size")).otherwise(0))
    return flat.unionByName(split).select(
        key, "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )


def repeat_rows(docs: DataFrame, taken: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` repeated as the mix takes them.

    A row comes once for each whole repetition of its words; of the one
    document per source that the target cuts, the last repetition keeps the
    words taken, joined by blanks. Rows that take nothing go. A document without words stays
    once: it costs nothing. Repeated keys are paired in order of their size.
    """
    n, t, o = private(docs, "size"), private(docs, "taken"), private(docs, "copy")
    rank, k, words_, place = (private(docs, x) for x in ("rank", "mixed_key", "mixed_size", "place"))
    left = docs.withColumn(n, word_count(F.col(f"`{text}`")))
    left = left.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(n)))
    right = taken.select(
        F.col(key).alias(k), F.col("size").alias(words_), F.col("taken").alias(t)
    ).withColumn(place, F.row_number().over(Window.partitionBy(k).orderBy(words_, t)))
    joined = left.join(right, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(rank) == F.col(place)))
    times = F.when(F.col(n) == 0, 1).otherwise(F.ceil(F.col(t) / F.col(n))).cast("int")
    rest = F.col(t) - F.col(n) * F.col(o)
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, rest.cast("int")), " ")
    return (
        joined.where(times > 0)
        .withColumn(o, F.explode(F.sequence(F.lit(0), times - 1)))
        .withColumn(text, F.when((F.col(n) > 0) & (rest < F.col(n)), cut).otherwise(F.col(f"`{text}`")))
        .select([F.col(f"`{c}`") for c in docs.columns])
    )
