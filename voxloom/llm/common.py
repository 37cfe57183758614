"""Shared pieces: Arrow maps, worker caches, block pairs, link forests, components."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.session import materialise, prepare

# Rows of one Arrow batch: bounds a worker's memory at this many texts.
BATCH_ROWS = 1024


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of this package: portable functions, small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def worker_cache(key: tuple, make: Callable):
    """One object per Python worker process, kept between its tasks."""
    home = sys.modules.setdefault("_voxloom_worker", types.ModuleType("_voxloom_worker"))
    store = home.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, a null as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def private(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def append_columns(df: DataFrame, text: str, fields: str, score: Callable) -> DataFrame:
    """``df`` with columns computed from its text column in Arrow batches.

    ``score(list of UTF-8 bytes) -> list of Arrow arrays`` in the order of
    ``fields`` (DDL). Only the text column is read by the function; the other
    columns ride along unchanged. A column of ``df`` named like a new one is
    replaced by it.
    """
    names = [f.split()[0] for f in fields.split(",")]
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    if text not in kept.columns:
        raise ValueError(f"{text} is a result column as well")
    at = kept.columns.index(text)
    kinds = [f.dataType.simpleString() for f in kept.schema.fields]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(kept.columns, kinds)) + ", " + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = score(text_bytes(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, schema)


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def fold_py(key) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5


# --- links -------------------------------------------------------------------


class LinkForest:
    """Components of local links, reported as one edge per linked node.

    Emitting a forest instead of the links keeps a dense group of n nodes at
    n - 1 rows: no pair list leaves a task.
    """

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def block_grid(
    members: DataFrame, probes: DataFrame, keys: Sequence[str], spread: Column, block: int, chunk: int
) -> DataFrame:
    """Rows of both sides dealt to tasks (keys, _i, _j) of bounded size.

    A key's members are split into blocks of about ``block`` rows and its
    probes into chunks of about ``chunk``; a member meets every chunk, a probe
    every block, so each (member, probe) pair of a key meets in one task and a
    hot key becomes many tasks. Counters (one row per key) are the only thing
    joined back. ``spread`` is a well-mixed non-negative long of a row.
    """
    sizes = (
        members.groupBy(*keys).agg(F.count("*").alias("_m"))
        .join(probes.groupBy(*keys).agg(F.count("*").alias("_p")), list(keys), "inner")
        .select(
            *keys,
            F.ceil(F.col("_m") / block).cast("int").alias("_ni"),
            F.ceil(F.col("_p") / chunk).cast("int").alias("_nj"),
        )
    )

    def dealt(df, own, own_n, other, other_n, role):
        return (
            df.join(sizes, list(keys))
            .withColumn(own, F.pmod(spread, F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("_ni", "_nj")
            .withColumn("_role", F.lit(role))
        )

    left = dealt(members, "_i", "_ni", "_j", "_nj", 0)
    right = dealt(probes, "_j", "_nj", "_i", "_ni", 1)
    return left.unionByName(right)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph; root is the component's smallest node.

    Every round passes the smallest known root over the links, hooks whole
    trees together and shortens paths, so rounds grow with the logarithm of
    the longest chain. Each round is a written table in the shared folder, so
    a lost executor costs one round. A hub's links sit on the many side of an
    equi-join with unique roots, which adaptive execution can split, and the
    minima are combined before they shuffle. Nodes without links are absent.
    Raises if the rounds do not settle.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(
        both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
        "links",
    )
    state = materialise(
        both.groupBy("u").agg(F.min("v").alias("v"))
        .select(F.col("u").alias("node"), F.least("u", "v").alias("root")),
        "roots",
    )
    for _ in range(max_rounds):
        seen = (
            both.join(state.select(F.col("node").alias("v"), "root"), "v")
            .groupBy("u").agg(F.min("root").alias("near"))
        )
        pushed = state.join(seen, state.node == seen.u).select(
            "node", "root", F.least("root", "near").alias("near")
        )
        hooks = pushed.groupBy("root").agg(F.min("near").alias("best"))
        hooked = pushed.join(hooks, "root").select(
            "node", F.col("root").alias("was"), F.least("near", "best").alias("mid")
        )
        # The root of the root: paths halve every round.
        up = pushed.select(F.col("node").alias("mid"), F.col("near").alias("above"))
        after = hooked.join(up, "mid", "left").select(
            "node", "was", F.least(F.col("mid"), F.coalesce("above", "mid")).alias("root")
        )
        stored = materialise(after, "roots")
        state = stored.select("node", "root")
        if stored.where("was <> root").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def split_by_bytes(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of consecutive items of about ``limit`` bytes each."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total >= limit:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end
