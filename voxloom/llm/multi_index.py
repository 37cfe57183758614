"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks, one per half of the vector, form a grid of cells.
Every vector is filed in the cell of its nearest codeword pair. A query visits
cells by the multi-sequence traversal, in order of the sum of its squared
distances to the two codewords, as many as reach the target recall, and every
vector met there is verified by its true cosine.

The number of visits is measured, not guessed: vectors of the sample are turned
by exactly the linking angle in random directions, the hardest case, and the
visits are taken so that the wanted share of them is found where the index
files them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.session import materialise
from voxloom.llm.common import LinkForest, block_grid, components

# Vectors that shape the codebooks and measure the visits.
SAMPLE = 20_000
# Vectors of a cell, about; the grid grows with the table from a smallest one.
CELL = 800
MIN_WORDS = 6
# Rows of the sample that a codeword stands for at least. From 2500 words a
# half, 5 billion distinct vectors, cells grow with the table.
PER_WORD = 8
BLOCK, CHUNK = 2048, 8192
_SLAB = 512
RECALL = 0.995


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    d = (x * x).sum(1)[:, None] - 2.0 * x @ words.T + (words * words).sum(1)[None, :]
    return np.maximum(d, 0.0)


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from a seeded choice of distinct rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    words = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, words).argmin(1)
        for i in range(len(words)):
            mine = x[own == i]
            if len(mine):
                words[i] = mine.mean(0)
    return words


def multi_sequence(first: np.ndarray, second: np.ndarray, n: int) -> list[int]:
    """The ``n`` cells with the smallest sums of one entry of each list, in order.

    A cell (i, j) of the sorted lists enters the queue when (i-1, j) and
    (i, j-1) have been visited, so n cells cost n steps whatever the grid.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    width, out, seen = len(y), [], {(0, 0)}
    queue = [(x[0] + y[0], 0, 0)]
    while queue and len(out) < n:
        _, i, j = heapq.heappop(queue)
        out.append(int(a[i]) * width + int(b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < width and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(queue, (x[p] + y[q], p, q))
    return out


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _nearest(x[:, :half], self.first), _nearest(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return np.array([multi_sequence(p, q, self.visits) for p, q in zip(a, b)], dtype=np.int32)


def build(sample: np.ndarray, total: int, threshold: float, recall: float, seed: int = 1) -> Index:
    """Codebooks from unit vectors and the visits that reach ``recall``."""
    half = sample.shape[1] // 2
    k = int(min(max(MIN_WORDS, len(sample) // PER_WORD), max(MIN_WORDS, round((total / CELL) ** 0.5))))
    index = Index(_codebook(sample[:, :half], k, seed), _codebook(sample[:, half:], k, seed + 1), 0)
    n_cells = len(index.first) * len(index.second)
    rng = np.random.default_rng(seed + 2)
    probe = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    noise = rng.normal(size=probe.shape)
    noise -= (noise * probe).sum(1, keepdims=True) * probe
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    turned = threshold * probe + (1 - threshold * threshold) ** 0.5 * noise
    # A link is found from either end; measured from one, which is the safe side.
    a, b = index.distances(probe)
    # One probe's cells at a time: the grid may have millions.
    cells = index.cells(turned).tolist()
    rank = np.empty(len(probe), np.int64)
    for i, cell in enumerate(cells):
        sums = (a[i][:, None] + b[i][None, :]).ravel()
        rank[i] = (sums <= sums[cell]).sum()
    index.visits = int(min(n_cells, max(1, np.quantile(rank, recall, method="higher"))))
    return index


def _valid(vector: str):
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``.

    Cosine in double precision; a link needs ``threshold`` or more. Null, empty
    and zero vectors, and vectors with null or non-finite components, link with
    nothing, nor do vectors without a key; vectors of different lengths never
    link. ``n_links`` counts the other rows linked directly, ``component_id``
    is the smallest key reachable by links. Rows with equal keys are vectors of
    their own, with equal or different vectors. Other columns are ignored; an
    empty table gives none.

    Equal vectors are one class with a count, so copies are never paired. Hot
    cells are dealt to grids of bounded blocks. A task returns counts and a
    spanning forest of its links, never the pairs.
    """
    spark = vectors.sparkSession
    sound = _valid("_v") & F.col(key).isNotNull()
    norm = F.sqrt(F.aggregate(F.col("_v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    # Zero after squaring is zero length for a cosine.
    rows = vectors.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").alias("_v")).withColumn(
        "_ok", F.when(sound, (norm > 0) & (norm < float("inf"))).otherwise(False)
    )
    # Classes have numbers of their own: a key may stand for several vectors.
    # Rows find their class by a 128-bit hash, so no vector is joined.
    marks = [F.xxhash64("_v").alias("_a"), F.xxhash64(F.lit(1), "_v").alias("_b")]
    classes = materialise(
        rows.where("_ok").groupBy("_v").agg(F.min(key).cast("long").alias("least"), F.count("*").alias("n"))
        .select("_v", "least", "n", *marks, F.monotonically_increasing_id().alias("id")),
        "classes",
    )
    found = [
        _found(classes.where(F.size("_v") == d), d, threshold, recall)
        for d in sorted(r[0] for r in classes.select(F.size("_v")).distinct().collect())
    ]
    if found:
        both = found[0]
        for more in found[1:]:
            both = both.unionByName(more)
        stored = materialise(both, "found")
    else:
        stored = spark.createDataFrame([], "a long, b long, n long")
    counts = stored.where("b is null").groupBy("a").agg(F.sum("n").alias("near"))
    roots = components(stored.where("b is not null"), "a", "b")
    state = (
        classes.select("id", "least", "n", "_a", "_b")
        .join(counts, classes.id == counts.a, "left")
        .join(roots, classes.id == roots.node, "left")
        .select("_a", "_b", "least", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    least = state.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = state.join(least, F.col("root") == F.col("_r")).select("_a", "_b", "n_links", "component_id")
    linked = rows.where("_ok").select(key, *marks).join(named, ["_a", "_b"]).select(key, "n_links", "component_id")
    rest = rows.where(~F.col("_ok")).select(
        key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id")
    )
    return linked.unionByName(rest).select(
        key, F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _found(classes: DataFrame, width: int, threshold: float, recall: float) -> DataFrame:
    """Counts (a, null, n) and forest edges (a, b, null) of classes of one length."""
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("_v").collect()
    sample = np.array([r["_v"] for r in picked], dtype=np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    index = build(sample, total, threshold, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b.column(0)), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array(index.cells(x).astype(np.int32)),
                    pa.array(list(index.routes(x)), pa.list_(pa.int32())),
                ],
                names=["v", "id", "n", "own", "route"],
            )

    kind = classes.schema["_v"].dataType.simpleString()
    routed = materialise(
        classes.select("_v", "id", "n").mapInArrow(route, f"v {kind}, id long, n long, own int, route array<int>"),
        "cells",
    )
    members = routed.withColumn("cell", F.col("own"))
    probes = routed.withColumn("cell", F.explode("route"))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    dealt = block_grid(members, probes, ["cell"], spread, BLOCK, CHUNK)

    def unit(t: pa.Table) -> np.ndarray:
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(t.num_rows, -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(group: pa.Table) -> pa.Table:
        role = group.column("_role").to_numpy()
        members = group.filter(pa.array(role == 0))
        probes = group.filter(pa.array(role == 1))
        m, p = unit(members), unit(probes)
        m_id, p_id = members.column("id").to_numpy(), probes.column("id").to_numpy()
        m_n, p_n = members.column("n").to_numpy(), probes.column("n").to_numpy()
        p_own = probes.column("own").to_numpy()
        route = members.column("route").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        route = route.reshape(members.num_rows, -1)
        nodes, at = np.unique(np.concatenate((m_id, p_id)), return_inverse=True)
        m_at, p_at = at[:len(m_id)], at[len(m_id):]
        near = np.zeros(len(nodes), dtype=np.int64)
        forest = LinkForest(len(nodes))
        for s in range(0, len(p), _SLAB):
            i, j = np.nonzero(p[s:s + _SLAB] @ m.T >= threshold)
            i += s
            other = p_id[i] != m_id[j]
            i, j = i[other], j[other]
            forest.link(p_at[i], m_at[j])
            # The probe counts the member. The member counts the probe only if
            # it will not meet it as a probe itself.
            np.add.at(near, p_at[i], m_n[j])
            for c in np.unique(p_own[i]).tolist():
                unmet = ~(route == c).any(1)
                mine = (p_own[i] == c) & unmet[j]
                np.add.at(near, m_at[j[mine]], p_n[i[mine]])
        a, b = forest.edges()
        hit = np.flatnonzero(near)
        return pa.table({
            "a": pa.array(np.concatenate((nodes[a], nodes[hit]))),
            "b": pa.array(np.concatenate((nodes[b], nodes[hit])), mask=np.arange(len(a) + len(hit)) >= len(a)),
            "n": pa.array(np.concatenate((np.zeros(len(a), np.int64), near[hit]))),
        })

    return dealt.groupBy("cell", "_i", "_j").applyInArrow(compare, "a long, b long, n long")
