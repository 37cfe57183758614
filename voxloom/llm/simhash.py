"""Near-duplicates by SimHash fingerprints, paired exactly with vantage-point trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree to within
``radius // 4`` bits in one of their four quarters. Every quarter has its own
vantage-point tree: a node holds a vantage value and a median Hamming distance,
near values go left, others right. By the triangle bound a value whose distance
is within the quarter's radius of the median may have partners on either side,
so it visits both; all others take one branch. A leaf is a shard; a fingerprint
lives in one shard per quarter and visits those its ball overlaps. In a shard,
whole fingerprints are compared, so the links are exact.

One tree over whole fingerprints would be right as well, but distances of 64
random bits lie so close together (32 +- 4) that a radius of 4 prunes next to
nothing; on a quarter a radius of 1 prunes most branches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.session import materialise
from voxloom.llm.common import LinkForest, block_grid, components, private, text_bytes

QUARTERS = 4
RADIUS = 4
SHINGLE = 4
# Fingerprints that shape the trees; shards hold about LEAF of them until
# every value of a quarter is a shard of its own.
SAMPLE = 16_384
LEAF = 1024
VALUES = 1 << 16
# A shard's pairs are compared in grids of these many members by probes.
BLOCK, CHUNK = 4096, 16_384
_SLAB = 256
# Shingles hashed together: bounds the memory a very long text takes.
_RUN = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of one text as a signed number."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    lows, highs = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _RUN):
        run = [digest(joined[a:b], 42) for a, b in zip(lows[at:at + _RUN], highs[at:at + _RUN])]
        bits = np.unpackbits(np.array(run, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(counts * 2 > n, bitorder="little")
    return int(over.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row: a map over the scan. A null text has no words."""
    kind = docs.schema[key].dataType.simpleString()
    name = private(docs, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=[key, "fp"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias(name))
    return rows.mapInArrow(run, f"`{key}` {kind}, fp long")


class VantageTree:
    """A vantage-point tree over 16-bit values; leaves are numbered as they are grown.

    It is grown over all values there are, each weighed by its share of the
    sample, so it can be as fine as the table needs.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        # node: (vantage, limit, left, right) with children >= 0, or -1 - leaf.
        self.nodes: list[list[int]] = []
        self.leaves = 0
        values = np.arange(VALUES, dtype=np.uint16)
        weights = np.bincount(sample, minlength=VALUES) * (VALUES / max(1, len(sample))) + 0.1
        self.root = self._grow(values, weights, leaves, rng)

    def _grow(self, values: np.ndarray, weights: np.ndarray, leaves: int, rng) -> int:
        best = None
        if leaves > 1 and len(values) > 1:
            for vantage in rng.choice(values, min(4, len(values)), replace=False).tolist():
                far = np.bitwise_count(values ^ np.uint16(vantage))
                mass = np.bincount(far, weights, 17)
                below = np.cumsum(mass)
                # Sides lie on [0, limit] and (limit, 16]: halves, as near as they come.
                limit = int(np.argmin(np.abs(below[:-1] - below[-1] / 2)))
                if below[limit] in (0, below[-1]):
                    continue
                # Values next to the border visit both sides: the fewest win.
                overlap = mass[limit] + mass[limit + 1]
                if best is None or overlap < best[0]:
                    best = (overlap, vantage, limit, far)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vantage, limit, far = best
        at = len(self.nodes)
        self.nodes.append([vantage, limit, 0, 0])
        near = far <= limit
        left = min(leaves - 1, max(1, round(leaves * weights[near].sum() / weights.sum())))
        self.nodes[at][2] = self._grow(values[near], weights[near], left, rng)
        self.nodes[at][3] = self._grow(values[~near], weights[~near], leaves - left, rng)
        return at

    def visits(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all shards the balls of ``radius`` around ``values`` overlap."""
        rows, leaves = [], []
        stack = [(self.root, np.arange(len(values)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            vantage, limit, left, right = self.nodes[node]
            far = np.bitwise_count(values[at] ^ np.uint16(vantage)).astype(np.int16)
            stack.append((left, at[far - radius <= limit]))
            stack.append((right, at[far + radius > limit]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def _quarter(fps: np.ndarray, q: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.uint16)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` bits.

    The edges are spanning forests of the exact links of each shard, so they
    have the links' components without listing all pairs of a dense group.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    # A bounded sample in hash order shapes the trees; every fingerprint is indexed.
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64)
    leaves = max(1, min(VALUES, total // LEAF))
    trees = [VantageTree(_quarter(sample, q), leaves, q) for q in range(QUARTERS)]
    near = radius // QUARTERS

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().astype(np.int64)
            for q, tree in enumerate(trees):
                part = _quarter(fps, q)
                home_row, home_leaf = tree.visits(part, 0)
                home = np.zeros(len(fps), dtype=np.int64)
                home[home_row] = home_leaf
                row, leaf = tree.visits(part, near)
                # Of two shards that overlap, the lower one's rows visit the higher.
                keep = leaf >= home[row]
                row, leaf = row[keep], leaf[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fps[row]),
                        pa.array((leaf * QUARTERS + q).astype(np.int32)),
                        pa.array(leaf == home[row]),
                    ],
                    names=["fp", "shard", "home"],
                )

    routed = materialise(distinct.select("fp").mapInArrow(route, "fp long, shard int, home boolean"), "routed")
    probes = routed.select("fp", "shard")
    members = routed.where("home").select("fp", "shard")
    spread = F.pmod(F.xxhash64("fp"), F.lit(1 << 40))
    dealt = block_grid(members, probes, ["shard"], spread, BLOCK, CHUNK)

    def compare(group: pa.Table) -> pa.Table:
        role = group.column("_role").to_numpy()
        fps = group.column("fp").to_numpy().view(np.uint64)
        member, probe = np.unique(fps[role == 0]), np.unique(fps[role == 1])
        nodes, at = np.unique(np.concatenate((member, probe)), return_inverse=True)
        m_at, p_at = at[:len(member)], at[len(member):]
        forest = LinkForest(len(nodes))
        for s in range(0, len(probe), _SLAB):
            near_by = np.bitwise_count(probe[s:s + _SLAB, None] ^ member[None, :]) <= radius
            i, j = np.nonzero(near_by)
            forest.link(p_at[i + s], m_at[j])
        a, b = forest.edges()
        return pa.table({"a": nodes[a].view(np.int64), "b": nodes[b].view(np.int64)})

    return dealt.groupBy("shard", "_i", "_j").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(key, ``fingerprint``, ``component_id``) of every document.

    Texts are lower-cased A-Z and cut into words at blanks and \\t-\\r; a shingle
    is four words. Null, empty and blank texts have fingerprint 0 and link to
    each other like all equal fingerprints. ``component_id`` is the smallest
    key reachable by links, null if no reachable row has a key. Repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    marked = materialise(fingerprints(docs, key, text), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min(F.col(f"`{key}`")).alias("least")), "classes")
    rooted = rooted_classes(classes, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col(f"`{key}`"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component_id").cast(kind).alias("component_id"),
    )


def rooted_classes(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``classes``, one row per ``fp``, with the ``root`` of its component."""
    roots = components(links(classes.select("fp"), radius), "a", "b")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the smallest key's.

    Rows are told apart by a 128-bit hash of all their columns, not by key:
    where an id stands for several texts each group still keeps one row. Of
    rows that tie in the key the smallest hash stays, of equal rows one. A null
    key comes after all others, so a group without keys keeps one row too.
    """
    one, two = private(docs, "one"), private(docs, "two")
    cells = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumns({one: F.xxhash64(*cells), two: F.xxhash64(F.lit(two), *cells)})
    rows = materialise(
        fingerprints(hashed.select(F.struct(F.col(f"`{key}`").alias("k"), F.col(one).alias("a"), F.col(two).alias("b")).alias("row"), F.col(f"`{text}`").alias("text")), "row", "text")
        .select("fp", F.col("row.k").isNull().alias("none"), F.col("row.k").alias("k"), F.col("row.a").alias("a"), F.col("row.b").alias("b")),
        "fingerprints",
    )
    # The least row of a fingerprint, then of a component: combined before they shuffle.
    classes = materialise(rows.groupBy("fp").agg(F.min(F.struct("none", "k", "a", "b")).alias("least")), "classes")
    heads = rooted_classes(classes).groupBy("root").agg(F.min("least").alias("least"))
    heads = heads.select(F.col("least.a").alias(one), F.col("least.b").alias(two))
    return hashed.join(heads, [one, two], "left_semi").dropDuplicates([one, two]).select(*cells)
