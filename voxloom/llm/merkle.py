"""Merkle manifest of a table, kept as level strings of aligned blocks.

Leaves of a group stand in key order. A block holds ``BLOCK`` consecutive
nodes, aligned, and keeps each level of the tree above them as one hex string:
the leaves' digests end to end, then their parents', down to the block's own
root. A parent is the digest of a fixed-width substring (two nodes; the last
one may be alone), a sibling a substring beside a node's own. Block roots are
the nodes of the next tier, which recurses until one node is left; the roots
of the groups form one more tree. All of it is SQL functions over block rows.

No block grows with the data, ranks come from one range shuffle and counters
of its partitions, and a hot group is many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.operators.ordered import checked_broadcast
from voxloom.session import materialise

# Nodes of a block: a power of two.
LEVELS = 8
BLOCK = 1 << LEVELS
# Hex digits of a digest.
WIDTH = 64


def field(value: Column) -> Column:
    """``-`` for a null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _piece(level: Column, at: Column, nodes: int = 1) -> Column:
    """``nodes`` digests of a level string from node ``at`` on; fewer at its end.

    Level strings are ASCII, so they are cut as bytes, in constant time.
    """
    return F.substring(level.cast("binary"), (at * WIDTH + 1).cast("int"), F.lit(WIDTH * nodes))


def parents(level: Column) -> Column:
    """The level above a level string."""
    count = F.ceil(F.octet_length(level) / (2 * WIDTH)).cast("int")
    runs = F.sequence(F.lit(0), count - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(_piece(level, 2 * i, 2), 256)), "")


def positions(rows: DataFrame, group: str, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``pos``, the rank from 0 within the group, and ``size``, the group's rows.

    One range shuffle; ranks are the row's place in its partition plus the
    group's rows in partitions before. Ties are in any order, nulls first.
    Only counters per (group, partition) are joined back.
    """
    spark = rows.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Rows that tie in all columns are spread by a number of their own.
    by = [F.col(group), *[F.col(c) for c in order], F.col("_own")]
    placed = materialise(
        rows.withColumn("_own", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .drop("_own").withColumn("_row", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_row", 33).cast("int"))
    counts = placed.groupBy(F.col(group).alias("_group"), "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # A row per (group, partition): a window meets at most the partitions' number of rows.
    whole = Window.partitionBy("_group")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select(
        "_group", F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(whole).alias("size"),
    )
    spans = checked_broadcast(spans, "spans")
    return placed.join(
        spans, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))
    ).withColumn("pos", F.col("_row") - F.col("_first") + F.col("_ahead")).drop("_row", "_part", "_p", "_group", "_first", "_ahead")


def _depth(size: Column) -> Column:
    """Levels above the leaves of a block of a tree of ``size`` nodes."""
    return F.when(size > BLOCK, LEVELS).when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")


def block_rows(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Nodes (grp, pos, size, node, payload) as blocks with their level strings."""
    rows = nodes.groupBy("grp", "size", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("members")
    )
    base = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))
    depth = _depth(F.col("size"))
    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(LEVELS)), base,
        lambda done, k: F.when(k <= depth, F.concat(done, F.array(parents(F.element_at(done, -1))))).otherwise(done),
    )
    return rows.select(
        "grp", "size", "block", depth.alias("depth"), levels.alias("levels"),
        F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in ["pos", *payload]])).alias("members"),
    )


def build(nodes: DataFrame, payload: Sequence[str] = ()) -> list[DataFrame]:
    """Tiers of blocks, each a written table; in the last every group is one block."""
    tiers = [materialise(block_rows(nodes, payload), "blocks")]
    while not tiers[-1].where(F.col("size") > BLOCK).isEmpty():
        roots = tiers[-1].select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
            F.element_at("levels", -1).alias("node"),
        )
        tiers.append(materialise(block_rows(roots, ()), "blocks"))
    return tiers


def siblings(levels: Column, depth: Column, pos: Column) -> Column:
    """For every level of a block the sibling of node ``pos``: a flanking
    substring, empty where the node is alone, and whether it stands to the left."""

    def at(k: Column) -> Column:
        own = F.call_function("shiftright", (pos % BLOCK).cast("int"), k)
        other = _piece(F.get(levels, k), own.bitwiseXOR(F.lit(1))).cast("string")
        return F.struct(other.alias("node"), (own % 2 == 1).alias("left"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), depth), at)


def _with_path(blocks: DataFrame) -> DataFrame:
    """Members of blocks, one row each, with the path from node to group root."""
    member = F.transform(
        "members",
        lambda m: F.struct(
            m.alias("own"),
            _piece(F.get("levels", F.lit(0)), m["pos"] % BLOCK).cast("string").alias("node"),
            F.concat(siblings(F.col("levels"), F.col("depth"), m["pos"]), F.col("upper")).alias("path"),
        ),
    )
    return blocks.select("grp", "size", "subroot", F.explode(member).alias("m")).select(
        "grp", "size", "subroot", "m.own", "m.node", "m.path"
    )


def paths(tiers: list[DataFrame]) -> DataFrame:
    """Every leaf with ``path``, its siblings up to the group's root, and ``subroot``.

    Paths come down the tiers: a block takes the path of its root, the nodes
    of the block its own segment before it. Joins are per block, not per leaf.
    """
    none = F.array().cast("array<struct<node:string,left:boolean>>")
    top = tiers[-1].withColumns({"upper": none, "subroot": F.element_at("levels", -1)})
    for below in reversed(tiers[:-1]):
        above = _with_path(top).select(
            F.col("grp").alias("_g"), F.col("own.pos").alias("_b"), F.col("path").alias("upper"), "subroot"
        )
        top = below.join(above, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    return _with_path(top)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""

    def up(below: Column, sibling: Column) -> Column:
        other = sibling["node"]
        return F.sha2(F.when(sibling["left"], F.concat(other, below)).otherwise(F.concat(below, other)), 256)

    return F.aggregate(path, node, up)


def proof(path: Column) -> Column:
    """All siblings of a path, end to end."""
    return F.array_join(F.transform(path, lambda s: s["node"]), "")


def manifest(
    rows: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "lang", altered: Column | None = None
) -> DataFrame:
    """Leaf, roots and proof of every row.

    A leaf covers ``columns`` in order. Leaves of a group (nulls are a group)
    ascend by key, ties by digest; group roots are ordered by group, null
    first, by bytes. Returns the key, ``leaf``, ``subroot``, ``root``,
    ``path`` (siblings up to the root, with their side) and ``other``, the
    value of ``altered`` (a leaf to check in place of the own one; null where
    none is given). Null and repeated keys and equal rows are leaves each;
    texts of any length are hashed whole; columns beyond these are ignored; an
    empty table has an empty manifest.
    """
    leaves = rows.select(
        F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{key}`").alias("key"),
        leaf(*[F.col(f"`{c}`") for c in columns]).alias("node"),
        (F.lit(None).cast("string") if altered is None else altered).alias("other"),
    )
    tiers = build(positions(leaves, "grp", ["key", "node"]), ["key", "other"])
    roots = tiers[-1].select("grp", F.element_at("levels", -1).alias("node"))
    # The groups' roots are the leaves of one more tree.
    crown = positions(roots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "node"), "all", ["name"])
    crown = paths(build(crown.withColumnRenamed("all", "grp"), ["name"])).select(
        F.col("own.name").alias("name"), F.col("path").alias("rest"), F.col("subroot").alias("root")
    )
    crown = checked_broadcast(crown, "crown")
    return paths(tiers).join(crown, F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("own.key").alias(key), F.col("node").alias("leaf"), "subroot", "root",
        F.concat("path", "rest").alias("path"), F.col("own.other").alias("other"),
    )
