"""Exact deduplication against immutable snapshots through static filters.

A snapshot holds texts once (digest and bytes) and one binary-fuse filter per
bucket of their digests, and is never changed. A new batch is grouped by itself first:
equal texts of the batch meet in one aggregation keyed by digest *and* text,
so bytes decide and copies are combined before they move. Its digests are then
screened by the filters of every snapshot; only positives reach the exact
buckets, where digest and bytes are compared. Texts that no snapshot has become
the next snapshot.

Filters follow the published binary-fuse construction (three hashes in
neighbouring segments, 8-bit fingerprints, peeling). They have no false
negatives, so screening loses nothing; about one strange digest in 256 passes
and is refused by the exact comparison.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import fold_of
from voxloom.operators.ordered import checked_broadcast
from voxloom.session import materialise

# Digests of one filter, and incoming digests that meet it in one task.
BUCKET_KEYS = 1 << 16
PROBE_KEYS = 1 << 19
_BLANKS = r"[\x20\x09-\x0D]+"
_MOST_SEEDS = 64


def normal_text(text: Column) -> Column:
    """Runs of white space as one space; a null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " ")


def strong_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


# --- the filter ----------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key and seed."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """(segment length, segments) for ``n`` keys."""
    length = 4 if n < 2 else min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return length, max(1, math.ceil(room / length) - 2)


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of every hash, in neighbouring segments."""
    mask = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, own slot) in the order they come free; None if some never do."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    for row in slots:
        np.bitwise_xor.at(held, row, np.arange(n))
    rounds, left = [], n
    front = np.flatnonzero(count == 1)
    while len(front):
        keys, at = np.unique(held[front], return_index=True)
        rounds.append((keys, front[at]))
        left -= len(keys)
        touched = slots[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(held, row, keys)
        front = np.unique(touched)
        front = front[count[front] == 1]
    return rounds if left == 0 else None


def build_filter(keys: np.ndarray) -> bytes:
    """A static filter over 64-bit keys: seed, segment length, segments, fingerprints."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(_MOST_SEEDS):
        h = _mix(keys, (seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        slots = _places(h, length, segments)
        rounds = _peel(slots, size)
        if rounds is None:
            continue
        prints, table = _prints(h), np.zeros(size, np.uint8)
        for own, slot in reversed(rounds):
            # A key's own slot is still zero, so it drops out of the three.
            a, b, c = slots[:, own]
            table[slot] = prints[own] ^ table[a] ^ table[b] ^ table[c]
        return np.array([seed, length, segments], "<u4").tobytes() + table.tobytes()
    raise RuntimeError(f"no seed of {_MOST_SEEDS} builds a filter of {len(keys)} keys")


def may_contain(stored: bytes, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the filter."""
    seed, length, segments = np.frombuffer(stored[:12], "<u4").tolist()
    table = np.frombuffer(stored, np.uint8, offset=12)
    h = _mix(keys.astype(np.uint64), (seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b, c = _places(h, length, segments)
    return table[a] ^ table[b] ^ table[c] == _prints(h)


def _keys64(digests: pa.Array) -> np.ndarray:
    raw = b"".join((d or b"")[:8].ljust(8, b"\0") for d in digests.to_pylist())
    return np.frombuffer(raw, "<u8")


# --- snapshots -------------------------------------------------------------------


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of distinct ``digest`` values; a bucket's size is bounded."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        stored = build_filter(_keys64(table.column("digest").combine_chunks()))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": [stored]})

    dealt = digests.select(_bucket(buckets).alias("bucket"), "digest")
    return dealt.groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int, probes: int) -> DataFrame:
    """The digests that a snapshot's filters do not refuse.

    Digests (8 bytes decide) meet their bucket's filter in tasks of bounded
    size: a bucket with many incoming digests is dealt to several, each with
    the filter, whose size is bounded by the bucket.
    """
    deal = max(1, math.ceil(probes / buckets / PROBE_KEYS))
    part = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(deal)).cast("int")
    incoming = digests.select(_bucket(buckets).alias("bucket"), part.alias("part"), "digest")
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))).select("bucket", "part", "filter")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.select(["digest"])
        if not len(right) or not len(own):
            return own.slice(0, 0)
        passed = may_contain(right.column("filter")[0].as_py(), _keys64(own.column("digest").combine_chunks()))
        return own.filter(pa.array(passed))

    return incoming.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(run, "digest binary")


@dataclass(frozen=True)
class Snapshot:
    """One ingested batch, never changed: its ``texts`` that no earlier snapshot
    has (digest, text), and the filters over their digests."""

    texts: DataFrame
    filters: DataFrame
    buckets: int


def distinct_texts(docs: DataFrame, text: str, digest: Callable[[Column], Column], expected: int) -> DataFrame:
    """(digest, text) of a batch, each once; fails where a digest has two texts.

    Digest and whole text are the grouping key, so bytes are compared, and
    copies of a hot text are combined in each map task before they move.
    """
    own = docs.select(normal_text(F.col(f"`{text}`")).alias("text"))
    texts = materialise(own.select(digest(F.col("text")).alias("digest"), "text").distinct(), "texts")
    if texts.count() != expected:
        raise ValueError("two texts of a batch share one digest")
    return texts


def confirm(groups: DataFrame, texts: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of a batch whose text the snapshot holds, byte for byte.

    Fails where a digest stands for different bytes in batch and snapshot.
    """
    passed = screen(groups.select("digest"), snapshot.filters, snapshot.buckets, groups.count())
    # A broadcast only while the positives are counted to be few.
    positive = checked_broadcast(passed, "positives")
    own = texts.join(positive, "digest", "left_semi")
    held = snapshot.texts.join(positive, "digest", "left_semi").withColumnRenamed("text", "held")
    same = F.when(F.col("text") == F.col("held"), True).otherwise(
        F.raise_error(F.concat(F.lit("two texts share the digest "), F.hex("digest"))).cast("boolean")
    )
    return materialise(own.join(held, "digest").where(same).select("digest"), "confirmed")


def take_snapshot(texts: DataFrame, known: list[DataFrame]) -> Snapshot:
    """Stores the batch's texts without the ``known`` digests, and their filters."""
    for digests in known:
        texts = texts.join(checked_broadcast(digests, "known"), "digest", "left_anti")
    stored = materialise(texts, "snapshot") if known else texts
    buckets = max(1, math.ceil(stored.count() / BUCKET_KEYS))
    filters = materialise(build_filters(stored.select("digest"), buckets), "filters")
    return Snapshot(stored, filters, buckets)


def _group(rows: DataFrame) -> DataFrame:
    """Per digest the least key, its first row and the number of rows."""
    return rows.groupBy("digest").agg(
        F.min("key").alias("keep"),
        F.coalesce(F.min_by("row", "key"), F.min("row")).alias("keep_row"),
        F.count("*").alias("n"),
    )


def _merge(state: DataFrame, batch: DataFrame, known: DataFrame) -> DataFrame:
    """Groups after a batch: known ones joined to theirs, fresh ones added."""
    fresh = batch.join(known, "digest", "left_anti")
    again = batch.join(known, "digest", "left_semi").select(
        "digest", F.col("keep").alias("_k"), F.col("keep_row").alias("_r"), F.col("n").alias("_n")
    )
    newer = F.col("_k").isNotNull() & (F.col("keep").isNull() | (F.col("_k") < F.col("keep")))
    merged = state.join(again, "digest", "left").select(
        "digest",
        F.least("keep", "_k").alias("keep"),
        F.when(newer, F.col("_r")).otherwise(F.col("keep_row")).alias("keep_row"),
        (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
    )
    return materialise(merged.unionByName(fresh), "groups")


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    batches: int = 2,
    digest: Callable[[Column], Column] = strong_digest,
) -> DataFrame:
    """Every row with the row of its text that stays.

    The rows arrive in ``batches`` (by a hash of the key), each screened
    against the snapshots of those before. Columns: the key, ``digest``,
    ``keep`` (least key among equal texts), ``group_size`` and ``kept`` (one
    row of every group). A null text counts as empty; rows that repeat a key
    and text are rows each, of which one can stay; a null key comes last, and
    stays only in a group without keys; texts of any length are compared
    whole; other columns are ignored; an empty table gives an empty result. The job
    fails where two texts share one digest.
    """
    if batches < 1:
        raise ValueError("at least one batch")
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn(
        "batch", fold_of(F.col("key"), batches)
    )
    rows = materialise(
        own.select("key", "batch", digest(normal_text(F.col("text"))).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    state, snapshots = None, []
    for b in range(batches):
        groups = materialise(_group(rows.where(F.col("batch") == b)), "groups")
        texts = distinct_texts(own.where(F.col("batch") == b), "text", digest, groups.count())
        known = [confirm(groups, texts, s) for s in snapshots]
        if state is None:
            state = groups
        else:
            # Snapshots hold different texts, so a digest is known to one at most.
            state = _merge(state, groups, reduce(DataFrame.unionByName, known))
        if b + 1 < batches:
            snapshots.append(take_snapshot(texts, known))
    return rows.join(state, "digest").select(
        F.col("key").alias(key), "digest", "keep", F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
    )
