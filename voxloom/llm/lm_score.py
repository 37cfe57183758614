"""Cross-entropy difference between two matched n-gram models.

A target and a background bigram model share one vocabulary (the tokeniser's,
of fixed size), one order and one smoothing, and the background's counts are
scaled to the target's token mass, so neither looks surer for having seen more.
A document's score is the mean over its tokens of the background's loss less
the target's: above 0, the text is more like the target.

Both models are counted over all rows. Unigrams are bounded by the vocabulary
and travel to the tasks. Bigrams grow with the corpus: they travel only while
their number is below a checked limit, and beyond it they are joined to the
documents' own bigram counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.session import materialise
from voxloom.llm.common import private, split_by_bytes
from voxloom.llm.tokens import TOKENIZER, encode_ids

# Before the first token of a text.
START = 0xFFFF_FFFF
# Weight of the bigram estimate against the unigram one.
LAMBDA = 0.7
# Bigrams that may travel to every task: 12 bytes each.
TRAVEL = 3_000_000
# Distinct bigrams a task sums up before it hands them on.
_HELD = 500_000
# Bytes of ids whose bigrams are held at once.
_RUN_BYTES = 2 << 20


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Bigrams of a text as one number each: previous id and id."""
    before = np.empty(len(ids), dtype=np.uint64)
    if len(ids):
        before[0] = START
        before[1:] = ids[:-1]
    return (before << np.uint64(32)) | ids.astype(np.uint64)


def _runs(column: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Ids of consecutive rows, as many together as memory should hold."""
    for s, e in split_by_bytes(map(len, column), _RUN_BYTES):
        yield [np.frombuffer(x, "<u4") for x in column[s:e]]


def tokenised(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids) with ids as little-endian unsigned 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()
    body = private(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"" if t is None else t for t in b.column(1).cast(pa.binary()).to_pylist()]
            ids = [x.astype("<u4").tobytes() for x in encode_ids(texts, tokenizer)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias(body))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids binary")


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """(pair, n) over all rows, summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def merged():
            pair, at = np.unique(np.concatenate(held[0]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate(held[1]), len(pair)).astype(np.int64)

        def batch(pair, n):
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

        for b in batches:
            for ids in _runs(b.column(0).to_pylist()):
                pair, n = np.unique(np.concatenate([_pairs(x) for x in ids]), return_counts=True)
                held[0].append(pair)
                held[1].append(n)
                if sum(map(len, held[0])) > 2 * _HELD:
                    pair, n = merged()
                    if len(pair) > _HELD:
                        yield batch(pair, n)
                        pair, n = pair[:0], n[:0]
                    held = [pair], [n]
        yield batch(*merged())

    return tokens.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def model(target: DataFrame, background: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(pair -> loss difference of seen bigrams, unigram terms, history terms).

    Both models interpolate bigram and unigram estimates; unigrams are add-one
    smoothed over the shared vocabulary. For a bigram (h, w)
    p(w|h) = LAMBDA c(h,w)/c(h) + (1 - LAMBDA) u(w), with u(w) alone where h
    was not seen. Background counts carry the factor that matches the masses.
    """
    counts = materialise(
        target.select("pair", F.col("n").alias("t"), F.lit(0).cast("long").alias("b"))
        .unionByName(background.select("pair", F.lit(0).cast("long").alias("t"), F.col("n").alias("b")))
        .groupBy("pair").agg(F.sum("t").alias("t"), F.sum("b").alias("b")),
        "bigrams",
    )
    token, history = F.col("pair").bitwiseAND(0xFFFF_FFFF), F.shiftrightunsigned("pair", 32)
    # Rows of the vocabulary's size at most.
    words = counts.groupBy(token.alias("w")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect()
    heads = counts.groupBy(history.alias("h")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect()
    size = 1 + max([r["w"] for r in words], default=0)
    uni = np.zeros((2, size))
    for r in words:
        uni[:, r["w"]] = r["t"], r["b"]
    mass = uni.sum(1)
    scale = mass[0] / mass[1] if mass[0] and mass[1] else 1.0
    uni[1] *= scale
    uni = (uni + 1.0) / (uni.sum(1, keepdims=True) + size)
    hist = np.zeros((2, size + 1))  # the start is filed last
    for r in heads:
        hist[:, size if r["h"] == START else r["h"]] = r["t"], r["b"]
    hist[1] *= scale
    return counts, uni, hist


def _difference(pair: np.ndarray, t: np.ndarray, b: np.ndarray, uni: np.ndarray, hist: np.ndarray, scale: float):
    """Background loss less target loss of bigrams with counts t and b."""
    w = (pair & np.uint64(0xFFFF_FFFF)).astype(np.int64)
    h = np.minimum((pair >> np.uint64(32)).astype(np.int64), hist.shape[1] - 1)
    known = w < uni.shape[1]
    w = np.where(known, w, 0)
    out = []
    for row, n in ((0, t), (1, b * scale)):
        u = np.where(known, uni[row][w], uni[row].min(initial=1.0))
        seen = hist[row][h]
        p = np.where(seen > 0, LAMBDA * n / np.maximum(seen, 1e-300) + (1 - LAMBDA) * u, u)
        out.append(np.log(p))
    return out[0] - out[1]


def score_documents(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    travel: int = TRAVEL,
) -> DataFrame:
    """(key, ``n_tokens``, ``score``) of every document.

    ``target`` has the in-domain texts in its column ``text``; the background
    is ``docs`` itself. Null and empty texts have 0 tokens and score 0; rows
    with equal keys are scored one by one; empty ``docs`` give no rows; with an
    empty target the target model is uniform. Other columns are ignored.
    """
    tokens = materialise(
        tokenised(docs, key, text, tokenizer).withColumnRenamed(key, "key")
        .withColumn("row", F.monotonically_increasing_id()), "tokens",
    )
    aimed = tokenised(target.select(F.col("text"), F.lit(0).alias("k")), "k", "text", tokenizer)
    counts, uni, hist = model(bigram_counts(aimed), bigram_counts(tokens))
    mass_b = hist[1].sum()
    raw = counts.agg(F.sum("b").alias("b")).first()["b"] or 0
    scale = mass_b / raw if raw else 1.0
    total = counts.count()
    if total <= travel:
        table = counts.toArrow()
        pair = table.column("pair").to_numpy().view(np.uint64)
        order = np.argsort(pair)
        pair = pair[order]
        t, b = table.column("t").to_numpy()[order], table.column("b").to_numpy()[order]
        known = _difference(pair, t, b, uni, hist, scale).astype(np.float32)
        # Sent once per executor, not with every task.
        sent = docs.sparkSession.sparkContext.broadcast((pair, known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, known = sent.value
            for batch in batches:
                sizes, scores = [], []
                for ids in _runs(batch.column(1).to_pylist()):
                    n = np.array([len(x) for x in ids], dtype=np.int64)
                    own, back = np.unique(np.concatenate([_pairs(x) for x in ids]), return_inverse=True)
                    # The background holds every bigram of every document.
                    loss = known[np.minimum(np.searchsorted(pair, own), len(pair) - 1)][back] if len(own) else np.zeros(0)
                    total = np.concatenate(([0.0], np.cumsum(loss, dtype=np.float64)))
                    ends = np.cumsum(n)
                    sizes += n.tolist()
                    scores += ((total[ends] - total[ends - n]) / np.maximum(n, 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())],
                    names=["key", "n_tokens", "score"],
                )

        kind = tokens.schema["key"].dataType.simpleString()
        scored = tokens.select("key", "ids").mapInArrow(run, f"key {kind}, n_tokens long, score double")
    else:
        scored = _joined(tokens, counts, uni, hist, scale)
    return scored.select(F.col("key").alias(key), "n_tokens", "score")


def _joined(tokens: DataFrame, counts: DataFrame, uni: np.ndarray, hist: np.ndarray, scale: float) -> DataFrame:
    """The same scores with the bigrams joined: for models of any size."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pair, n = np.unique(_pairs(np.frombuffer(x, "<u4")), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), row)), pa.array(pair.view(np.int64)), pa.array(n)],
                    names=["row", "pair", "m"],
                )

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = b.column(0).to_numpy().view(np.uint64)
            d = _difference(pair, b.column(1).to_numpy(), b.column(2).to_numpy(), uni, hist, scale)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d)], names=["pair", "d"])

    held = tokens.select("row", "ids").mapInArrow(own, "row long, pair long, m long")
    known = counts.select("pair", "t", "b").mapInArrow(differ, "pair long, d double")
    sums = held.join(known, "pair").groupBy("row").agg(F.sum(F.col("m") * F.col("d")).alias("s"), F.sum("m").alias("n"))
    rows = tokens.select("key", "row").join(sums, "row", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("key", n.alias("n_tokens"), (F.coalesce("s", F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("score"))
