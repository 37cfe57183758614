"""Quality rules: text counts and a calibrated hashed n-gram logistic regression.

Counts (words, symbols, repeated lines, repeated 8-word windows) give a base
rule. The learned rule is a logistic regression on hashed word uni- and
bigrams and byte 4-grams, each group as shares of the text, trained on labelled
rows, Platt-calibrated on labelled rows it was not trained on, and applied to
Arrow batches against a fixed threshold. The labelled sample is bounded by a
parameter; counts and scores cover every text as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxloom.llm.common import append_columns, private, split_by_bytes

# Labelled rows a model is fitted on, in hash order of their key.
SAMPLE = 3000
BITS = 16
THRESHOLD = 0.5
WINDOW = 8
# Bytes of text whose n-grams are held in memory at once.
BATCH_BYTES = 4 << 20
_SCALE = 20.0

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean"
)

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that stop at ``ends``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    at = total[ends]
    return at - np.concatenate(([0], at[:-1]))


class Words:
    """Words of a batch of texts in one list, with the end of every text."""

    def __init__(self, texts: list[bytes]) -> None:
        own = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in own], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.flat = [w for ws in own for w in ws]
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words per text that lie in a window of words found twice or more in it."""
    n = len(words.flat)
    if n < window:
        return np.zeros(len(words.counts), dtype=np.int64)
    h = np.fromiter(map(hash, words.flat), np.int64, n).view(np.uint64)
    size = n - window + 1
    roll = np.zeros(size, dtype=np.uint64)
    for j in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j:j + size]
        roll ^= roll >> np.uint64(29)
    inside = words.text_of[:size] == words.text_of[window - 1:]
    # Windows of different texts never meet.
    roll += words.text_of[:size].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(inside)
    order = at[np.argsort(roll[at], kind="stable")]
    same = roll[order][1:] == roll[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = order[twice]
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + window, -1)
    return _sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), words.ends)


def base_counts(texts: list[bytes], words: Words) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))
    chars = _sums((_STARTS_CHAR[data] & ~_IS_BLANK[data]).astype(np.int64), ends)
    symbols = _sums(_IS_SYMBOL[data].astype(np.int64), ends)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    repeat = repeated_words(words)
    n = words.counts
    failed = (n < 20) | (100 * repeat > 30 * n)
    return [n, chars, symbols, np.array(dup, dtype=np.int64), repeat, failed]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Multiplicative hash of 32-bit numbers to BITS bits."""
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def hashed_ngrams(texts: list[bytes], words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two groups of (feature, text) positions: word uni- and bigrams, byte 4-grams."""
    h = np.fromiter(map(zlib.crc32, words.flat), np.uint32, len(words.flat))
    pair = h[:-1] * np.uint32(31) + h[1:] + np.uint32(7)
    same = words.text_of[:-1] == words.text_of[1:]
    word = np.concatenate((_mixed(h), _mixed(pair[same])))
    word_text = np.concatenate((words.text_of, words.text_of[1:][same]))
    # A pad before each text keeps 4-grams apart and gives every text one.
    data = np.frombuffer(b"".join([b"\x00\x00\x00" + t for t in texts]) + b"\x00\x00\x00", dtype=np.uint8)
    n = len(data) - 3
    gram = data[:n].astype(np.uint32)
    for j in (1, 2, 3):
        gram |= data[j:j + n].astype(np.uint32) << np.uint32(8 * j)
    char_text = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])[:n]
    return [(word, word_text), (_mixed(gram) + np.uint32(1 << BITS), char_text)]


class Model:
    """Weights, bias and calibration of the hashed n-gram regression."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, texts: list[bytes], words: Words) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for feature, text in hashed_ngrams(texts, words):
            sums = np.bincount(text, self.weights[feature], len(texts))
            z += _SCALE * sums / np.maximum(np.bincount(text, minlength=len(texts)), 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 80) -> Model:
    """Adam on the logistic loss with classes weighted alike, then Platt scaling."""
    y = np.array([r[2] for r in rows], dtype=float)
    fit = np.arange(len(rows)) % 4 != 3
    # Narrow types: these three arrays are what the task holds.
    own = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    feature = np.concatenate([r[0] for r in rows]).astype(np.int32)
    value = np.concatenate([r[1] for r in rows]).astype(np.float32) * np.float32(_SCALE)
    n_rows = len(rows)
    rows.clear()
    w, bias = np.zeros(2 << BITS), 0.0
    share = np.where(y == 1, 1 / max(1, (y[fit] == 1).sum()), 1 / max(1, (y[fit] == 0).sum())) * fit
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(own, w[feature] * value, n_rows) + bias
        g = (1 / (1 + np.exp(-z)) - y) * share
        grad = np.append(np.bincount(feature, g[own] * value, len(w)) + 1e-6 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = np.bincount(own, w[feature] * value, n_rows) + bias
    slope, shift = _platt(z[~fit], y[~fit])
    return Model(w.astype(np.float32), float(bias), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels.

    Newton steps on smoothed targets, each halved until the loss falls: where
    the classes separate, a full step would run off to a step function.
    """
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    centre, spread = z.mean(), max(z.std(), 1e-9)
    s = (z - centre) / spread
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(t: np.ndarray) -> float:
        u = t[0] * s + t[1]
        return float((np.logaddexp(0, u) - target * u).sum() + 0.5 * t[0] * t[0] * 1e-3)

    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(t[0] * s + t[1], -60, 60)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(r * s).sum() + 1e-3 * t[0], r.sum()])
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(t[0] / spread), float(t[1] - t[0] * centre / spread)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str, text: str
) -> DataFrame:
    """(key, y, text) of at most ``rows`` labelled documents in hash order.

    A key labelled more than once takes its largest label; of a key that stands
    for several documents the least text counts.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key).agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64(key, F.lit(11)), key).limit(rows)
    )
    # At most ``rows`` short rows.
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(picked.withColumnRenamed(key, "_k")), F.col(f"`{key}`") == F.col("_k")
    ).groupBy("_k", "_y").agg(F.min("_text").alias("_text"))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", rows: int = SAMPLE,
) -> Model | None:
    """A model of P(label = 1), or None where the sample lacks a class."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"" if t is None else t for t in b.column(2).cast(pa.binary()).to_pylist()]
            out = []
            for t in texts:
                words = Words([t])
                found = []
                for feature, _ in hashed_ngrams([t], words):
                    f, n = np.unique(feature, return_counts=True)
                    found.append((f, n / max(1, len(feature))))
                f = np.concatenate([x[0] for x in found]).astype("<u4")
                v = np.concatenate([x[1] for x in found]).astype("<f4")
                out.append((f.tobytes(), v.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                names=["k", "y", "f", "v"],
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for b in batches:
            f, v = b.column(2), b.column(3)
            for i, (k, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                data.append((k, np.frombuffer(f[i].as_buffer(), "<u4"), np.frombuffer(v[i].as_buffer(), "<f4"), y))
        data.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
        data = [r[1:] for r in data]
        if {r[2] for r in data} == {0, 1}:
            m = _fit(data)
            one = ([m.weights.astype("<f4").tobytes()], [m.bias], [m.slope], [m.shift])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(one, (pa.binary(), *[pa.float64()] * 3))], names=["w", "bias", "slope", "shift"]
            )

    sample = labelled_sample(docs, labels, label, rows, key, text)
    kind = sample.schema["_k"].dataType.simpleString()
    found = sample.mapInArrow(features, f"k {kind}, y int, f binary, v binary")
    # The bounded sample meets in one task; the driver gets the weights alone.
    got = found.repartition(1).mapInArrow(fitted, "w binary, bias double, slope double, shift double").collect()
    if not got:
        return None
    m = got[0]
    return Model(np.frombuffer(m["w"], "<f4").astype(np.float32), m["bias"], m["slope"], m["shift"])


def judge(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality_score``, ``kept``.

    Null and empty texts have no words, so they fail the base rule. Rows are
    judged one by one, repeated ones alike; columns named like the new ones are
    replaced; an empty table stays empty. Without a model the base rule decides.
    """

    def score(texts: list[bytes]) -> list[pa.Array]:
        parts = []
        for s, e in split_by_bytes([len(t) + 1 for t in texts], BATCH_BYTES):
            words = Words(texts[s:e])
            base = base_counts(texts[s:e], words)
            p = model.probability(texts[s:e], words) if model else np.ones(e - s)
            parts.append([*base, p, ~base[-1] & (p >= threshold)])
        if not parts:
            parts = [[np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool), np.zeros(0), np.zeros(0, bool)]]
        return [pa.array(np.concatenate([p[i] for p in parts])) for i in range(8)]

    return append_columns(docs, text, f"{BASE}, quality_score double, kept boolean", score)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their own columns."""
    model = train(docs, labels, key, text)
    flag = private(docs, "kept")

    def score(texts: list[bytes]) -> list[pa.Array]:
        keep = np.zeros(len(texts), dtype=bool)
        for s, e in split_by_bytes([len(t) + 1 for t in texts], BATCH_BYTES):
            words = Words(texts[s:e])
            p = model.probability(texts[s:e], words) if model else np.ones(e - s)
            keep[s:e] = ~base_counts(texts[s:e], words)[-1] & (p >= THRESHOLD)
        return [pa.array(keep)]

    return append_columns(docs, text, f"{flag} boolean", score).where(F.col(flag)).drop(flag)
