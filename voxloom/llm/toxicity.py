"""Toxicity by votes of the nearest labelled examples, exact in TF-IDF cosine.

Terms are words, cut to their beginning, which stands for all their forms;
document frequencies come from all documents. All terms of the labelled examples are indexed. Telling terms, those
that labelled rows show to be more or less frequent in toxic texts than
elsewhere (a G-squared test), weigh more, so that a text is near the examples
that share what tells.

The index is inverted, with alike examples in one block of 64 and the largest
weight of every common term noted per block. A text adds up the short postings
of its rare terms; what common words could add at most, by their block maxima,
decides which blocks it has to look into. Blocks are visited in order of that
bound until none left can reach the k-th neighbour, so the neighbours are
exact. Their votes, weighted by similarity, are calibrated on the examples'
own left-one-out votes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.session import materialise, parallelism
from voxloom.llm.common import append_columns, fold_of, private, text_bytes

# Labelled rows of each class that become examples, in hash order of their key.
EXAMPLES = 4000
# Telling terms: the least strength of the test and the least odds, and how
# many times heavier they are.
MIN_G2 = 40.0
MIN_LOG_ODDS = 0.7
TELLING = 8.0
# Characters of a word that make a term.
STEM = 5
NEIGHBOURS = 16
# Power of the cosine by which a neighbour's vote weighs.
POWER = 4
# Examples of a block, terms that have block maxima, texts searched together.
BLOCK = 64
COMMON = 1024
TOGETHER = 256
# Texts whose rare terms are added up at once.
_SLAB = 32
# Digits of a cosine.
DIGITS = 10
# Weight of the silent vote that stands for "no near neighbour".
FAR = 0.1
# Smallest word hashes that make two examples copies of one text.
SKETCH = 3
_WORD = re.compile(r"[^\W_]+")
# Bytes that end a word become blanks, A-Z small letters; those beyond ASCII stay.
_PLAIN = bytes(
    b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Beginnings of the text's words, in order, in UTF-8: runs of letters and
    digits in lower case, cut after ``STEM`` characters."""
    parts = text.translate(_PLAIN).split()
    if text.isascii():
        return [p[:STEM] for p in parts]
    out = []
    for p in parts:
        if p.isascii():
            out.append(p[:STEM])
        else:
            out += [w[:STEM].encode() for w in _WORD.findall(p.decode("utf-8").lower())]
    return out


class Terms:
    """Numbers of the terms of texts in a vocabulary."""

    def __init__(self, vocabulary: bytes) -> None:
        self.known = {w: i for i, w in enumerate(vocabulary.split(b"\n"))}
        self.size = len(self.known)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of all known terms, ordered by text and term."""
        pairs = [np.zeros(0, np.int64)]
        for i, t in enumerate(texts):
            terms = terms_of(t)
            at = np.fromiter(map(self.known.get, terms, repeat(-1)), np.int64, len(terms))
            pairs.append(at[at >= 0] + i * self.size)
        both, times = np.unique(np.concatenate(pairs), return_counts=True)
        return both // self.size, both % self.size, times


@dataclass
class Vectors:
    """TF-IDF vectors of unit length over a fixed vocabulary."""

    terms: Terms
    idf: np.ndarray

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        text, term, times = self.terms.counts(texts)
        weight = (1.0 + np.log(times)) * self.idf[term]
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(term[a:b], weight[a:b] / np.sqrt((weight[a:b] * weight[a:b]).sum())) for a, b in zip(ends, ends[1:])]


class BlockMaxIndex:
    """Inverted index of example vectors with a maximum per common term and block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.n = len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        size = np.array([len(v[0]) for v in vectors], np.int64)
        term = np.concatenate([v[0] for v in vectors]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if self.n else np.zeros(0)
        own = np.repeat(np.arange(self.n), size)
        # The terms most examples have are columns, all others postings.
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:COMMON]
        self.column = np.full(n_terms, -1, np.int64)
        self.column[often] = np.arange(len(often))
        at = self.column[term]
        dense = np.zeros((self.blocks * BLOCK, len(often)), np.float64)
        dense[own[at >= 0], at[at >= 0]] = weight[at >= 0]
        order = self._alike(dense[:self.n])
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        dense[:self.n] = dense[order]
        self.ids = np.concatenate((order, np.full(self.blocks * BLOCK - self.n, -1))).astype(np.int64)
        dense = dense.reshape(self.blocks, BLOCK, -1)
        self.most = dense.max(1).T.copy()
        # A block has the columns of its own language and subject only.
        self.columns = [np.flatnonzero(self.most[:, b]) for b in range(self.blocks)]
        self.dense = [dense[b][:, c].T.copy() for b, c in enumerate(self.columns)]
        rare = at < 0
        by_term = np.argsort(term[rare], kind="stable")
        self.own, self.weight = place[own[rare]][by_term], weight[rare][by_term]
        self.start = np.searchsorted(term[rare][by_term], np.arange(n_terms + 1))
        # Blocks that texts could visit, and those they did.
        self.seen = self.visited = 0

    @staticmethod
    def _alike(dense: np.ndarray) -> np.ndarray:
        """Numbers of the rows with alike ones side by side: halves along the
        direction of most variance, again and again."""
        done, open_ = [], [np.arange(len(dense))]
        while open_:
            own = open_.pop()
            if len(own) <= BLOCK:
                done.append(own)
                continue
            x = dense[own] - dense[own].mean(0)
            way = np.random.default_rng(len(own)).normal(size=x.shape[1])
            for _ in range(8):
                way = x.T @ (x @ way)
                way /= max(np.linalg.norm(way), 1e-300)
            by = own[np.argsort(np.round(x @ way, 9), kind="stable")]
            half = -(-len(own) // (2 * BLOCK)) * BLOCK
            open_ += [by[half:], by[:half]]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def nearest(self, texts: list, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every (terms, weights) the ``k`` examples of largest cosine above
        0, ties to the lower number; without[i] is an example text i must not meet."""
        out = []
        for s in range(0, len(texts), TOGETHER):
            left = None if without is None else without[s:s + TOGETHER]
            out += self._nearest(texts[s:s + TOGETHER], k, left)
        return out

    def _nearest(self, texts: list, k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, width = len(texts), self.blocks * BLOCK
        common = np.zeros((m, self.most.shape[0]))
        score = np.zeros((m, width))
        for s in range(0, m, _SLAB):
            own = texts[s:s + _SLAB]
            row = np.repeat(np.arange(len(own)), [len(t[0]) for t in own])
            term, weight = np.concatenate([t[0] for t in own]), np.concatenate([t[1] for t in own])
            at = self.column[term]
            there = at >= 0
            common[row[there] + s, at[there]] = weight[there]
            term, weight, row = term[~there], weight[~there], row[~there]
            lo, n = self.start[term], self.start[term + 1] - self.start[term]
            where = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            value = self.weight[where] * np.repeat(weight, n)
            place = self.own[where] + np.repeat(row * width, n)
            score[s:s + len(own)] = np.bincount(place, value, len(own) * width).reshape(len(own), width)
        score = score.reshape(m, self.blocks, BLOCK)
        bound = score.max(2) + common @ self.most + 1e-9
        bound[bound <= 2e-9] = -1.0
        best = np.zeros((m, k))
        best_id = np.full((m, k), -1, np.int64)
        self.seen += m * self.blocks
        take = 2
        while True:
            rows = np.flatnonzero((bound.max(1) > 0) & (bound.max(1) >= best[:, -1]))
            if not len(rows):
                break
            take = min(2 * take, self.blocks)
            pick = np.argpartition(-bound[rows], take - 1, axis=1)[:, :take]
            edge = np.take_along_axis(bound[rows], pick, 1)
            valid = (edge > 0) & (edge >= best[rows, -1][:, None])
            found = np.zeros((len(rows), take, BLOCK))
            who, slot = np.nonzero(valid)
            block = pick[who, slot]
            by = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.diff(block[by], append=-1)) + 1
            start = 0
            for end in ends.tolist():
                own = by[start:end]
                b, start = int(block[own[0]]), end
                text = rows[who[own]]
                found[who[own], slot[own]] = score[text, b] + common[text[:, None], self.columns[b]] @ self.dense[b]
            self.visited += len(who)
            bound[rows[who], block] = -1.0
            # Of what was found only that which can be among the best goes on.
            least = np.maximum(best[rows, -1] - 10.0 ** -DIGITS, 1e-12)
            r, c, j = np.nonzero(found >= least[:, None, None])
            ids = self.ids[pick[r, c] * BLOCK + j]
            there = ids >= 0 if without is None else (ids >= 0) & (ids != without[rows[r]])
            held, at = np.nonzero(best_id[rows] >= 0)
            fresh = r[there]
            r = np.concatenate((held, fresh))
            # Rounded, so that the order of additions decides no tie.
            sims = np.concatenate((best[rows[held], at], np.round(found[fresh, c[there], j[there]], DIGITS)))
            ids = np.concatenate((best_id[rows[held], at], ids[there]))
            by = np.lexsort((ids, -sims, r))
            r = r[by]
            place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
            top = place < k
            best[rows], best_id[rows] = 0.0, -1
            best[rows[r[top]], place[top]] = sims[by][top]
            best_id[rows[r[top]], place[top]] = ids[by][top]
        return [(best_id[i, best[i] > 0], best[i, best[i] > 0]) for i in range(m)]


class Model:
    """Index, labels and calibration; picklable, the index built once per worker."""

    def __init__(self, words: bytes, idf: np.ndarray, keys: list, term: np.ndarray, value: np.ndarray, ends: np.ndarray,
                 toxic: np.ndarray, weight: np.ndarray) -> None:
        """Example i has the terms and values up to ``ends[i]``."""
        self.words, self.idf, self.keys = words, idf, keys
        self.term, self.value, self.ends = term, value, ends
        self.toxic, self.weight = toxic, weight
        # Only a text without neighbours is left to the classes' shares.
        self.prior = float((weight * toxic).sum() / max(weight.sum(), 1e-9))

    def calibrate(self, raw: np.ndarray) -> None:
        """Takes the examples' left-one-out votes."""
        self.knots = self._calibrate(raw, self.toxic, self.weight)

    def votes_without_self(self, numbers: np.ndarray) -> np.ndarray:
        """Votes of the examples' neighbours on themselves."""
        own = self.examples()
        found = self.index().nearest([own[i] for i in numbers.tolist()], NEIGHBOURS, numbers)
        return np.array([self.vote(*f) for f in found])

    def examples(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(zip(np.split(self.term, self.ends[:-1]), np.split(self.value, self.ends[:-1])))

    def index(self) -> BlockMaxIndex:
        if "_index" not in self.__dict__:
            self._index = BlockMaxIndex(self.examples(), len(self.idf))
        return self._index

    def space(self) -> Vectors:
        if "_vectors" not in self.__dict__:
            self._vectors = Vectors(Terms(self.words), self.idf)
        return self._vectors

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_vectors")}

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic votes, -1 without neighbours. Texts of one language
        are half alike by their common words, so votes weigh a high power of the
        cosine; far neighbours alone do not make a strong vote."""
        if not len(ids):
            return -1.0
        power = sims ** POWER
        return float((power * self.toxic[ids]).sum() / (power.sum() + FAR))

    @staticmethod
    def _calibrate(raw: np.ndarray, toxic: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Isotonic steps from votes, weighted to the true classes."""
        y = toxic.astype(float)
        none = raw < 0
        prior = (w * y).sum() / max(w.sum(), 1e-9)
        order = np.argsort(raw[~none], kind="stable")
        x, yy, ww = raw[~none][order], y[~none][order], w[~none][order]
        # Pool adjacent violators.
        level: list[list[float]] = []
        for a, b, c in zip(x.tolist(), yy.tolist(), ww.tolist()):
            level.append([a, a, b * c, c])
            while len(level) > 1 and level[-2][2] * level[-1][3] >= level[-1][2] * level[-2][3]:
                last = level.pop()
                level[-1] = [level[-1][0], last[1], level[-1][2] + last[2], level[-1][3] + last[3]]
        # A little of the prior keeps pure steps inside (0, 1).
        points = [(edge, (p[2] + 0.5 * prior) / (p[3] + 0.5)) for p in level for edge in (p[0], p[1])]
        if not points:
            points = [(0.0, prior)]
        return np.array([p[0] for p in points]), np.array([p[1] for p in points])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list]:
        """Score of every text and the neighbours (numbers, cosines) that voted."""
        found = self.index().nearest(self.space().vectors(texts), NEIGHBOURS)
        raw = np.array([self.vote(*f) for f in found])
        scores = np.where(raw < 0, self.prior, np.interp(raw, *self.knots)) if len(raw) else raw
        return scores, found


def _rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int):
    """(k, y, text) of the examples and the number of labelled rows per class.

    At most ``rows`` keys of each class and one text of each key: of a key that
    repeats the least text.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold_of(F.col(key)) != 0))
        .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    )
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(key, F.lit(5)), F.col(key)]
    picked = known.where("_y = 1").orderBy(*order).limit(rows).unionByName(
        known.where("_y = 0").orderBy(*order).limit(rows)
    )
    # At most 2 * ``rows`` short rows.
    return docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(picked.withColumnRenamed(key, "_d")), F.col("_k") == F.col("_d")
    ).groupBy("_k", "_y").agg(F.min("_text").alias("_text")), sizes


def sketch(text: bytes) -> bytes:
    """Equal for copies of a text, and nearly always where a few words differ."""
    hashes = sorted({zlib.crc32(w) for w in terms_of(text)})[:SKETCH]
    return b"".join(h.to_bytes(4, "big") for h in hashes)


def _distinct_examples(rows: DataFrame) -> DataFrame:
    """One example of each group of copies and class, stored: a text copied a
    thousand times must not make its chance words look telling."""
    kind = rows.schema["_k"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [sketch(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.binary())], names=["_k", "_y", "_text", "_s"])

    marked = rows.mapInArrow(mark, f"_k {kind}, _y int, _text string, _s binary")
    first = marked.groupBy("_s", "_y").agg(F.min(F.struct("_k", "_text")).alias("r"))
    return materialise(first.select("r._k", "_y", "r._text"), "examples")


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic", rows: int = EXAMPLES,
) -> Model | None:
    """A model of P(label = 1) from labelled rows outside the held-out fold
    (crc32 of the key modulo 5 is 0), or None where a class is missing."""
    picked, sizes = _rows(docs, labels, key, text, label, rows)
    examples = _distinct_examples(picked)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = {0: Counter(), 1: Counter()}
            n = {0: 0, 1: 0}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                y = 1 if y == 1 else 0
                n[y] += 1
                count[y].update(set(terms_of(t or b"")))
            for y in (0, 1):
                terms = list(count[y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b"", *terms], pa.binary()).cast(pa.string()), pa.array([y] * (len(terms) + 1), pa.int32()),
                     pa.array([n[y], *[count[y][t] for t in terms]], pa.int64())],
                    names=["term", "y", "n"],
                )

    counts = (
        examples.select("_y", "_text").mapInArrow(presence, "term string, y int, n long")
        .groupBy("term").agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"),
        )
    )
    total = counts.where("term = ''").first()
    n1, n0 = (total["a"], total["b"]) if total else (0, 0)
    if not n1 or not n0:
        return None

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p = (a + b) / (n1 + n0)
    g2 = 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))
    odds = F.abs(F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1)))
    told = counts.where("term <> ''").select(
        "term", ((g2 >= MIN_G2) & (odds >= MIN_LOG_ODDS)).alias("telling")
    ).toArrow().sort_by("term")
    # All terms of the examples, which are bounded; they travel as one text.
    words = "\n".join(told.column("term").to_pylist()).encode()
    heavier = np.where(told.column("telling").to_numpy(), TELLING, 1.0)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(sent.value)
        seen = np.zeros(len(terms.known) + 1, dtype=np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            seen += np.bincount(terms.counts(texts)[1], minlength=len(seen))
            seen[-1] += len(texts)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "n"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(frequency, "term long, n long")
    df = np.zeros(len(heavier) + 1)
    sums = found.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    idf = heavier * (np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(Terms(sent.value), idf)
        for batch in batches:
            got = own.vectors(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v[0].astype(np.int32) for v in got], pa.list_(pa.int32())),
                 pa.array([v[1] for v in got], pa.list_(pa.float64()))],
                names=["k", "y", "t", "w"],
            )

    kind = examples.schema["_k"].dataType.simpleString()
    stored = examples.mapInArrow(embed, f"k {kind}, y int, t array<int>, w array<double>").orderBy("k").toArrow().combine_chunks()
    # Flat arrays: the terms of all examples do not fit the driver as objects.
    flat = {c: stored.column(c).chunk(0) for c in ("t", "w")}
    toxic = (stored.column("y").to_numpy() == 1).astype(np.int64)
    n = np.bincount(toxic, minlength=2)
    weight = np.where(toxic == 1, sizes.get(1, 0) / max(1, n[1]), sum(v for k, v in sizes.items() if k != 1) / max(1, n[0]))
    model = Model(
        words, idf, stored.column("k").to_pylist(), flat["t"].values.to_numpy(), flat["w"].values.to_numpy(),
        flat["t"].offsets.to_numpy()[1:].astype(np.int64), toxic, weight,
    )
    del stored, flat
    return _calibrated(docs.sparkSession, model)


def _calibrated(spark: SparkSession, model: Model) -> Model:
    """The examples vote on each other in tasks; the driver gets a number each."""
    sent = spark.sparkContext.broadcast(model)
    n = len(model.keys)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.votes_without_self(numbers))], names=["i", "raw"])

    tasks = max(1, min(parallelism(spark), n // 500))
    got = spark.range(0, n, 1, tasks).mapInArrow(votes, "i long, raw double").toArrow()
    raw = np.zeros(n)
    raw[got.column("i").to_numpy()] = got.column("raw").to_numpy()
    model.calibrate(raw)
    return model


def score_texts(
    docs: DataFrame, model: Model | None, text: str = "text", evidence: bool = False, threshold: float = 0.5
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and, if asked for,
    ``evidence``: keys and similarities of the neighbours that voted.

    Null and empty texts have no terms and score the share of toxic labels. Rows are scored one by one; columns named like the new ones are
    replaced; an empty table stays empty; without a model all score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[bytes]) -> list[pa.Array]:
        own = sent.value
        p, near = own.score(texts) if own else (np.zeros(len(texts)), [((), ())] * len(texts))
        out = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
        if evidence:
            out.append(pa.array(
                [[{"key": str(own.keys[i]), "cosine": float(s)} for i, s in zip(*g)] for g in near],
                pa.list_(pa.struct([("key", pa.string()), ("cosine", pa.float64())])),
            ))
        return out

    fields = "score double, predicted int"
    return append_columns(docs, text, fields, score) if not evidence else _with_evidence(docs, text, score)


def _with_evidence(docs: DataFrame, text: str, score) -> DataFrame:
    # The struct's own commas do not fit the short field list.
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted", "evidence")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *score(texts)], names=[*b.schema.names, "score", "predicted", "evidence"])

    return kept.mapInArrow(run, f"{schema}, score double, predicted int, evidence array<struct<key:string,cosine:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` not predicted toxic, with their own columns."""
    model = train(docs, labels, key, text)
    flag = private(docs, "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[bytes]) -> list[pa.Array]:
        own = sent.value
        return [pa.array(own.score(texts)[0] >= 0.5 if own else np.zeros(len(texts), bool))]

    return append_columns(docs, text, f"{flag} boolean", score).where(~F.col(flag)).drop(flag)
