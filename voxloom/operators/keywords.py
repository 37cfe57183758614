"""Keyword presence in text and in frame tables, and detector calibration."""

from __future__ import annotations


from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import nfkc_casefold
from voxloom.operators.grouped import map_sorted_groups
from voxloom.operators.ordered import checked_broadcast

# ---- fixed values: accepted spellings and the calibrated threshold ----------
WAKE_WORDS = ("аурора", "aurora", "أورورا", "أرور", "أورور")
WAKE_PREFIXES = ("аурора", "aurora")
DETECTION_THRESHOLD = 2.08
# -----------------------------------------------------------------------------


_EDGE = r"[^\p{L}\p{N}_]"
_SHORT = [w for w in WAKE_WORDS if not w.startswith(WAKE_PREFIXES)]
WAKE_SEARCH = f"(?:^|{_EDGE})(?:{'|'.join(WAKE_PREFIXES)}|(?:{'|'.join(_SHORT)})(?:$|{_EDGE}))"


def contains_wake(text: Column) -> Column:
    """Whether a word of the text is a wake word or starts with a wake prefix.

    The word list is never built: plain substring search rules out nearly all
    texts, and one regular expression settles the rest.
    """
    folded = nfkc_casefold(text)
    possible = reduce(lambda a, b: a | b, [folded.contains(w) for w in (*WAKE_PREFIXES, *_SHORT)])
    return F.when(possible, folded.rlike(WAKE_SEARCH)).when(text.isNotNull(), False)


class _Alignment:
    """Min-plus transfer matrices of one keyword.

    State 0 is 'not started' and the last one 'completed'; both cost nothing
    to stay in, which gives the free start and end of an alignment.
    """

    def __init__(self, tokens: list[int], blank: int) -> None:
        path = [blank]
        for token in tokens:
            path += [token, blank]
        self.path, self.size = path, len(path) + 2
        self.open = np.zeros((self.size, len(path)), dtype=bool)
        for j, label in enumerate(path):
            sources = [j + 1] + ([j] if j >= 1 else []) + ([0] if j <= 1 else [])
            if j >= 2 and label != blank and label != path[j - 2]:
                sources.append(j - 1)
            self.open[sources, j] = True

    def frames(self, deficits: np.ndarray) -> np.ndarray:
        """One matrix per frame."""
        out = np.full((len(deficits), self.size, self.size), np.inf)
        cost = deficits[:, None, self.path]
        out[:, :, 1:-1] = np.where(self.open[None], cost, np.inf)
        out[:, 0, 0] = out[:, -1, -1] = 0.0
        # Completed in the frame that pays for one of the last two labels.
        ends = np.minimum(out[:, :, -2], out[:, :, -3])
        out[:, :, -1] = np.minimum(out[:, :, -1], ends)
        return out

    def chain(self, matrices: np.ndarray) -> np.ndarray:
        """Ordered product of all matrices, halving their number each round."""
        while len(matrices) > 1:
            odd = matrices[-1:] if len(matrices) % 2 else matrices[:0]
            pairs = matrices[: len(matrices) - len(odd)]
            product = (pairs[0::2, :, :, None] + pairs[1::2, None, :, :]).min(axis=2)
            matrices = np.concatenate([product, odd])
        return matrices[0]


def keyword_scores(
    frames: DataFrame,
    keywords: dict[str, list[int]],
    blank: int = 0,
    key: str = "utt_id",
    index: str = "frame_idx",
    logits: str = "logits",
    chunk_frames: int = 256,
) -> DataFrame:
    """Per-token deficit of the best alignment of each keyword anywhere in an utterance.

    Alignment is a chain of min-plus matrix products, and those are
    associative: every chunk of frames is reduced to one small matrix per
    keyword on its own, then chunk matrices are multiplied in order, by
    groups of chunks and finally per utterance. No group holds more frames
    than a chunk, however long an utterance is.
    """
    aligned = {word: _Alignment(tokens, blank) for word, tokens in keywords.items()}
    kind = dict(frames.dtypes)[key]
    schema = f"_k {kind}, keyword string, _c bigint, m array<double>"

    def reduce_frames(g: dict) -> list[tuple]:
        values = np.stack(g["_v"])
        deficits = values.max(axis=1, keepdims=True) - values
        return [
            (g["_k"][0], word, int(g["_c"][0]), a.chain(a.frames(deficits)).ravel())
            for word, a in aligned.items()
        ]

    def reduce_chunks(g: dict) -> list[tuple]:
        a = aligned[g["keyword"][0]]
        matrices = np.stack(g["m"]).reshape(-1, a.size, a.size)
        return [(g["_k"][0], g["keyword"][0], int(g["_g"][0]), a.chain(matrices).ravel())]

    chunked = frames.select(
        F.col(key).alias("_k"),
        F.floor(F.col(index) / chunk_frames).alias("_c"),
        F.col(index).alias("_i"),
        F.col(logits).alias("_v"),
    )
    matrices = map_sorted_groups(chunked, ["_k", "_c"], ["_i"], reduce_frames, schema)
    for size in (chunk_frames, None):
        group = F.lit(0).cast("long") if size is None else F.floor(F.col("_c") / size)
        matrices = map_sorted_groups(
            matrices.withColumn("_g", group), ["_k", "keyword", "_g"], ["_c"], reduce_chunks, schema
        )
    score = F.lit(None).cast("double")
    for word, tokens in keywords.items():
        # Start row, last column: the cheapest complete alignment.
        best = F.element_at("m", aligned[word].size) / float(len(tokens))
        score = F.when(F.col("keyword") == word, best).otherwise(score)
    return matrices.select(F.col("_k").alias(key), "keyword", score.alias("score"))


def best_keyword(scores: DataFrame, key: str = "utt_id", threshold: float = DETECTION_THRESHOLD) -> DataFrame:
    """Lowest score per utterance and the decision against the threshold."""
    return scores.groupBy(key).agg(
        F.min_by("keyword", F.struct("score", "keyword")).alias("keyword"),
        F.min("score").alias("score"),
    ).withColumn("detected", F.col("score") < threshold)


def zero_false_accept_threshold(long: DataFrame) -> DataFrame:
    """Largest threshold without false accepts per score column.

    ``long`` has (score_name, score, label) of the calibration split; score
    columns are schema columns, so the per-score side is a handful of rows.
    """
    lowest = long.groupBy("score_name").agg(
        F.min(F.when(F.col("label") == 0, F.col("score"))).alias("lowest_negative")
    )
    below = (
        long.join(checked_broadcast(lowest, "lowest"), "score_name")
        .groupBy("score_name", "lowest_negative")
        .agg(
            F.max(
                F.when((F.col("label") == 1) & (F.col("score") < F.col("lowest_negative")), F.col("score"))
            ).alias("highest_below")
        )
    )
    return below.select(
        "score_name",
        F.coalesce(
            (F.col("highest_below") + F.col("lowest_negative")) / 2, F.col("lowest_negative") / 2
        ).alias("threshold"),
    )


def _judged(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    return long.join(checked_broadcast(thresholds, "thresholds"), "score_name").withColumn(
        "hit", F.col("score") < F.col("threshold")
    )


def detector_evaluation(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detected, positives, false accepts and negatives per score and split."""
    positive = F.col("label") == 1
    return _judged(long, thresholds).groupBy("score_name", "split", "threshold").agg(
        F.count_if(positive & F.col("hit")).alias("detected"),
        F.count_if(positive).alias("positives"),
        F.count_if(~positive & F.col("hit")).alias("false_accepts"),
        F.count_if(~positive).alias("negatives"),
    )


def detector_errors(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Missed positives and falsely accepted negatives, one row each."""
    positive = F.col("label") == 1
    kind = F.when(positive & ~F.col("hit"), "missed").when(~positive & F.col("hit"), "false_accept")
    return _judged(long, thresholds).withColumn("kind", kind).where("kind IS NOT NULL")
