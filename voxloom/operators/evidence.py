"""Frame probabilities -> language evidence -> route."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRICS = (
    "mean_non_blank_confidence",
    "min_non_blank_confidence",
    "non_blank_entropy",
    "uncertain_non_blank_ratio",
    "blank_prediction_ratio",
    "mean_blank_probability",
    "non_blank_token_rate",
)

# Delta name -> metric it is taken from (first model minus second model).
DELTAS = {
    "confidence_delta": "mean_non_blank_confidence",
    "min_confidence_delta": "min_non_blank_confidence",
    "entropy_delta": "non_blank_entropy",
    "uncertain_delta": "uncertain_non_blank_ratio",
    "blank_ratio_delta": "blank_prediction_ratio",
    "blank_probability_delta": "mean_blank_probability",
    "token_rate_delta": "non_blank_token_rate",
}

# Fixed calibration values.
BG_BOUNDARY = 0.003
EN_BOUNDARY = 0.043
UNCERTAIN_BELOW = 0.70
MIN_PROBABILITY = 1e-12

# Languages a Bulgarian speaker is commonly mistaken for (fixed list).
BULGARIAN_FAMILY = ("ru", "uk", "be", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl")


def frame_metrics(frames: DataFrame, logits: str = "logits", blank_id: int = 0) -> DataFrame:
    """Per-frame winner, blank probability and normalised entropy.

    The softmax shares one normaliser: the winning probability is its
    reciprocal, so each frame costs two passes over its array.
    """
    x = F.col(logits)
    shifted = (
        frames.withColumn("_top", F.array_max(x))
        .withColumn(
            "_norm",
            F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_top"))),
        )
    )

    floor = math.log(MIN_PROBABILITY)

    def term(v: Column) -> Column:
        log_p = v - F.col("_log_total")
        return F.when(log_p < floor, MIN_PROBABILITY * floor).otherwise(F.exp(log_p) * log_p)

    shifted = shifted.withColumn("_log_total", F.col("_top") + F.log("_norm"))
    entropy = F.aggregate(x, F.lit(0.0), lambda acc, v: acc - term(v))
    return shifted.select(
        *[c for c in frames.columns if c != logits],
        (F.lit(1.0) / F.col("_norm")).alias("max_p"),
        (F.array_position(x, F.col("_top")) != blank_id + 1).alias("non_blank"),
        (F.exp(F.element_at(x, blank_id + 1) - F.col("_top")) / F.col("_norm")).alias("blank_p"),
        (entropy / F.log(F.size(x).cast("double"))).alias("entropy"),
    )


def _metric_columns(where: Column | None = None) -> dict[str, Column]:
    """The seven metrics as one set of aggregates, optionally conditional."""

    def rows(value: Column, extra: Column | None = None) -> Column:
        cond = where
        if extra is not None:
            cond = extra if cond is None else cond & extra
        return value if cond is None else F.when(cond, value)

    speech = F.col("non_blank")
    one = F.lit(1)
    n_speech = F.count(rows(one, speech))
    n_frames = F.count(rows(one))
    n_unsure = F.count(rows(one, speech & (F.col("max_p") < UNCERTAIN_BELOW)))
    return {
        "mean_non_blank_confidence": F.coalesce(F.avg(rows(F.col("max_p"), speech)), F.lit(0.0)),
        "min_non_blank_confidence": F.coalesce(F.min(rows(F.col("max_p"), speech)), F.lit(0.0)),
        "non_blank_entropy": F.coalesce(F.avg(rows(F.col("entropy"), speech)), F.lit(1.0)),
        "uncertain_non_blank_ratio": F.coalesce(F.try_divide(n_unsure, n_speech), F.lit(1.0)),
        "blank_prediction_ratio": F.avg(rows(F.when(speech, 0.0).otherwise(1.0))),
        "mean_blank_probability": F.avg(rows(F.col("blank_p"))),
        "non_blank_token_rate": F.try_divide(n_speech, n_frames),
    }


def utterance_metrics(scored: DataFrame, keys: Sequence[str] = ("utt_id", "model")) -> DataFrame:
    """Seven metrics per utterance and model; one map-side combined shuffle."""
    return scored.groupBy(*keys).agg(*[c.alias(n) for n, c in _metric_columns().items()])


def paired_evidence(
    scored: DataFrame, key: str = "utt_id", first: str = "bg", second: str = "en"
) -> DataFrame:
    """Both models' metrics and their deltas per utterance, in one shuffle.

    Utterances that lack frames of either model are left out, as an inner
    join of the two models would.
    """
    aggs = [F.count(F.when(F.col("model") == m, 1)).alias(f"_n_{m}") for m in (first, second)]
    for model in (first, second):
        for name, column in _metric_columns(F.col("model") == model).items():
            aggs.append(column.alias(f"{model}_{name}"))
    wide = (
        scored.groupBy(key).agg(*aggs)
        .where((F.col(f"_n_{first}") > 0) & (F.col(f"_n_{second}") > 0))
        .drop(f"_n_{first}", f"_n_{second}")
    )
    return wide.select(
        "*",
        *[
            (F.col(f"{first}_{metric}") - F.col(f"{second}_{metric}")).alias(delta)
            for delta, metric in DELTAS.items()
        ],
    )


def route_by_boundaries(
    delta: Column, low: Column | float = BG_BOUNDARY, high: Column | float = EN_BOUNDARY
) -> Column:
    return F.when(delta <= low, "bg").when(delta >= high, "en").otherwise("mixed")


def route_reason(route: Column) -> Column:
    return (
        F.when(route == "bg", "ctc_bulgarian_evidence")
        .when(route == "en", "ctc_english_evidence")
        .otherwise("ctc_ambiguous_evidence")
    )


def route_by_sign(delta: Column, neutral: str = "AMBIGUOUS") -> Column:
    return F.when(delta < 0, "BG").when(delta > 0, "EN").otherwise(neutral)


def normalise_language(code: Column) -> Column:
    trimmed = F.lower(F.trim(code))
    return F.when(trimmed != "", trimmed)


def resolve_detected(df: DataFrame, code: str, confidence: Column | None = None) -> DataFrame:
    """Adds language, mode, reason and confidence for a detected language code."""
    language = normalise_language(F.col(code))
    return (
        df.withColumn("language", language)
        .withColumn("mode", F.when(F.col("language") == "en", "en").otherwise("bg"))
        .withColumn(
            "reason",
            F.when(F.col("language") == "en", "english_detected")
            .when(F.col("language") == "bg", "bulgarian_detected")
            .when(F.col("language").isin(*BULGARIAN_FAMILY), "bulgarian_family_fallback")
            .otherwise("unknown_fallback"),
        )
        .withColumn("confidence", F.lit(None).cast("double") if confidence is None else confidence)
    )


def route_engine(df: DataFrame, mode: str = "mode") -> DataFrame:
    """Engine and forced language per mode; unresolved modes become error rows."""
    m = F.col(mode)
    return (
        df.withColumn(
            "engine",
            F.when(m == "bg", "bulgarian").when(m == "en", "english").when(m == "mixed", "mixed"),
        )
        .withColumn("language_arg", F.when(m.isin("bg", "en"), m))
        .withColumn(
            "error",
            F.when(m == "auto", "auto_mode_must_be_resolved").when(
                ~F.coalesce(m.isin("bg", "en", "mixed"), F.lit(False)), "unsupported_mode"
            ),
        )
    )


def policy_violation(mode: Column, allowed: Column) -> Column:
    """First broken rule of a language policy, null when the policy is valid."""
    codes = F.transform(allowed, lambda c: F.lower(F.trim(c)))
    return (
        F.when(allowed.isNull() | (F.size(allowed) == 0), "empty_languages")
        .when(F.exists(codes, lambda c: c == ""), "blank_language")
        .when(F.size(F.array_distinct(codes)) != F.size(codes), "duplicate_language")
        .when((mode == "bg") & ~F.array_contains(codes, "bg"), "bg_required")
        .when((mode == "en") & ~F.array_contains(codes, "en"), "en_required")
        .when(
            (mode == "mixed")
            & ~(F.array_contains(codes, "bg") & F.array_contains(codes, "en")),
            "bg_and_en_required",
        )
    )


def segment_metrics(
    scored: DataFrame,
    segments: int = 16,
    keys: Sequence[str] = ("utt_id", "model"),
    index: str = "frame_idx",
) -> DataFrame:
    """Metrics per equal slice; an empty slice takes the frame at its start.

    A frame knows its slices from its position and the frame count, so no
    range join is needed: short utterances simply emit a frame more than once.
    """
    keys = list(keys)
    lengths = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_frames"))

    def start(k: Column) -> Column:
        return F.floor(k * F.col("_frames") / segments)

    covers = F.filter(
        F.sequence(F.lit(0), F.lit(segments - 1)),
        lambda k: (start(k) <= F.col(index))
        & (F.col(index) < F.greatest(start(k + 1), start(k) + 1)),
    )
    sliced = scored.join(lengths, keys).withColumn("segment", F.explode(covers))
    speech = F.col("non_blank")
    n_speech = F.count(F.when(speech, 1))
    return sliced.groupBy(*keys, "segment").agg(
        F.coalesce(F.avg(F.when(speech, F.col("max_p"))), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.avg(F.when(speech, F.col("entropy"))), F.lit(1.0)).alias("entropy"),
        F.coalesce(
            F.avg(F.when(speech, (F.col("max_p") < UNCERTAIN_BELOW).cast("double"))), F.lit(1.0)
        ).alias("uncertain"),
        (n_speech / F.count(F.lit(1))).alias("token_rate"),
        n_speech.alias("non_blank_count"),
        F.count(F.lit(1)).alias("frame_count"),
    )


def evidence_symbol(
    confidence_delta: Column, entropy_delta: Column, first_count: Column, second_count: Column
) -> Column:
    first = (confidence_delta > 0) & (entropy_delta < 0)
    second = (confidence_delta < 0) & (entropy_delta > 0)
    return (
        F.when((first_count == 0) & (second_count == 0), ".")
        .when(first, "B")
        .when(second, "E")
        .otherwise("?")
    )


def evidence_timeline(segments: DataFrame, key: str = "utt_id") -> DataFrame:
    """The slice votes of an utterance as one string.

    A group holds one row per slice and model, a number fixed by the caller
    of ``segment_metrics``, so collecting it is bounded.
    """

    def side(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    votes = segments.groupBy(key, "segment").agg(
        *[side(m, c).alias(f"{m}_{c}") for m in ("bg", "en")
          for c in ("confidence", "entropy", "non_blank_count")]
    ).select(
        key,
        "segment",
        evidence_symbol(
            F.col("bg_confidence") - F.col("en_confidence"),
            F.col("bg_entropy") - F.col("en_entropy"),
            F.col("bg_non_blank_count"),
            F.col("en_non_blank_count"),
        ).alias("symbol"),
    )
    return votes.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("segment", "symbol"))),
                lambda s: s["symbol"],
            ),
            "",
        ).alias("timeline")
    )


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def pair_margin(scores: Column, first: int = 0, second: int = 1) -> dict[str, Column]:
    """Margin of two candidates, which of them leads, and the overall top one."""
    a, b = F.get(scores, F.lit(first)), F.get(scores, F.lit(second))
    return {
        "margin": a - b,
        "pair_pred": F.when(a > b, "first").otherwise("second"),
        "top1": F.array_position(scores, F.array_max(scores)).cast("long") - 1,
    }
