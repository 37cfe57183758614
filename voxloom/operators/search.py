"""Threshold and rule search over labelled features.

Scoring every threshold against every sample is quadratic. Here a threshold
carries the class counts on either side of it, taken from running sums over
the sorted values, so a search costs one distributed sort and constant-size
aggregates. Ties keep the first rule in search order: features by name,
thresholds ascending, '<' before '>', AND before OR.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.operators.ordered import checked_broadcast, ranked_counts
from voxloom.session import materialise

LOW, HIGH = "BG", "EN"
_COUNTS = ("bg", "en")


def candidate_thresholds(
    samples: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label",
    single: str = "epsilon",
) -> DataFrame:
    """Midpoints between distinct values and half a gap beyond both ends.

    Per threshold: ``bg_le``/``en_le`` samples at or below and
    ``bg_lt``/``en_lt`` samples strictly below it, with class totals. A key
    with one distinct value gives value ± epsilon, or with ``single="value"``
    the value itself.
    """
    keys = list(keys)
    ranks = ranked_counts(
        samples,
        keys,
        value,
        {
            "bg": (F.col(label) == LOW).cast("long"),
            "en": (F.col(label) == HIGH).cast("long"),
        },
    )
    v, prev, nxt = F.col(value), F.col("prev_value"), F.col("next_value")
    eps = F.greatest(F.abs(v) * 1e-6, F.lit(1e-9))
    alone = prev.isNull() & nxt.isNull()

    def point(threshold: Column, when: Column | None = None) -> Column:
        """Counts around a threshold between v's neighbours (v itself included)."""
        fields = [threshold.alias("threshold")]
        for c in _COUNTS:
            cum, own = F.col(f"cum_{c}"), F.col(c)
            fields += [
                F.when(threshold >= v, cum).otherwise(cum - own).alias(f"{c}_le"),
                F.when(threshold > v, cum).otherwise(cum - own).alias(f"{c}_lt"),
            ]
        return F.struct(*fields) if when is None else F.when(when, F.struct(*fields))

    alone_points = (
        F.array(point(v)) if single == "value" else F.array(point(v - eps), point(v + eps))
    )
    to_next, from_prev = (v + nxt) / 2.0, (prev + v) / 2.0
    # The midpoint of neighbouring doubles can be the upper one of them; then
    # the row of the upper value owns it, because it knows the counts there.
    points = F.when(alone, alone_points).otherwise(
        F.array_compact(
            F.array(
                point(v - (nxt - v) / 2.0, prev.isNull()),
                point(from_prev, from_prev >= v),
                point(to_next, to_next < nxt),
                point(v + (v - prev) / 2.0, nxt.isNull()),
            )
        )
    )
    return ranks.select(
        *keys, "total_bg", "total_en", F.explode(points).alias("p")
    ).select(*keys, "p.*", "total_bg", "total_en")


def _scored(df: DataFrame, bg_ok: Column, en_ok: Column) -> DataFrame:
    """Confusion counts and the four-part score of a rule."""
    bg_acc = F.coalesce(F.try_divide(F.col("bg_ok"), F.col("total_bg")), F.lit(0.0))
    en_acc = F.coalesce(F.try_divide(F.col("en_ok"), F.col("total_en")), F.lit(0.0))
    return (
        df.withColumn("bg_ok", bg_ok)
        .withColumn("en_ok", en_ok)
        .withColumn("bg_wrong", F.col("total_bg") - F.col("bg_ok"))
        .withColumn("en_wrong", F.col("total_en") - F.col("en_ok"))
        .withColumn("balanced_accuracy", (bg_acc + en_acc) / 2.0)
        .withColumn("min_accuracy", F.least(bg_acc, en_acc))
    )


def _worst_first() -> list[Column]:
    """Sort key under which the best score comes first."""
    return [
        -F.col("balanced_accuracy"),
        -F.col("min_accuracy"),
        F.greatest("bg_wrong", "en_wrong"),
        F.col("bg_wrong") + F.col("en_wrong"),
    ]


def single_rules(samples: DataFrame, keys: Sequence[str], feature: str = "feature") -> DataFrame:
    """Every single-feature rule with its score."""
    cand = candidate_thresholds(samples, [*keys, feature]).withColumn(
        "bg_when_less", F.explode(F.array(F.lit(True), F.lit(False)))
    )
    less = F.col("bg_when_less")
    return _scored(
        cand,
        F.when(less, F.col("bg_lt")).otherwise(F.col("total_bg") - F.col("bg_le")),
        F.when(less, F.col("total_en") - F.col("en_lt")).otherwise(F.col("en_le")),
    )


_RULE = ("feature", "threshold", "bg_when_less", "bg_ok", "bg_wrong", "en_ok", "en_wrong",
         "balanced_accuracy", "min_accuracy")


def _rule_order() -> list[Column]:
    return [F.col("feature"), F.col("threshold"), F.when(F.col("bg_when_less"), 0).otherwise(1)]


def best_single_rule(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first best rule per key, by one mergeable aggregate."""
    return rules.groupBy(*keys).agg(
        F.min_by(F.struct(*_RULE), F.struct(*_worst_first(), *_rule_order())).alias("r")
    ).select(*keys, "r.*")


def top_rules(rules: DataFrame, keys: Sequence[str], per_feature: int = 4) -> DataFrame:
    """The best few rules of every feature; Spark prunes to k before the shuffle."""
    w = Window.partitionBy(*keys, "feature").orderBy(
        *_worst_first(), F.col("threshold"), F.when(F.col("bg_when_less"), 0).otherwise(1)
    )
    return rules.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_feature).select(
        *keys, "rank", *_RULE
    )


def _per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A side with one row per key: without keys exactly one row; with the
    caller's keys it is counted first and broadcast only below the limit."""
    return checked_broadcast(df, "per-key") if keys else F.broadcast(df)


def _holds(rule: Column, features: Column) -> Column:
    value = F.try_element_at(features, rule["feature"])
    return F.when(rule["bg_when_less"], value < rule["threshold"]).otherwise(value > rule["threshold"])


def _feature_map(features: Sequence[str]) -> Column:
    return F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])


def best_pair_rule(
    wide: DataFrame, top: DataFrame, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Best AND/OR of two top rules on different features, per key.

    ``wide`` has one row per sample with the feature columns; ``top`` is the
    output of ``top_rules``, a number of rows fixed by the feature list. Each
    sample becomes the set of rules it satisfies, samples with the same set
    are combined before the shuffle, and only rules (never samples) meet in
    pairs. OR counts follow from the AND counts.
    """
    keys = list(keys)
    rule_list = F.array_sort(
        F.collect_list(F.struct("feature", "rank", "threshold", "bg_when_less"))
    )
    rules = top.groupBy(*keys).agg(rule_list.alias("_rules"))
    joined = wide.join(_per_key(rules, keys), keys or None)
    masks = (
        joined.select(*keys, "label", "_rules", _feature_map(features).alias("_f"))
        .select(
            *keys, "label",
            F.filter(
                F.sequence(F.lit(0), F.size("_rules") - 1),
                lambda i: _holds(F.get(F.col("_rules"), i), F.col("_f")),
            ).alias("_on"),
        )
        .groupBy(*keys, "label", "_on").agg(F.count(F.lit(1)).alias("_n"))
    )
    # Rule -1 always holds: its count with itself is the number of samples.
    hits = (
        masks.withColumn("_on", F.concat(F.array(F.lit(-1)), "_on"))
        .withColumn("i", F.explode("_on"))
        .withColumn("j", F.explode(F.filter("_on", lambda x: x >= F.col("i"))))
        .groupBy(*keys, "i", "j")
        .agg(
            F.sum(F.when(F.col("label") == LOW, F.col("_n")).otherwise(0)).alias("bg"),
            F.sum(F.when(F.col("label") == HIGH, F.col("_n")).otherwise(0)).alias("en"),
        )
    )
    # One small map per key: (i, j) -> joint counts; at most (4 x features)^2.
    table = hits.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(",", "i", "j"), F.struct("bg", "en")))
        ).alias("_hits")
    )
    everything = F.try_element_at(F.col("_hits"), F.lit("-1,-1"))
    per_key = (
        rules.join(_per_key(table, keys), keys or None)
        .withColumn("total_bg", everything["bg"])
        .withColumn("total_en", everything["en"])
    )
    pairs = (
        per_key.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("_rules") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.size("_rules") - 1)))
        .withColumn("use_and", F.explode(F.array(F.lit(True), F.lit(False))))
        .where("i < j")
        .withColumn("first", F.get("_rules", F.col("i")))
        .withColumn("second", F.get("_rules", F.col("j")))
        .where("first.feature <> second.feature")
    )

    def count(i: str, j: str, c: str) -> Column:
        entry = F.try_element_at(F.col("_hits"), F.concat_ws(",", i, j))
        return F.coalesce(entry[c], F.lit(0))

    def selected(c: str) -> Column:
        both = count("i", "j", c)
        return F.when(F.col("use_and"), both).otherwise(count("i", "i", c) + count("j", "j", c) - both)

    scored = _scored(pairs, selected("bg"), F.col("total_en") - selected("en"))
    order = [F.col("i"), F.col("j"), F.when(F.col("use_and"), 0).otherwise(1)]
    return scored.groupBy(*keys).agg(
        F.min_by(
            F.struct(
                F.col("first.feature").alias("feature_1"), F.col("first.threshold").alias("threshold_1"),
                F.col("first.bg_when_less").alias("less_1"), F.col("second.feature").alias("feature_2"),
                F.col("second.threshold").alias("threshold_2"), F.col("second.bg_when_less").alias("less_2"),
                "use_and", "bg_ok", "bg_wrong", "en_ok", "en_wrong", "balanced_accuracy", "min_accuracy",
            ),
            F.struct(*_worst_first(), *order),
        ).alias("r")
    ).select(*keys, "r.*")


def best_two_boundary(
    samples: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label"
) -> DataFrame:
    """Best (bg_boundary < en_boundary) pair per key without trying pairs.

    The outermost candidates route nothing, so the best rule never misroutes
    a sample: the low boundary must stay below every EN value and the high
    one above every BG value. Under that, class and direct accuracy are
    settled and coverage splits into a part per boundary, so each boundary is
    chosen on its own. Only when one candidate separates the classes
    completely do the two compete for it, and then its two neighbours decide.
    """
    keys = list(keys)
    # Read twice below: written once, so that the values are sorted once.
    cand = materialise(
        candidate_thresholds(samples, keys, value, label, single="value").withColumn(
            "en_ge", F.col("total_en") - F.col("en_lt")
        ),
        "candidates",
    )
    safe_low, safe_high = F.col("en_le") == 0, F.col("bg_lt") == F.col("total_bg")
    limits = cand.groupBy(*keys).agg(
        F.max(F.when(safe_low, F.struct("threshold", "bg_le"))).alias("_l"),
        F.min(F.when(safe_high, F.struct("threshold", "en_ge"))).alias("_h"),
    )
    thr, low, high = F.col("threshold"), F.col("_l.threshold"), F.col("_h.threshold")
    options = (
        cand.join(_per_key(limits, keys), keys or None)
        .groupBy(*keys).agg(
            F.first("_l").alias("_l"),
            F.first("_h").alias("_h"),
            F.max(F.col("total_bg") + F.col("total_en")).alias("total"),
            F.min(F.when(safe_low & (F.col("bg_le") == F.col("_l.bg_le")), thr)).alias("_lowest"),
            F.max(F.when(thr < high, F.struct("threshold", "bg_le"))).alias("_below"),
            F.min(F.when(thr > low, F.struct("threshold", "en_ge"))).alias("_above"),
        )
    )
    apart = low < high
    left_cover = F.col("_below.bg_le") + F.col("_h.en_ge")
    right_cover = F.col("_l.bg_le") + F.col("_above.en_ge")
    take_left = F.col("_below").isNotNull() & (
        F.col("_above").isNull() | (left_cover >= right_cover)
    )
    return options.select(
        *keys,
        F.when(apart, F.col("_lowest")).when(take_left, F.col("_below.threshold")).otherwise(low).alias("bg_boundary"),
        F.when(apart, high).when(take_left, high).otherwise(F.col("_above.threshold")).alias("en_boundary"),
        F.when(apart, F.col("_l.bg_le") + F.col("_h.en_ge"))
        .when(take_left, left_cover).otherwise(right_cover).alias("direct"),
        "total",
    ).where("bg_boundary IS NOT NULL AND en_boundary IS NOT NULL").withColumn(
        "coverage", F.col("direct") / F.col("total")
    )


def two_fold_split(samples: DataFrame, order: str, keys: Sequence[str] = ("label", "prompt")) -> DataFrame:
    """Fold A for the first and B for the second repetition of a key.

    A key without exactly two repetitions has no fold and carries a violation.
    Counting replaces a per-key sort, so a hot key does not matter.
    """
    keys = list(keys)
    seen = samples.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return samples.join(seen, keys).select(
        *samples.columns,
        F.when(
            F.col("_n") == 2, F.when(F.col(order) == F.col("_first"), "A").otherwise("B")
        ).alias("fold"),
        F.when(F.col("_n") != 2, "not_two_repetitions").alias("violation"),
    )


def other_fold(fold: Column) -> Column:
    return F.when(fold == "A", "B").otherwise("A")


def evaluate_rules(wide: DataFrame, rules: DataFrame, features: Sequence[str], test_fold: str) -> DataFrame:
    """Confusion counts of one pair or single rule per fold on the samples of ``test_fold``.

    ``rules`` has one row per fold: (fold, kind, first, second, use_and), with
    rules as structs and ``second`` null for a single rule.
    """
    f = _feature_map(features)
    joined = wide.withColumn("_f", f).drop("violation").join(
        rules.withColumnRenamed("fold", "train_fold").withColumn(
            "_t", other_fold(F.col("train_fold")) if test_fold == "other" else F.col("train_fold")
        ),
        F.col("fold") == F.col("_t"),
    )
    one = _holds(F.col("first"), F.col("_f"))
    two = _holds(F.col("second"), F.col("_f"))
    is_bg = F.when(F.col("second").isNull(), one).when(F.col("use_and"), one & two).otherwise(one | two)
    bg = F.col("label") == LOW
    return joined.groupBy("train_fold", "kind").agg(
        F.count_if(bg & is_bg).alias("bg_ok"),
        F.count_if(bg & ~is_bg).alias("bg_wrong"),
        F.count_if(~bg & ~is_bg).alias("en_ok"),
        F.count_if(~bg & is_bg).alias("en_wrong"),
    )
