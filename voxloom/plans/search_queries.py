"""Threshold search, held-out folds and detector calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import evaluate as va
from voxloom.operators import evidence as ev
from voxloom.operators import keywords as kw
from voxloom.operators import search as se
from voxloom.plans import adapters as ad
from voxloom.plans.registry import query, with_ctes
from voxloom.plans.report_queries import COVERAGE_SQL
from voxloom.session import materialise


def sql_candidates(source: str, group: str, out: str, epsilon: bool) -> str:
    """CTE of candidate thresholds of ``source`` (group, value)."""
    alone = (
        f"SELECT {group}, unnest([v - greatest(abs(v) * 1e-6, 1e-9), v + greatest(abs(v) * 1e-6, 1e-9)]) AS thr "
        f"FROM {out}_d WHERE p IS NULL AND n IS NULL"
        if epsilon else f"SELECT {group}, v AS thr FROM {out}_d WHERE p IS NULL AND n IS NULL"
    )
    return f"""
{out}_d AS (SELECT {group}, v, lag(v) OVER (PARTITION BY {group} ORDER BY v) AS p,
    lead(v) OVER (PARTITION BY {group} ORDER BY v) AS n
  FROM (SELECT DISTINCT {group}, value AS v FROM {source})),
{out} AS (SELECT {group}, (v + n) / 2.0 AS thr FROM {out}_d WHERE n IS NOT NULL
  UNION ALL SELECT {group}, v - (n - v) / 2.0 FROM {out}_d WHERE p IS NULL AND n IS NOT NULL
  UNION ALL SELECT {group}, v + (v - p) / 2.0 FROM {out}_d WHERE n IS NULL AND p IS NOT NULL
  UNION ALL {alone})"""


SCORE_SQL = """
  (coalesce(bg_ok / nullif(bg_ok + bg_wrong, 0), 0.0) + coalesce(en_ok / nullif(en_ok + en_wrong, 0), 0.0)) / 2.0 AS bal,
  least(coalesce(bg_ok / nullif(bg_ok + bg_wrong, 0), 0.0), coalesce(en_ok / nullif(en_ok + en_wrong, 0), 0.0)) AS mn,
  greatest(bg_wrong, en_wrong) AS worst, bg_wrong + en_wrong AS errs"""


def sql_rules(source: str, group: str) -> str:
    """Brute force: every threshold and direction against every sample."""
    g = ", ".join(f"c.{x.strip()}" for x in group.split(","))
    on = " AND ".join(f"c.{x.strip()} = s.{x.strip()}" for x in group.split(","))
    return sql_candidates(source, group, "cands", True) + f""",
counted AS (
  SELECT {g}, c.thr, less, count(*) FILTER (s.label = 'BG' AND hit) AS bg_ok, count(*) FILTER (s.label = 'BG' AND NOT hit) AS bg_wrong,
    count(*) FILTER (s.label = 'EN' AND NOT hit) AS en_ok, count(*) FILTER (s.label = 'EN' AND hit) AS en_wrong
  FROM cands c JOIN (VALUES (true), (false)) d(less) ON true JOIN {source} s ON {on},
    LATERAL (SELECT CASE WHEN less THEN s.value < c.thr ELSE s.value > c.thr END AS hit) h
  GROUP BY {g}, c.thr, less),
rules AS (SELECT *, {SCORE_SQL} FROM counted)"""


@query(
    "threshold_candidates",
    with_ctes(ad.SQL_FEATURES, sql_candidates("long", "feature", "cands", True),
              "SELECT feature, round(thr, 9) AS threshold FROM cands"),
)
def threshold_candidates(t):
    return se.candidate_thresholds(ad.feature_long(t), ["feature"]).select(
        "feature", F.round("threshold", 9).alias("threshold")
    )


_RULE_OUT = """feature, round(thr, 9) AS threshold, less AS bg_when_less, bg_ok, bg_wrong, en_ok, en_wrong,
  round(bal, 6) AS balanced_accuracy, round(mn, 6) AS min_accuracy"""


def _rule_columns(df):
    return df.select(
        *[c for c in ("fold", "rank") if c in df.columns],
        "feature", F.round("threshold", 9).alias("threshold"), "bg_when_less", "bg_ok", "bg_wrong", "en_ok",
        "en_wrong", F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
        F.round("min_accuracy", 6).alias("min_accuracy"),
    )


@query(
    "best_single_rule",
    with_ctes(
        ad.SQL_FEATURES, sql_rules("long", "feature"),
        f"SELECT {_RULE_OUT} FROM rules ORDER BY bal DESC, mn DESC, worst, errs, feature, thr, less DESC LIMIT 1",
    ),
)
def best_single_rule(t):
    return _rule_columns(se.best_single_rule(se.single_rules(ad.feature_long(t), []), []))


_TOP_SQL = """
topk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY bal DESC, mn DESC, worst, errs, thr, less DESC)::INT AS rank FROM rules
  QUALIFY rank <= 4)"""


@query(
    "topk_rules",
    with_ctes(ad.SQL_FEATURES, sql_rules("long", "feature"), _TOP_SQL, f"SELECT rank, {_RULE_OUT} FROM topk"),
)
def topk_rules(t):
    return _rule_columns(se.top_rules(se.single_rules(ad.feature_long(t), []), []))


def _pair_columns(df):
    return df.select(
        *[c for c in ("fold",) if c in df.columns],
        "feature_1", F.round("threshold_1", 9).alias("threshold_1"), "less_1",
        "feature_2", F.round("threshold_2", 9).alias("threshold_2"), "less_2", "use_and",
        "bg_ok", "bg_wrong", "en_ok", "en_wrong",
        F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("min_accuracy", 6).alias("min_accuracy"),
    )


_PAIR_SQL = """
base AS (SELECT *, row_number() OVER (ORDER BY feature, rank) AS ord FROM topk),
fired AS (SELECT b.ord, s.sample_id, s.label, CASE WHEN b.less THEN s.value < b.thr ELSE s.value > b.thr END AS hit
  FROM base b JOIN long s ON s.feature = b.feature),
pair_counts AS (
  SELECT x.ord AS i, y.ord AS j, use_and,
    count(*) FILTER (x.label = 'BG' AND h) AS bg_ok, count(*) FILTER (x.label = 'BG' AND NOT h) AS bg_wrong,
    count(*) FILTER (x.label = 'EN' AND NOT h) AS en_ok, count(*) FILTER (x.label = 'EN' AND h) AS en_wrong
  FROM fired x JOIN fired y ON x.sample_id = y.sample_id AND x.ord < y.ord
    JOIN base bx ON bx.ord = x.ord JOIN base by_ ON by_.ord = y.ord AND bx.feature <> by_.feature
    JOIN (VALUES (true), (false)) u(use_and) ON true,
    LATERAL (SELECT CASE WHEN use_and THEN x.hit AND y.hit ELSE x.hit OR y.hit END AS h) z
  GROUP BY x.ord, y.ord, use_and),
pair_scores AS (SELECT *, """ + SCORE_SQL + """ FROM pair_counts)"""


@query(
    "best_pair_rule",
    with_ctes(
        ad.SQL_FEATURES, sql_rules("long", "feature"), _TOP_SQL, _PAIR_SQL,
        """SELECT a.feature AS feature_1, round(a.thr, 9) AS threshold_1, a.less AS less_1, b.feature AS feature_2,
          round(b.thr, 9) AS threshold_2, b.less AS less_2, use_and, p.bg_ok, p.bg_wrong, p.en_ok, p.en_wrong,
          round(p.bal, 6) AS balanced_accuracy, round(p.mn, 6) AS min_accuracy
        FROM pair_scores p JOIN base a ON a.ord = i JOIN base b ON b.ord = j
        ORDER BY p.bal DESC, p.mn DESC, p.worst, p.errs, i, j, use_and DESC LIMIT 1""",
    ),
)
def best_pair_rule(t):
    wide = ad.stored_features(t)
    top = se.top_rules(se.single_rules(ad.long_features(wide), []), [])
    return _pair_columns(se.best_pair_rule(wide, top, ad.FEATURES, []))


def sql_two_boundary(source: str, group: str, out: str) -> str:
    """Brute force over all ordered candidate pairs of ``source`` (group, value, label)."""
    return sql_candidates(source, group, out + "_c", False) + f""",
{out}_n AS (SELECT c.{group}, c.thr, count(*) FILTER (label = 'BG' AND value <= thr) AS bg_le, count(*) FILTER (label = 'EN' AND value <= thr) AS en_le,
    count(*) FILTER (label = 'BG' AND value >= thr) AS bg_ge, count(*) FILTER (label = 'EN' AND value >= thr) AS en_ge, count(*) AS total
  FROM {out}_c c JOIN {source} s ON s.{group} = c.{group} GROUP BY c.{group}, c.thr),
{out}_p AS (SELECT a.{group}, a.thr AS bg_boundary, b.thr AS en_boundary, a.bg_le + a.en_le + b.bg_ge + b.en_ge AS direct,
    a.en_le + b.bg_ge AS wrong, a.bg_le + b.en_ge AS correct, a.total,
    coalesce(a.bg_le / nullif(a.bg_le + b.bg_ge, 0), 1.0) AS bg_acc, coalesce(b.en_ge / nullif(b.en_ge + a.en_le, 0), 1.0) AS en_acc
  FROM {out}_n a JOIN {out}_n b ON a.{group} = b.{group} AND a.thr < b.thr),
{out} AS (SELECT * FROM {out}_p QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY wrong, least(bg_acc, en_acc) DESC,
    coalesce(correct / nullif(direct, 0), 0.0) DESC, direct / total DESC, bg_boundary, en_boundary) = 1)"""


@query(
    "best_two_boundary",
    with_ctes(
        ad.SQL_FEATURES, sql_two_boundary("long", "feature", "best"),
        """SELECT feature, round(bg_boundary, 9) AS bg_boundary, round(en_boundary, 9) AS en_boundary, direct, total,
          round(direct / total, 6) AS coverage FROM best""",
    ),
)
def best_two_boundary(t):
    out = se.best_two_boundary(ad.feature_long(t), ["feature"])
    return out.select(
        "feature", F.round("bg_boundary", 9).alias("bg_boundary"), F.round("en_boundary", 9).alias("en_boundary"),
        "direct", "total", F.round("coverage", 6).alias("coverage"),
    )


_FOLD_SQL = """
folds AS (SELECT *, CASE WHEN count(*) OVER k = 2 THEN CASE WHEN row_number() OVER (PARTITION BY label, prompt ORDER BY sample_id) = 1 THEN 'A' ELSE 'B' END END AS fold
  FROM samples WINDOW k AS (PARTITION BY label, prompt)),
fold_long AS (UNPIVOT (SELECT * FROM folds WHERE fold IS NOT NULL) ON mean_word_len, n_chars, n_words, punct_share INTO NAME feature VALUE value)"""


def folded(t):
    return se.two_fold_split(ad.stored_features(t), "sample_id")


@query(
    "fold_split",
    with_ctes(
        ad.SQL_FEATURES, _FOLD_SQL,
        "SELECT sample_id, label, prompt, fold, CASE WHEN fold IS NULL THEN 'not_two_repetitions' END AS violation FROM folds",
    ),
)
def fold_split(t):
    return folded(t).select("sample_id", "label", "prompt", "fold", "violation")


_FOLD_EVAL_SQL = """
single AS (SELECT fold, feature, thr, less, CASE fold WHEN 'A' THEN 'B' ELSE 'A' END AS test_fold FROM rules
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY bal DESC, mn DESC, worst, errs, feature, thr, less DESC) = 1),
topk AS (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY bal DESC, mn DESC, worst, errs, thr, less DESC)::INT AS rank FROM rules
  QUALIFY rank <= 4),
base AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY feature, rank) AS ord FROM topk),
fired AS (SELECT b.fold, b.ord, b.feature, s.fold AS on_fold, s.sample_id, s.label, CASE WHEN b.less THEN s.value < b.thr ELSE s.value > b.thr END AS hit
  FROM base b JOIN fold_long s ON s.feature = b.feature),
pair_counts AS (
  SELECT x.fold, x.on_fold, x.ord AS i, y.ord AS j, use_and,
    count(*) FILTER (x.label = 'BG' AND h) AS bg_ok, count(*) FILTER (x.label = 'BG' AND NOT h) AS bg_wrong,
    count(*) FILTER (x.label = 'EN' AND NOT h) AS en_ok, count(*) FILTER (x.label = 'EN' AND h) AS en_wrong
  FROM fired x JOIN fired y ON x.fold = y.fold AND x.sample_id = y.sample_id AND x.ord < y.ord AND x.feature <> y.feature
    JOIN (VALUES (true), (false)) u(use_and) ON true,
    LATERAL (SELECT CASE WHEN use_and THEN x.hit AND y.hit ELSE x.hit OR y.hit END AS h) z
  GROUP BY x.fold, x.on_fold, x.ord, y.ord, use_and),
pair_scores AS (SELECT *, """ + SCORE_SQL + """ FROM pair_counts WHERE fold = on_fold),
pair_best AS (SELECT * FROM pair_scores QUALIFY row_number() OVER (PARTITION BY fold ORDER BY bal DESC, mn DESC, worst, errs, i, j, use_and DESC) = 1)"""


@query(
    "fold_eval",
    with_ctes(
        ad.SQL_FEATURES, _FOLD_SQL, sql_rules("fold_long", "fold, feature"), _FOLD_EVAL_SQL,
        """SELECT *, (SELECT count(*) FROM folds WHERE fold IS NULL) AS dropped FROM (
          SELECT r.fold AS train_fold, 'single' AS kind, count(*) FILTER (label = 'BG' AND h) AS bg_ok, count(*) FILTER (label = 'BG' AND NOT h) AS bg_wrong,
            count(*) FILTER (label = 'EN' AND NOT h) AS en_ok, count(*) FILTER (label = 'EN' AND h) AS en_wrong
          FROM single r JOIN fold_long s ON s.fold = r.test_fold AND s.feature = r.feature,
            LATERAL (SELECT CASE WHEN r.less THEN s.value < r.thr ELSE s.value > r.thr END AS h) z GROUP BY r.fold
        UNION ALL
        SELECT b.fold, 'pair', c.bg_ok, c.bg_wrong, c.en_ok, c.en_wrong FROM pair_best b JOIN pair_counts c
          ON c.fold = b.fold AND c.i = b.i AND c.j = b.j AND c.use_and = b.use_and AND c.on_fold <> b.fold)""",
    ),
)
def fold_eval(t):
    """Rules found on one fold, scored on the other, in both directions.

    ``dropped`` counts the samples without exactly two repetitions.
    """
    everything = materialise(folded(t), "folds")
    wide = everything.where("fold IS NOT NULL")
    long = wide.unpivot(["sample_id", "label", "fold"], list(ad.FEATURES), "feature", "value")
    # The best single rule is the first of its feature, so the few rules kept
    # per feature serve both searches.
    top = materialise(se.top_rules(se.single_rules(long, ["fold"]), ["fold"]), "rules")
    single = se.best_single_rule(top, ["fold"])
    pair = se.best_pair_rule(wide.drop("violation"), top, ad.FEATURES, ["fold"])
    kind = "struct<feature:string,threshold:double,bg_when_less:boolean>"
    found = single.select(
        "fold", F.lit("single").alias("kind"), F.struct("feature", "threshold", "bg_when_less").alias("first"),
        F.lit(None).cast(kind).alias("second"), F.lit(None).cast("boolean").alias("use_and"),
    ).unionByName(
        pair.select(
            "fold", F.lit("pair").alias("kind"),
            F.struct(F.col("feature_1").alias("feature"), F.col("threshold_1").alias("threshold"), F.col("less_1").alias("bg_when_less")).alias("first"),
            F.struct(F.col("feature_2").alias("feature"), F.col("threshold_2").alias("threshold"), F.col("less_2").alias("bg_when_less")).alias("second"),
            "use_and",
        )
    )
    return _with_dropped(se.evaluate_rules(wide, found, ad.FEATURES, "other"), everything)


def _with_dropped(report, everything):
    # A global aggregate is exactly one row.
    return report.join(F.broadcast(everything.agg(F.count_if(F.col("fold").isNull()).alias("dropped"))))


@query(
    "fold_intersection",
    with_ctes(
        ad.SQL_FEATURES, _FOLD_SQL,
        "fold_delta AS (SELECT fold, label, mean_word_len AS value FROM folds WHERE fold IS NOT NULL)",
        sql_two_boundary("fold_delta", "fold", "best"),
        "safe AS (SELECT min(bg_boundary) AS lo, max(en_boundary) AS hi FROM best)",
        "routed AS (SELECT label AS t, CASE WHEN value <= lo THEN 'BG' WHEN value >= hi THEN 'EN' ELSE 'MIXED' END AS r FROM fold_delta, safe)",
        f"SELECT (SELECT round(lo, 9) FROM safe) AS bg_boundary, (SELECT round(hi, 9) FROM safe) AS en_boundary, {COVERAGE_SQL}, (SELECT count(*) FROM folds WHERE fold IS NULL) AS dropped FROM routed",
    ),
)
def fold_intersection(t):
    """The more careful boundary of both folds, judged on all samples of folds.

    ``dropped`` counts the samples without exactly two repetitions.
    """
    everything = materialise(folded(t), "folds")
    samples = everything.where("fold IS NOT NULL").select("fold", "label", F.col("mean_word_len").alias("value"))
    safe = materialise(
        se.best_two_boundary(samples, ["fold"]).agg(
            F.min("bg_boundary").alias("bg_boundary"), F.max("en_boundary").alias("en_boundary")
        ),
        "safe",
    )
    # A global aggregate is exactly one row, so this broadcast is one row too.
    routed = samples.join(F.broadcast(safe)).withColumn(
        "route", ev.route_by_boundaries(F.col("value"), F.col("bg_boundary"), F.col("en_boundary"))
    )
    report = va.coverage_report(routed, "label", "route", ["bg_boundary", "en_boundary"])
    bounds = safe.select(F.round("bg_boundary", 9).alias("bg_boundary"), F.round("en_boundary", 9).alias("en_boundary"))
    out = ad.rounded(report).drop("bg_boundary", "en_boundary").join(F.broadcast(bounds))
    return _with_dropped(out, everything)


def detector_scores(t):
    """Four score columns per vector, a 0/1 label and a split by parity."""
    e = t("embeddings")
    wide = e.select(
        "vec_id", (F.col("label") % 2).alias("label"),
        F.when(F.col("vec_id") % 2 == 0, "calibration").otherwise("test").alias("split"),
        *[(F.get("embedding", F.lit(i)).cast("double") + 1.0).alias(f"score_{i + 1}") for i in range(4)],
    )
    return wide.unpivot(
        ["vec_id", "label", "split"], [f"score_{i + 1}" for i in range(4)], "score_name", "score"
    )


_DETECTOR_SQL = """
wide AS (SELECT vec_id, label % 2 AS label, CASE WHEN vec_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split,
  embedding[1]::DOUBLE + 1.0 AS score_1, embedding[2]::DOUBLE + 1.0 AS score_2, embedding[3]::DOUBLE + 1.0 AS score_3,
  embedding[4]::DOUBLE + 1.0 AS score_4 FROM embeddings),
long AS (UNPIVOT wide ON score_1, score_2, score_3, score_4 INTO NAME score_name VALUE score),
lowest AS (SELECT score_name, min(score) AS neg FROM long WHERE label = 0 AND split = 'calibration' GROUP BY score_name),
thr AS (SELECT l.score_name, coalesce((max(score) + any_value(neg)) / 2, any_value(neg) / 2) AS threshold
  FROM lowest l LEFT JOIN long s ON s.score_name = l.score_name AND s.label = 1 AND s.split = 'calibration' AND s.score < l.neg GROUP BY l.score_name)"""


def detector_thresholds(t):
    return kw.zero_false_accept_threshold(detector_scores(t).where("split = 'calibration'"))


@query("detector_threshold", with_ctes(_DETECTOR_SQL, "SELECT score_name, round(threshold, 6) AS threshold FROM thr"))
def detector_threshold(t):
    return ad.rounded(detector_thresholds(t))


@query(
    "detector_eval",
    with_ctes(
        _DETECTOR_SQL,
        """SELECT score_name, split, round(threshold, 6) AS threshold, count(*) FILTER (label = 1 AND score < threshold) AS detected,
          count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0 AND score < threshold) AS false_accepts,
          count(*) FILTER (label = 0) AS negatives FROM long JOIN thr USING (score_name) GROUP BY score_name, split, threshold""",
    ),
)
def detector_eval(t):
    return ad.rounded(kw.detector_evaluation(detector_scores(t), detector_thresholds(t)))


@query(
    "detector_errors",
    with_ctes(
        _DETECTOR_SQL,
        """SELECT score_name, split, vec_id, CASE WHEN label = 1 THEN 'missed' ELSE 'false_accept' END AS kind
        FROM long JOIN thr USING (score_name) WHERE (label = 1 AND score >= threshold) OR (label = 0 AND score < threshold)""",
    ),
)
def detector_errors(t):
    return kw.detector_errors(detector_scores(t), detector_thresholds(t)).select("score_name", "split", "vec_id", "kind")


KEYWORDS = {"first": [3, 7, 12], "second": [5, 5], "third": [9, 1, 20, 4]}


@query(
    "keyword_spot",
    with_ctes(
        ad.SQL_SCORED,
        """words AS (SELECT * FROM (VALUES ('first', [0,3,0,7,0,12,0]), ('second', [0,5,0,5,0]), ('third', [0,9,0,1,0,20,0,4,0])) w(keyword, path)),
        align AS (
          SELECT f.utt_id, w.keyword, w.path, -1::BIGINT AS frame, list_transform(w.path, lambda x: 'inf'::DOUBLE) AS prev, 'inf'::DOUBLE AS best
          FROM (SELECT DISTINCT utt_id FROM raw_frames) f, words w
          UNION ALL
          SELECT utt_id, keyword, path, frame_idx, cur, least(best, cur[len(path)], cur[len(path) - 1])
          FROM (SELECT a.*, r.frame_idx, list_transform(range(1, len(path) + 1), lambda s:
              least(a.prev[s], CASE WHEN s > 1 THEN a.prev[s - 1] ELSE 'inf'::DOUBLE END,
                CASE WHEN s > 2 AND path[s] <> 0 AND path[s] <> path[s - 2] THEN a.prev[s - 2] ELSE 'inf'::DOUBLE END,
                CASE WHEN s <= 2 THEN 0.0 ELSE 'inf'::DOUBLE END) + list_max(r.logits) - r.logits[path[s] + 1]) AS cur
            FROM align a JOIN raw_frames r ON r.utt_id = a.utt_id AND r.model = 'bg' AND r.frame_idx = a.frame + 1)),
        scores AS (SELECT utt_id, keyword, min(best) / ((any_value(len(path)) - 1) / 2) AS score FROM align GROUP BY utt_id, keyword)""",
        """SELECT utt_id, arg_min(keyword, score) AS keyword, round(min(score), 6) AS score, min(score) < 2.08 AS detected FROM scores GROUP BY utt_id""",
    ),
)
def keyword_spot(t):
    frames = ad.frames(t).where("model = 'bg'")
    # Small chunks, so that an utterance is several of them.
    return ad.rounded(kw.best_keyword(kw.keyword_scores(frames, KEYWORDS, chunk_frames=3)))
