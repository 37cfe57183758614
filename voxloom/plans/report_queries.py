"""Accuracy, coverage, word-error, throughput and distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.operators import evaluate as va
from voxloom.operators import evidence as ev
from voxloom.plans import adapters as ad
from voxloom.plans.evidence_queries import (
    SQL_ROUTE, SQL_SIGN, SQL_TRUTH, _TRACK, evidence, track, truth,
)
from voxloom.plans.registry import query, with_ctes

COVERAGE_SQL = """
  count(*) AS total, count(*) FILTER (r <> 'MIXED') AS direct_total,
  count(*) FILTER (r <> 'MIXED' AND r = t) AS direct_correct,
  count(*) FILTER (r <> 'MIXED' AND r <> t) AS direct_wrong, count(*) FILTER (r = 'MIXED') AS mixed,
  count(*) FILTER (t = 'BG' AND r <> 'MIXED') AS bg_direct,
  count(*) FILTER (t = 'BG' AND r = 'BG') AS bg_correct, count(*) FILTER (t = 'BG' AND r = 'EN') AS bg_wrong,
  count(*) FILTER (t = 'BG' AND r = 'MIXED') AS bg_mixed,
  count(*) FILTER (t = 'EN' AND r <> 'MIXED') AS en_direct,
  count(*) FILTER (t = 'EN' AND r = 'EN') AS en_correct, count(*) FILTER (t = 'EN' AND r = 'BG') AS en_wrong,
  count(*) FILTER (t = 'EN' AND r = 'MIXED') AS en_mixed,
  round(count(*) FILTER (r <> 'MIXED') / count(*)::DOUBLE, 6) AS coverage,
  round(coalesce(count(*) FILTER (r <> 'MIXED' AND r = t) / nullif(count(*) FILTER (r <> 'MIXED'), 0)::DOUBLE, 0.0), 6) AS direct_accuracy,
  round(coalesce(count(*) FILTER (t = 'BG' AND r = 'BG') / nullif(count(*) FILTER (t = 'BG' AND r <> 'MIXED'), 0)::DOUBLE, 1.0), 6) AS bg_direct_accuracy,
  round(coalesce(count(*) FILTER (t = 'EN' AND r = 'EN') / nullif(count(*) FILTER (t = 'EN' AND r <> 'MIXED'), 0)::DOUBLE, 1.0), 6) AS en_direct_accuracy"""


def routed(t):
    e = evidence(t)
    return e.select(
        "utt_id",
        "entropy_delta",
        truth(F.col("utt_id")).alias("truth"),
        ev.route_by_boundaries(F.col("entropy_delta")).alias("route"),
        ev.route_by_sign(F.col("entropy_delta")).alias("sign"),
        track(F.col("utt_id")).alias("track"),
    )


SQL_ROUTED = ad.SQL_EVIDENCE + f""",
routed AS (SELECT utt_id, entropy_delta, {SQL_TRUTH} AS t, upper({SQL_ROUTE}) AS r, {SQL_SIGN} AS s,
  {_TRACK} AS track FROM evidence)"""


@query("coverage_eval", with_ctes(SQL_ROUTED, f"SELECT {COVERAGE_SQL} FROM routed"))
def coverage_eval(t):
    return ad.rounded(va.coverage_report(routed(t), "truth", "route"))


@query(
    "fixed_rule_check",
    with_ctes(
        SQL_ROUTED,
        """SELECT t AS truth, count(*) AS total, count(*) FILTER (r <> 'MIXED') AS direct,
        count(*) FILTER (r = t) AS correct, count(*) FILTER (r = 'MIXED') AS mixed,
        CASE WHEN count(*) <> 20 THEN 'expected_20_samples' END AS violation FROM routed GROUP BY t""",
    ),
)
def fixed_rule_check(t):
    r = F.upper("route")
    return routed(t).groupBy("truth").agg(
        F.count("*").alias("total"),
        F.count_if(r != "MIXED").alias("direct"),
        F.count_if(r == F.col("truth")).alias("correct"),
        F.count_if(r == "MIXED").alias("mixed"),
        F.when(F.count("*") != 20, "expected_20_samples").alias("violation"),
    )


@query(
    "confusion",
    with_ctes(
        SQL_ROUTED,
        """SELECT count(*) FILTER (t = 'BG' AND s = 'BG') AS bg_ok, count(*) FILTER (t = 'BG' AND s <> 'BG') AS bg_wrong,
        count(*) FILTER (t = 'EN' AND s = 'EN') AS en_ok, count(*) FILTER (t = 'EN' AND s <> 'EN') AS en_wrong,
        count(*) FILTER (t NOT IN ('BG','EN')) AS unexpected FROM routed""",
    ),
)
def confusion(t):
    return va.confusion_counts(routed(t), "truth", "sign")


@query(
    "accuracy_rollup",
    with_ctes(
        SQL_ROUTED,
        """SELECT t AS truth, count(*) FILTER (t = s) AS correct, count(*) AS total,
        round(count(*) FILTER (t = s) / count(*)::DOUBLE, 6) AS accuracy FROM routed GROUP BY ROLLUP (t)""",
    ),
)
def accuracy_rollup(t):
    return ad.rounded(va.accuracy_rollup(routed(t), "truth", "sign"))


@query(
    "route_crosstab",
    with_ctes(
        SQL_ROUTED,
        """SELECT track, count(*) AS total, count(*) FILTER (s = 'BG') AS n_bg, count(*) FILTER (s = 'EN') AS n_en,
        count(*) FILTER (s = 'AMBIGUOUS') AS n_ambiguous,
        CASE WHEN track <> 'MIXED' THEN round(count(*) FILTER (s = track) / count(*)::DOUBLE, 6) END AS accuracy
        FROM routed GROUP BY track""",
    ),
)
def route_crosstab(t):
    return ad.rounded(va.route_crosstab(routed(t), "track", "sign", ("BG", "EN", "AMBIGUOUS")))


@query(
    "class_separation",
    with_ctes(
        SQL_ROUTED,
        """SELECT round(a, 6) AS low_max, round(b, 6) AS high_min, a < b AS separated,
        CASE WHEN a < b THEN round(b - a, 6) END AS gap, CASE WHEN a < b THEN round((a + b) / 2, 6) END AS midpoint,
        CASE WHEN a >= b THEN round(a - b, 6) END AS overlap
        FROM (SELECT max(entropy_delta) FILTER (t = 'BG') AS a, min(entropy_delta) FILTER (t = 'EN') AS b FROM routed)""",
    ),
)
def class_separation(t):
    return ad.rounded(va.class_separation(routed(t), "truth", "entropy_delta"))


@query(
    "closest_boundary",
    with_ctes(
        SQL_ROUTED,
        """SELECT utt_id, t AS truth, s AS sign, round(entropy_delta, 6) AS entropy_delta FROM routed
        ORDER BY abs(entropy_delta), utt_id LIMIT 10""",
    ),
)
def closest_boundary(t):
    top = routed(t).orderBy(F.abs("entropy_delta"), "utt_id").limit(10)
    return ad.rounded(top.select("utt_id", "truth", "sign", "entropy_delta"))


@query(
    "misrouted",
    with_ctes(
        SQL_ROUTED,
        """SELECT utt_id, t AS truth, r AS route, CASE WHEN r = 'MIXED' THEN 'mixed' ELSE 'misrouted' END AS kind,
        round(entropy_delta, 6) AS entropy_delta FROM routed WHERE r = 'MIXED' OR r <> t""",
    ),
)
def misrouted(t):
    r = F.upper("route")
    return ad.rounded(
        routed(t).where((r == "MIXED") | (r != F.col("truth"))).select(
            "utt_id", "truth", r.alias("route"),
            F.when(r == "MIXED", "mixed").otherwise("misrouted").alias("kind"), "entropy_delta",
        )
    )


@query(
    "distribution",
    """
    SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
      round(avg(l_extendedprice), 4) AS mean_value, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75
    FROM lineitem GROUP BY l_returnflag
    """,
)
def distribution(t):
    return ad.rounded(va.distribution(t("lineitem"), ["l_returnflag"], "l_extendedprice"), 4)


@query(
    "feature_rank",
    with_ctes(
        ad.SQL_FEATURES,
        """SELECT feature, round(a, 6) AS low_median, round(b, 6) AS high_median, round(a - b, 6) AS difference,
        CASE WHEN sigma > 0 THEN round(abs(a - b) / sigma, 6) ELSE 0.0 END AS score
        FROM (SELECT feature, median(value) FILTER (label = 'BG') AS a, median(value) FILTER (label = 'EN') AS b,
          stddev_pop(value) AS sigma FROM long GROUP BY feature)""",
    ),
)
def feature_rank(t):
    return ad.rounded(va.feature_ranking(ad.feature_long(t)))


@query(
    "feature_unpivot",
    with_ctes(ad.SQL_FEATURES, "SELECT sample_id, label, prompt, feature, round(value, 6) AS value FROM long"),
)
def feature_unpivot(t):
    return ad.rounded(ad.long_features(ad.labelled_features(t)))


@query("lang_histogram", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_histogram(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "throughput_rtf",
    """
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity / 10), 4) AS processing_total,
      round(sum(l_extendedprice / 1000), 4) AS audio_total, round(sum(l_quantity / 10) / count(*), 6) AS processing_avg,
      round(sum(l_quantity / 10) / sum(l_extendedprice / 1000), 6) AS rtf
    FROM lineitem GROUP BY ROLLUP (l_returnflag)
    """,
)
def throughput_rtf(t):
    out = va.throughput(
        t("lineitem"), "l_returnflag", F.col("l_quantity") / 10, F.col("l_extendedprice") / 1000
    )
    return out.select(
        "l_returnflag", "n", F.round("processing_total", 4).alias("processing_total"),
        F.round("audio_total", 4).alias("audio_total"), F.round("processing_avg", 6).alias("processing_avg"),
        F.round("rtf", 6).alias("rtf"),
    )


@query(
    "throughput_by_category",
    """
    SELECT l_linestatus, count(*) AS n, round(sum(p), 4) AS processing_total, round(sum(a), 4) AS audio_total,
      round(avg(CASE WHEN a > 0 THEN p / a ELSE 0 END), 6) AS mean_row_rtf, count(*) FILTER (a <= 0) AS no_audio,
      round(CASE WHEN sum(a) > 0 THEN sum(p) / sum(a) ELSE 0 END, 6) AS rtf
    FROM (SELECT l_linestatus, l_quantity / 10 AS p,
            CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice / 1000 END AS a FROM lineitem)
    GROUP BY l_linestatus
    """,
)
def throughput_by_category(t):
    audio = F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(F.col("l_extendedprice") / 1000)
    out = va.throughput_by_category(t("lineitem"), "l_linestatus", F.col("l_quantity") / 10, audio)
    return out.select(
        "l_linestatus", "n", F.round("processing_total", 4).alias("processing_total"),
        F.round("audio_total", 4).alias("audio_total"), F.round("mean_row_rtf", 6).alias("mean_row_rtf"),
        "no_audio", F.round("rtf", 6).alias("rtf"),
    )


@query(
    "length_stats",
    """
    SELECT lang, count(*) AS n, min(n_chars) AS min_len, max(n_chars) AS max_len, round(avg(n_chars), 6) AS mean_len,
      sum(n_chars)::BIGINT AS total_len FROM documents GROUP BY lang
    """,
)
def length_stats(t):
    return ad.rounded(
        t("documents").groupBy("lang").agg(
            F.count("*").alias("n"), F.min("n_chars").alias("min_len"), F.max("n_chars").alias("max_len"),
            F.avg("n_chars").alias("mean_len"), F.sum("n_chars").alias("total_len"),
        )
    )


def scored_pairs(t):
    return va.score_words(ad.transcript_pairs(t), "reference_text", "text")


SQL_WER = ad.SQL_PAIRS + "," + ad.sql_word_errors("pairs")


@query(
    "wer_pairs",
    with_ctes(SQL_WER, "SELECT prompt_id, reference_words, errors, round(wer, 6) AS wer, status FROM scored_pairs"),
)
def wer_pairs(t):
    return ad.rounded(scored_pairs(t).select("prompt_id", "reference_words", "errors", "wer", "status"))


@query(
    "wer_report",
    with_ctes(
        SQL_WER,
        """SELECT speech_label, count(*) AS n, sum(errors)::BIGINT AS errors, sum(reference_words)::BIGINT AS reference_words,
        round(avg(wer), 6) AS macro_wer, round(max(wer), 6) AS max_wer, count(*) FILTER (errors = 0) AS exact,
        round(sum(errors) / sum(reference_words)::DOUBLE, 6) AS corpus_wer
        FROM scored_pairs JOIN pairs USING (prompt_id) WHERE status = 'ok' GROUP BY ROLLUP (speech_label)""",
    ),
)
def wer_report(t):
    return ad.rounded(va.word_error_report(scored_pairs(t), "speech_label"))


@query(
    "wer_tokens",
    f"""SELECT conv_id, turn, len(w)::BIGINT AS n_words, array_to_string(w, ' ') AS words
    FROM (SELECT conv_id, turn, {ad.sql_words('text')} AS w FROM conversations)""",
)
def wer_tokens(t):
    return t("conversations").select("conv_id", "turn", tx.wer_words(F.col("text")).alias("w")).select(
        "conv_id", "turn", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words")
    )


_SAID = """
said AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Aurora,  ' || text WHEN 1 THEN ' АУРОРА! ' || text
  WHEN 2 THEN 'Aurora’s ' || text ELSE text END AS text FROM conversations)"""


@query(
    "norm_review",
    with_ctes(
        _SAID,
        rf"""SELECT conv_id, turn, norm, regexp_replace(norm, '^(аурора|aurora)(\s*[,!:]\s*|\s+|$)', '') AS command_text
        FROM (SELECT conv_id, turn, {ad.sql_review_normalise('text')} AS norm FROM said)""",
    ),
)
def norm_review(t):
    from voxloom.operators.commands import strip_wake

    k = F.col("conv_id") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("Aurora,  "), "text")).when(k == 1, F.concat(F.lit(" АУРОРА! "), "text"))
        .when(k == 2, F.concat(F.lit("Aurora’s "), "text")).otherwise(F.col("text"))
    )
    return t("conversations").select("conv_id", "turn", tx.review_normalise(said).alias("norm")).select(
        "conv_id", "turn", "norm", strip_wake(F.col("norm")).alias("command_text")
    )


@query(
    "segment_join",
    with_ctes(
        """seg AS (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '   ' ELSE '  ' || text || chr(10) END AS text
        FROM conversations)""",
        f"""SELECT conv_id, coalesce(string_agg(trim(text, chr(10) || ' '), ' ' ORDER BY turn)
          FILTER (trim(text, chr(10) || ' ') <> ''), '') AS text FROM seg GROUP BY conv_id""",
    ),
)
def segment_join(t):
    from voxloom.operators.transcripts import join_segments

    padded = F.when(F.col("turn") % 3 == 2, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    )
    return join_segments(
        t("conversations").select("conv_id", "turn", padded.alias("text")), "conv_id", "turn", "text"
    )
