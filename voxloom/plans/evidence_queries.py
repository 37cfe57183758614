"""Evidence, routing and report queries over frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.operators import evidence as ev
from voxloom.plans import adapters as ad
from voxloom.plans.registry import Tables, query, with_ctes


def _r(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def evidence(t: Tables) -> DataFrame:
    return ev.paired_evidence(ad.scored_frames(t))


def truth(utt):
    """Synthetic ground truth: even utterances BG, odd EN."""
    return F.when(utt % 2 == 0, "BG").otherwise("EN")


SQL_TRUTH = "CASE WHEN utt_id % 2 = 0 THEN 'BG' ELSE 'EN' END"
SQL_ROUTE = "CASE WHEN entropy_delta <= 0.003 THEN 'bg' WHEN entropy_delta >= 0.043 THEN 'en' ELSE 'mixed' END"
SQL_SIGN = "CASE WHEN entropy_delta < 0 THEN 'BG' WHEN entropy_delta > 0 THEN 'EN' ELSE 'AMBIGUOUS' END"


@query("ctc_metrics", with_ctes(ad.SQL_METRICS, f"SELECT utt_id, model, {_r(ev.METRICS)} FROM metrics"))
def ctc_metrics(t):
    return ad.rounded(ev.utterance_metrics(ad.scored_frames(t)))


@query("evidence_delta", with_ctes(ad.SQL_EVIDENCE, f"SELECT utt_id, {_r(ev.DELTAS)} FROM evidence"))
def evidence_delta(t):
    return ad.rounded(evidence(t).select("utt_id", *ev.DELTAS))


_WIDE = [f"{m}_{n}" for m in ("bg", "en") for n in ev.METRICS] + ["entropy_delta"]


@query(
    "evidence_wide",
    with_ctes(
        ad.SQL_EVIDENCE,
        f"SELECT utt_id, {SQL_TRUTH} AS ground_truth, {SQL_SIGN} AS current_prediction, "
        f"{SQL_TRUTH} = {SQL_SIGN} AS current_correct, {_r(_WIDE)} FROM evidence",
    ),
)
def evidence_wide(t):
    pred = ev.route_by_sign(F.col("entropy_delta"))
    return ad.rounded(
        evidence(t).select(
            "utt_id",
            truth(F.col("utt_id")).alias("ground_truth"),
            pred.alias("current_prediction"),
            (truth(F.col("utt_id")) == pred).alias("current_correct"),
            *_WIDE,
        )
    )


@query(
    "route_two_boundary",
    with_ctes(
        ad.SQL_EVIDENCE,
        f"""SELECT utt_id, {SQL_ROUTE} AS route,
        CASE {SQL_ROUTE} WHEN 'bg' THEN 'ctc_bulgarian_evidence' WHEN 'en' THEN 'ctc_english_evidence'
          ELSE 'ctc_ambiguous_evidence' END AS reason,
        CASE WHEN {SQL_ROUTE} = 'mixed' THEN NULL ELSE {SQL_ROUTE} END AS detected_language
        FROM evidence""",
    ),
)
def route_two_boundary(t):
    route = ev.route_by_boundaries(F.col("entropy_delta"))
    return evidence(t).select("utt_id", route.alias("route")).select(
        "utt_id",
        "route",
        ev.route_reason(F.col("route")).alias("reason"),
        F.when(F.col("route") != "mixed", F.col("route")).alias("detected_language"),
    )


@query("route_sign", with_ctes(ad.SQL_EVIDENCE, f"SELECT utt_id, {SQL_SIGN} AS route FROM evidence"))
def route_sign(t):
    return evidence(t).select("utt_id", ev.route_by_sign(F.col("entropy_delta")).alias("route"))


@query(
    "route_detected_lang",
    """
    SELECT doc_id, language, CASE WHEN language = 'en' THEN 'en' ELSE 'bg' END AS mode,
      CASE WHEN language = 'en' THEN 'english_detected' WHEN language = 'bg' THEN 'bulgarian_detected'
        WHEN language IN ('ru','uk','be','mk','sr','hr','bs','sl','cs','sk','pl')
        THEN 'bulgarian_family_fallback' ELSE 'unknown_fallback' END AS reason,
      confidence
    FROM (SELECT doc_id, nullif(lower(trim(code)), '') AS language,
                 round((doc_id % 101) / 100.0, 6)::DOUBLE AS confidence
          FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' ' || upper(lang) || ' ' WHEN 1 THEN 'bg'
                  WHEN 2 THEN 'MK' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE lang END AS code
                FROM documents))
    """,
)
def route_detected_lang(t):
    k = F.col("doc_id") % 6
    code = (
        F.when(k == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
        .when(k == 1, "bg").when(k == 2, "MK").when(k == 3, "  ")
        .when(k == 4, F.lit(None)).otherwise(F.col("lang"))
    )
    docs = t("documents").select("doc_id", code.alias("code"))
    return ev.resolve_detected(docs, "code", F.round((F.col("doc_id") % 101) / 100.0, 6)).select(
        "doc_id", "language", "mode", "reason", "confidence"
    )


@query(
    "engine_routing",
    """
    SELECT doc_id, mode,
      CASE mode WHEN 'bg' THEN 'bulgarian' WHEN 'en' THEN 'english' WHEN 'mixed' THEN 'mixed' END AS engine,
      CASE WHEN mode IN ('bg','en') THEN mode END AS language_arg,
      CASE WHEN mode = 'auto' THEN 'auto_mode_must_be_resolved'
           WHEN mode IS NULL OR mode NOT IN ('bg','en','mixed') THEN 'unsupported_mode' END AS error
    FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'bg' WHEN 'de' THEN 'mixed'
            ELSE CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'other' END END AS mode
          FROM documents)
    """,
)
def engine_routing(t):
    mode = (
        F.when(F.col("lang") == "en", "en").when(F.col("lang") == "fr", "bg")
        .when(F.col("lang") == "de", "mixed").when(F.col("doc_id") % 3 == 0, "auto")
        .when(F.col("doc_id") % 3 == 1, "other")
    )
    return ev.route_engine(t("documents").select("doc_id", mode.alias("mode")))


_POLICY_SQL = """
policy AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'bg' WHEN 1 THEN 'en' WHEN 2 THEN 'mixed' ELSE 'auto' END AS mode,
    CASE c_nationkey % 6 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['bg',' EN '] WHEN 2 THEN ['bg','BG']
      WHEN 3 THEN ['en',' '] WHEN 4 THEN ['en'] ELSE ['bg'] END AS allowed
  FROM customer),
norm AS (SELECT *, list_transform(allowed, lambda c: lower(trim(c))) AS codes FROM policy)"""


@query(
    "policy_validate",
    with_ctes(
        _POLICY_SQL,
        """SELECT c_custkey, mode, CASE WHEN len(allowed) = 0 THEN 'empty_languages'
          WHEN list_contains(codes, '') THEN 'blank_language'
          WHEN len(list_distinct(codes)) <> len(codes) THEN 'duplicate_language'
          WHEN mode = 'bg' AND NOT list_contains(codes, 'bg') THEN 'bg_required'
          WHEN mode = 'en' AND NOT list_contains(codes, 'en') THEN 'en_required'
          WHEN mode = 'mixed' AND NOT list_has_all(codes, ['bg','en']) THEN 'bg_and_en_required' END AS violation
        FROM norm""",
    ),
)
def policy_validate(t):
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey") % 6

    def arr(*v):
        return F.array(*[F.lit(x) for x in v]).cast("array<string>")

    allowed = (
        F.when(n == 0, arr()).when(n == 1, arr("bg", " EN ")).when(n == 2, arr("bg", "BG"))
        .when(n == 3, arr("en", " ")).when(n == 4, arr("en")).otherwise(arr("bg"))
    )
    mode = F.when(k == 0, "bg").when(k == 1, "en").when(k == 2, "mixed").otherwise("auto")
    rows = t("customer").select("c_custkey", mode.alias("mode"), allowed.alias("allowed"))
    return rows.select(
        "c_custkey", "mode", ev.policy_violation(F.col("mode"), F.col("allowed")).alias("violation")
    )


_SEGMENT_SQL = ad.SQL_SCORED + """,
lengths AS (SELECT utt_id, model, count(*) AS n FROM scored GROUP BY utt_id, model),
bounds AS (
  SELECT utt_id, model, k AS segment, (k * n) // 16 AS s,
         greatest(((k + 1) * n) // 16, (k * n) // 16 + 1) AS e
  FROM lengths, range(16) r(k)),
segs AS (
  SELECT b.utt_id, b.model, b.segment,
    coalesce(avg(max_p) FILTER (non_blank), 0.0) AS confidence,
    coalesce(avg(entropy) FILTER (non_blank), 1.0) AS entropy,
    coalesce(avg(CASE WHEN max_p < 0.70 THEN 1.0 ELSE 0.0 END) FILTER (non_blank), 1.0) AS uncertain,
    avg(CASE WHEN non_blank THEN 1.0 ELSE 0.0 END) AS token_rate,
    count(*) FILTER (non_blank) AS non_blank_count, count(*) AS frame_count
  FROM bounds b JOIN scored f ON f.utt_id = b.utt_id AND f.model = b.model
    AND f.frame_idx >= b.s AND f.frame_idx < b.e
  GROUP BY b.utt_id, b.model, b.segment)"""


@query(
    "segment_metrics",
    with_ctes(
        _SEGMENT_SQL,
        f"""SELECT utt_id, model, segment::BIGINT AS segment, {_r(["confidence", "entropy", "uncertain", "token_rate"])},
        non_blank_count, frame_count FROM segs""",
    ),
)
def segment_metrics(t):
    return ad.rounded(
        ev.segment_metrics(ad.scored_frames(t)).withColumn("segment", F.col("segment").cast("long"))
    )


@query(
    "segment_timeline",
    with_ctes(
        _SEGMENT_SQL + """,
        votes AS (SELECT b.utt_id, b.segment,
          CASE WHEN b.non_blank_count = 0 AND e.non_blank_count = 0 THEN '.'
               WHEN b.confidence > e.confidence AND b.entropy < e.entropy THEN 'B'
               WHEN b.confidence < e.confidence AND b.entropy > e.entropy THEN 'E' ELSE '?' END AS symbol
          FROM segs b JOIN segs e ON b.utt_id = e.utt_id AND b.segment = e.segment
            AND b.model = 'bg' AND e.model = 'en')""",
        "SELECT utt_id, string_agg(symbol, '' ORDER BY segment) AS timeline FROM votes GROUP BY utt_id",
    ),
)
def segment_timeline(t):
    return ev.evidence_timeline(ev.segment_metrics(ad.scored_frames(t)))


_TRACK = "CASE WHEN utt_id % 10 < 4 THEN 'BG' WHEN utt_id % 10 < 8 THEN 'EN' ELSE 'MIXED' END"


def track(utt):
    k = utt % 10
    return F.when(k < 4, "BG").when(k < 8, "EN").otherwise("MIXED")


@query(
    "metric_averages",
    with_ctes(
        ad.SQL_METRICS + """,
        all_frames AS (SELECT utt_id, model, avg(entropy) AS mean_entropy FROM scored GROUP BY utt_id, model),
        wide AS (SELECT m.*, a.mean_entropy FROM metrics m JOIN all_frames a USING (utt_id, model)),
        long AS (UNPIVOT wide ON mean_non_blank_confidence, min_non_blank_confidence, non_blank_entropy,
          uncertain_non_blank_ratio, blank_prediction_ratio, mean_blank_probability, non_blank_token_rate,
          mean_entropy INTO NAME metric VALUE value)""",
        f"SELECT {_TRACK} AS track, model, metric, round(avg(value), 6) AS mean_value, count(*) AS n FROM long GROUP BY ALL",
    ),
)
def metric_averages(t):
    scored = ad.scored_frames(t)
    cols = ev._metric_columns() | {"mean_entropy": F.avg("entropy")}
    wide = scored.groupBy("utt_id", "model").agg(*[c.alias(n) for n, c in cols.items()])
    long = ev.unpivot(
        wide.withColumn("track", track(F.col("utt_id"))), ["track", "model"], list(cols), "metric", "value"
    )
    return ad.rounded(
        long.groupBy("track", "model", "metric").agg(
            F.avg("value").alias("mean_value"), F.count("*").alias("n")
        )
    )


@query(
    "group_deltas",
    with_ctes(
        ad.SQL_EVIDENCE + f""",
        d AS (SELECT utt_id, {", ".join(ev.DELTAS)} FROM evidence),
        long AS (UNPIVOT d ON {", ".join(ev.DELTAS)} INTO NAME delta VALUE value)""",
        f"""SELECT {_TRACK} AS track, delta, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value,
        round(max(value), 6) AS max_value FROM long GROUP BY ALL""",
    ),
)
def group_deltas(t):
    long = ev.unpivot(
        evidence(t).withColumn("track", track(F.col("utt_id"))), ["track"], list(ev.DELTAS), "delta", "value"
    )
    return ad.rounded(
        long.groupBy("track", "delta").agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
    )


@query(
    "pair_margin",
    """
    SELECT vec_id, round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 6) AS margin,
      CASE WHEN embedding[1] > embedding[2] THEN 'first' ELSE 'second' END AS pair_pred,
      (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS top1
    FROM embeddings
    """,
)
def pair_margin(t):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    cols = ev.pair_margin(F.col("scores"))
    return ad.rounded(
        t("embeddings").select("vec_id", scores.alias("scores"))
        .select("vec_id", *[c.alias(n) for n, c in cols.items()])
    )


@query(
    "array_rms",
    """
    SELECT vec_id, round(coalesce(sqrt(list_avg(list_transform(s, lambda v: v * v))), 0.0), 6) AS rms,
      round(coalesce(list_max(list_transform(s, lambda v: abs(v))), 0.0), 6) AS peak
    FROM (SELECT vec_id, CASE WHEN vec_id % 97 = 5 THEN []::DOUBLE[]
            ELSE list_transform(embedding, lambda v: v::DOUBLE) END AS s FROM embeddings)
    """,
)
def array_rms(t):
    from voxloom.functions.arrays import peak, rms

    samples = F.when(
        F.col("vec_id") % 97 == 5, F.array().cast("array<double>")
    ).otherwise(F.transform("embedding", lambda v: v.cast("double")))
    return ad.rounded(
        t("embeddings").select("vec_id", samples.alias("s"))
        .select("vec_id", rms(F.col("s")).alias("rms"), peak(F.col("s")).alias("peak"))
    )
