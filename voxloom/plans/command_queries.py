"""Command extraction, candidate reconciliation and review replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import commands as cm
from voxloom.operators import evidence as ev
from voxloom.operators import journal as jn
from voxloom.plans import adapters as ad
from voxloom.plans.evidence_queries import evidence
from voxloom.plans.registry import query, with_ctes
from voxloom.session import materialise
from voxloom.sources import sinks


_REPLAY = ("prompt_id", "sources", "status", "reason", "command_key")


@query(
    "command_extract",
    with_ctes(ad.SQL_COMMANDS, ad.sql_parse("commands", "event_id"), "SELECT event_id, command_key, reason FROM parsed"),
)
def command_extract(t):
    return cm.extract_commands(ad.spoken_commands(t), "text").select("event_id", "command_key", "reason")


@query(
    "percent_lookup",
    with_ctes(
        """spoken AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 130)::VARCHAR
             WHEN 1 THEN (['двадесет','тридесет','сто','forty','ninety'])[event_id % 5 + 1]
               || (['',' и пет','-two',' seven',' и'])[(event_id // 5) % 5 + 1]
             ELSE (['one hundred','zero','нула','thirteen','4.5','-4',''])[event_id % 7 + 1] END AS w FROM events),
           units AS (SELECT * FROM (VALUES (1,'one','едно'),(2,'two','две'),(3,'three','три'),(4,'four','четири'),
             (5,'five','пет'),(6,'six','шест'),(7,'seven','седем'),(8,'eight','осем'),(9,'nine','девет')) u(v, en, bg)),
           tens AS (SELECT * FROM (VALUES (2,'twenty','двадесет'),(3,'thirty','тридесет'),(4,'forty','четиридесет'),
             (5,'fifty','петдесет'),(6,'sixty','шестдесет'),(7,'seventy','седемдесет'),(8,'eighty','осемдесет'),
             (9,'ninety','деветдесет')) t(v, en, bg)),
           forms AS (
             SELECT en AS w, v FROM units UNION ALL SELECT bg, v FROM units
             UNION ALL SELECT en, v * 10 FROM tens UNION ALL SELECT bg, v * 10 FROM tens
             UNION ALL SELECT tens.en || ' ' || units.en, tens.v * 10 + units.v FROM tens, units
             UNION ALL SELECT tens.bg || ' и ' || units.bg, tens.v * 10 + units.v FROM tens, units
             UNION ALL SELECT * FROM (VALUES ('zero',0),('нула',0),('one hundred',100),('сто',100),('thirteen',13)) z(w, v))""",
        """SELECT event_id, s.w AS spoken, CASE WHEN regexp_matches(s.w, '^[0-9]{1,3}$')
            THEN CASE WHEN s.w::INT <= 100 THEN s.w::INT END ELSE f.v END AS value
          FROM spoken s LEFT JOIN forms f ON f.w = replace(s.w, '-', ' ')""",
    ),
)
def percent_lookup(t):
    k = F.col("event_id")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    words = (
        F.when(k % 3 == 0, (k % 130).cast("string"))
        .when(
            k % 3 == 1,
            F.concat(
                pick(["двадесет", "тридесет", "сто", "forty", "ninety"], k % 5),
                pick(["", " и пет", "-two", " seven", " и"], F.floor(k / 5) % 5),
            ),
        )
        .otherwise(pick(["one hundred", "zero", "нула", "thirteen", "4.5", "-4", ""], k % 7))
    )
    return t("events").select("event_id", words.alias("spoken")).select(
        "event_id", "spoken", cm.percent_value(F.col("spoken")).alias("value")
    )


_CANDIDATES = """
cand AS (SELECT event_id // 2 AS utt_id, min(event_id) AS first_id, count(*) AS n_candidates,
    count(DISTINCT command_key) AS n_commands,
    bool_or(command_key IS NULL OR reason <> 'supported') AS bad FROM parsed GROUP BY event_id // 2),
reviewed AS (
  SELECT utt_id, n_candidates,
    CASE WHEN n_commands <= 1 AND NOT bad THEN 'parsed' ELSE 'needs_clarification' END AS status,
    CASE WHEN n_commands > 1 THEN 'conflicting_candidates' WHEN NOT bad THEN 'supported_single_command'
         WHEN n_candidates = 1 THEN p.reason ELSE 'unresolved_candidate' END AS reason,
    CASE WHEN n_commands <= 1 AND NOT bad THEN p.command_key END AS command_key, false AS can_execute
  FROM cand JOIN parsed p ON p.event_id = cand.first_id)"""


@query(
    "candidate_reconcile",
    with_ctes(ad.SQL_COMMANDS, ad.sql_parse("commands", "event_id"), _CANDIDATES, "SELECT * FROM reviewed"),
)
def candidate_reconcile(t):
    parsed = cm.extract_commands(ad.spoken_commands(t), "text").withColumn(
        "utt_id", F.floor(F.col("event_id") / 2)
    )
    return cm.reconcile_candidates(parsed, "utt_id", "event_id")


@query(
    "review_enrich",
    with_ctes(
        ad.SQL_EVIDENCE,
        f"said AS (SELECT utt_id, {ad.sql_template('utt_id', 'utt_id % 130')} AS text FROM evidence)",
        ad.sql_parse("said", "utt_id"),
        """SELECT p.utt_id, CASE WHEN entropy_delta <= 0.003 THEN 'bg' WHEN entropy_delta >= 0.043 THEN 'en' ELSE 'mixed' END AS route,
          round(entropy_delta, 6) AS entropy_delta, said.text,
          CASE WHEN command_key IS NOT NULL AND reason = 'supported' THEN 'parsed' ELSE 'needs_clarification' END AS review_status,
          CASE WHEN command_key IS NOT NULL AND reason = 'supported' THEN 'supported_single_command' ELSE reason END AS review_reason,
          CASE WHEN reason = 'supported' THEN command_key END AS review_command, false AS can_execute
        FROM parsed p JOIN evidence e USING (utt_id) JOIN said USING (utt_id)""",
    ),
)
def review_enrich(t):
    rows = evidence(t).select(
        "utt_id",
        ev.route_by_boundaries(F.col("entropy_delta")).alias("route"),
        "entropy_delta",
        ad.template_text(F.col("utt_id"), F.col("utt_id") % 130).alias("text"),
    )
    return ad.rounded(cm.review_rows(rows, "text"))


def _runs(t):
    """A baseline run over all events and two partial alternative runs.

    Every eleventh baseline id is another one, so its alternatives have none;
    a few cases of the baseline and of one alternative have failed.
    """
    e = t("events").select("event_id", "user_id")
    i = F.col("event_id")

    def run(shift, where, key=i, failed=F.lit(False)):
        return e.where(where).select(
            F.lit("case").alias("event"),
            key.alias("prompt_id"),
            F.when(failed, "error").otherwise("ok").alias("status"),
            ad.template_text(i + shift, i % 130).alias("text"),
            F.sha2(i.cast("string"), 256).alias("sha256"),
            F.col("user_id").cast("string").alias("attempt_id"),
            F.lit("ref").alias("reference_text"),
        )

    return (
        run(0, "true", F.when(i % 11 == 10, -i - 1).otherwise(i), i % 17 == 5),
        {"run_a": run(1, "event_id % 2 = 0", failed=i % 19 == 3), "run_b": run(0, "event_id % 5 = 0")},
    )


@query(
    "review_replay",
    with_ctes(
        f"""runs AS (
          SELECT event_id, CASE WHEN event_id % 11 = 10 THEN -event_id - 1 ELSE event_id END AS pid, 0 AS ord, event_id % 17 = 5 AS failed,
            {ad.sql_template('event_id', 'event_id % 130')} AS text FROM events
          UNION ALL SELECT event_id, event_id, 1, event_id % 19 = 3, {ad.sql_template('event_id + 1', 'event_id % 130')} FROM events WHERE event_id % 2 = 0
          UNION ALL SELECT event_id, event_id, 2, false, {ad.sql_template('event_id', 'event_id % 130')} FROM events WHERE event_id % 5 = 0),
        keyed AS (SELECT pid * 10 + ord AS cid, text FROM runs),
        spoiled AS (SELECT pid, bool_or(failed) AS failed FROM runs GROUP BY pid)""",
        ad.sql_parse("keyed", "cid"),
        """grouped AS (SELECT (cid - cid % 10 + CASE WHEN cid % 10 < 0 THEN -10 ELSE 0 END) // 10 AS gid, cid, command_key, reason,
            ((cid % 10) + 10) % 10 AS ord FROM parsed),
        groups AS (SELECT gid AS prompt_id, count(*) AS n, count(DISTINCT command_key) AS n_commands,
            bool_or(command_key IS NULL OR reason <> 'supported') AS bad, min(ord) AS first_ord,
            arg_min(reason, ord) AS first_reason, arg_min(command_key, ord) AS first_key,
            string_agg(CASE ord WHEN 1 THEN 'run_a' WHEN 2 THEN 'run_b' END, ',' ORDER BY ord) AS sources
          FROM grouped GROUP BY gid),
        judged AS (SELECT g.prompt_id, coalesce(sources, '') AS sources,
            CASE WHEN first_ord <> 0 OR failed THEN 'rejected' WHEN n_commands <= 1 AND NOT bad THEN 'parsed' ELSE 'needs_clarification' END AS status,
            CASE WHEN first_ord <> 0 AND failed THEN 'not_in_baseline,failed_case' WHEN first_ord <> 0 THEN 'not_in_baseline' WHEN failed THEN 'failed_case'
              WHEN n_commands > 1 THEN 'conflicting_candidates'
              WHEN NOT bad THEN 'supported_single_command' WHEN n = 1 THEN first_reason ELSE 'unresolved_candidate' END AS reason,
            CASE WHEN first_ord = 0 AND NOT failed AND n_commands <= 1 AND NOT bad THEN first_key END AS command_key
          FROM groups g JOIN spoiled s ON s.pid = g.prompt_id)""",
        f"""SELECT 'case' AS event, prompt_id, sources, status, reason, command_key, NULL::BIGINT AS completed, NULL::BIGINT AS failed, NULL::VARCHAR AS inputs_digest FROM judged
        UNION ALL SELECT 'start', NULL, NULL, NULL, NULL, NULL, NULL, NULL, {sinks.sql_rows_digest(_REPLAY)} FROM judged
        UNION ALL SELECT 'end', NULL, NULL, NULL, NULL, NULL, count(*) FILTER (status = 'ok'), count(*) FILTER (status <> 'ok'), NULL FROM judged""",
    ),
)
def review_replay(t):
    baseline, alternatives = _runs(t)
    runs = [jn.check_cases(r) for r in (baseline, *alternatives.values())]
    gathered = jn.gather_alternatives(baseline, alternatives)
    # Contract faults of any run's case: at most one name per kind and prompt.
    faults = runs[0].select("prompt_id", "violations")
    for run in runs[1:]:
        faults = faults.unionByName(run.select("prompt_id", "violations"))
    faults = faults.where(F.size("violations") > 0).groupBy("prompt_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("violations")))).alias("faults")
    )
    checked = gathered.join(faults, "prompt_id", "left").withColumn(
        "violations", F.concat("violations", F.coalesce("faults", F.array().cast("array<string>")))
    )
    candidates = checked.select(
        "prompt_id", F.posexplode(F.concat(F.array("text"), "texts")).alias("ord", "said"), "sources", "violations"
    ).where("said IS NOT NULL")
    reviews = cm.reconcile_candidates(
        cm.extract_commands(candidates, "said"), "prompt_id", "ord", keep=["sources", "violations"]
    )
    broken = F.size("violations") > 0
    judged = reviews.select(
        "prompt_id",
        F.array_join("sources", ",").alias("sources"),
        F.when(broken, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(broken, F.array_join("violations", ",")).otherwise(F.col("reason")).alias("reason"),
        F.when(~broken, F.col("command_key")).alias("command_key"),
    )
    return sinks.report_envelope(materialise(judged.select(*_REPLAY), "judged"), "status")


@query(
    "gather_alternatives",
    with_ctes(
        ad.SQL_PAIRS,
        """rows AS (
          SELECT CASE WHEN conv_id % 9 = 8 THEN 'x' || prompt_id ELSE prompt_id END AS prompt_id, 0 AS src, text, reference_text FROM pairs
          UNION ALL SELECT prompt_id, 1, text || ' again', reference_text FROM pairs WHERE conv_id % 2 = 0
          UNION ALL SELECT prompt_id, 1, text || ' again twice', 'zz' FROM pairs WHERE conv_id % 2 = 0 AND conv_id % 3 = 1
          UNION ALL SELECT prompt_id, 2, text, CASE WHEN conv_id % 7 = 0 THEN 'other' ELSE reference_text END FROM pairs WHERE conv_id % 3 = 0),
        picked AS (SELECT prompt_id, src, count(*) AS copies, min(text) AS text, arg_min(reference_text, text) AS reference_text FROM rows GROUP BY prompt_id, src)""",
        """SELECT prompt_id, coalesce(string_agg(CASE src WHEN 1 THEN 'upper' WHEN 2 THEN 'same' END, ',' ORDER BY src), '') AS sources,
          count(*) FILTER (src > 0) AS n_texts,
          coalesce(string_agg(text, ' / ' ORDER BY src) FILTER (src > 0), '') AS texts,
          array_to_string(list_filter([CASE WHEN count(*) FILTER (src = 0) = 0 THEN 'not_in_baseline'
               WHEN count(DISTINCT reference_text) > 1 THEN 'audio_mismatch' END,
             CASE WHEN max(copies) > 1 THEN 'duplicate_id' END], lambda v: v IS NOT NULL), ',') AS violations
        FROM picked GROUP BY prompt_id""",
    ),
)
def gather_alternatives(t):
    pairs = ad.transcript_pairs(t).select(
        "prompt_id", "conv_id", "text", "reference_text",
        F.sha2("prompt_id", 256).alias("sha256"), F.col("conv_id").cast("string").alias("attempt_id"),
    )
    again = pairs.where("conv_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" again")))
    twice = again.where("conv_id % 3 = 1").withColumns(
        {"text": F.concat("text", F.lit(" twice")), "reference_text": F.lit("zz")}
    )
    out = jn.gather_alternatives(
        pairs.withColumn(
            "prompt_id", F.when(F.col("conv_id") % 9 == 8, F.concat(F.lit("x"), "prompt_id")).otherwise(F.col("prompt_id"))
        ),
        {
            "upper": again.unionByName(twice),
            "same": pairs.where("conv_id % 3 = 0").withColumn(
                "reference_text", F.when(F.col("conv_id") % 7 == 0, "other").otherwise(F.col("reference_text"))
            ),
        },
    )
    return out.select(
        "prompt_id",
        F.array_join("sources", ",").alias("sources"),
        F.size("texts").cast("long").alias("n_texts"),
        F.array_join("texts", " / ").alias("texts"),
        F.array_join("violations", ",").alias("violations"),
    )
