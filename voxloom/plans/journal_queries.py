"""Scans, sinks, joins and data contracts over journals and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.text import keyword_normalise
from voxloom.operators import contracts as ct
from voxloom.operators import evaluate as va
from voxloom.operators import journal as jn
from voxloom.operators import keywords as kw
from voxloom.operators import transcripts as tr
from voxloom.operators.ordered import bucket_running, checked_broadcast
from voxloom.plans import adapters as ad
from voxloom.plans.registry import query, with_ctes
from voxloom.session import shared_dir, spread_small
from voxloom.sources import scans, sinks


def _listed(df, column="violations"):
    return df.withColumn(column, F.array_join(column, ","))


_FOLD_SQL = """
last_rows AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, event ORDER BY file DESC, line DESC) AS rn FROM journal),
a AS (SELECT * FROM last_rows WHERE event = 'attempt' AND rn = 1),
c AS (SELECT * FROM last_rows WHERE event = 'captured' AND rn = 1),
r AS (SELECT * FROM last_rows WHERE event = 'review' AND rn = 1 AND status = 'accepted'),
folded AS (
  SELECT r.attempt_id, a.prompt_id, a.speech_label, c.filename, c.sha256, r.reference_text,
    a.attempt_id IS NULL OR c.attempt_id IS NULL AS incomplete
  FROM r LEFT JOIN a ON a.attempt_id = r.attempt_id LEFT JOIN c ON c.attempt_id = r.attempt_id)"""


@query(
    "journal_fold",
    with_ctes(
        ad.SQL_JOURNAL, _FOLD_SQL,
        """SELECT attempt_id, prompt_id, speech_label, filename, sha256, reference_text,
          array_to_string(list_filter([CASE WHEN incomplete THEN 'incomplete_attempt' END,
            CASE WHEN trim(reference_text) = '' THEN 'missing_reference' END,
            CASE WHEN prompt_id IS NOT NULL AND count(*) OVER (PARTITION BY prompt_id) > 1 THEN 'several_accepted' END],
            lambda v: v IS NOT NULL), ',') AS violations FROM folded""",
    ),
)
def journal_fold(t):
    return _listed(jn.fold_journal(ad.journal(t)).drop("manifest"))


@query(
    "first_accepted",
    with_ctes(
        ad.SQL_JOURNAL,
        """running AS (
          SELECT *, last_value(CASE WHEN event = 'attempt' THEN prompt_id END IGNORE NULLS) OVER w AS p,
            last_value(CASE WHEN event = 'captured' THEN filename END IGNORE NULLS) OVER w AS audio
          FROM journal WINDOW w AS (PARTITION BY file, attempt_id ORDER BY line)),
        hits AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY file, line) AS rn FROM running
          WHERE event = 'review' AND status = 'accepted' AND p IS NOT NULL AND audio IS NOT NULL)""",
        "SELECT p AS prompt_id, attempt_id, audio AS filename, reference_text FROM hits WHERE rn = 1",
    ),
)
def first_accepted(t):
    # Small buckets, so that values are carried across many of them.
    return jn.first_accepted(ad.journal(t), lines_per_bucket=16)


@query(
    "journal_verified",
    """
    SELECT 'a' || doc_id AS attempt_id, 'P' || doc_id AS prompt_id,
      CASE WHEN doc_id % 7 = 2 THEN 'digest_mismatch' WHEN doc_id % 11 = 4 THEN 'missing_file'
        WHEN doc_id % 13 = 6 THEN 'outside_root' ELSE '' END AS violations
    FROM documents WHERE doc_id % 5 <> 1
    """,
)
def journal_verified(t):
    """A journal as JSON lines and its payload files, some altered, missing or
    outside; every fifth recording is rejected later in the file.

    A session, 256 recordings, has a folder of its own and its own names, and
    one event follows another in the file without a line number.
    """
    root = shared_dir(t.spark, "recordings")
    d = F.col("doc_id")
    # Files in Parquet stand for recordings: content is what a digest is of.
    content = t("documents").select(
        "doc_id", F.floor(d / 256).alias("session"), F.sha2("text", 256).alias("sha256"),
        F.sha2(F.when(d % 7 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"),
    )
    name = F.concat(F.when((d % 13 == 6) & (d % 7 != 2) & (d % 11 != 4), "../").otherwise(""), d % 256, F.lit(".wav"))
    one = content.select(
        "session",
        F.posexplode(F.array(
            _event("attempt", attempt_id=_tagged("a"), prompt_id=_tagged("P"), speech_label=F.lit("BG")),
            _event("captured", attempt_id=_tagged("a"), filename=name, sha256=F.col("sha256")),
            _event("review", attempt_id=_tagged("a"), status=F.lit("accepted"), reference_text=F.lit("said")),
            _event("review", attempt_id=_tagged("a"), reference_text=F.lit("said"),
                   status=F.when(d % 5 == 1, "rejected").otherwise("accepted")),
        )).alias("place", "value"), "doc_id",
    )
    one.repartition("session").sortWithinPartitions("session", "doc_id", "place").select("session", "value").write.partitionBy("session").text(root)
    journal = scans.read_journal(t.spark, root, pattern="*.txt")
    # Payloads lie beside the manifest of their session.
    place = journal.select(F.regexp_replace("file", "[^/]+$", "").alias("folder")).distinct().withColumn(
        "session", F.regexp_extract("folder", "session=([0-9]+)/", 1).cast("long")
    )
    files = content.where((d % 11 != 4) | (d % 7 == 2)).join(place, "session").select(
        F.concat("folder", d % 256, F.lit(".wav")).alias("path"), "digest"
    )
    cases = jn.fold_verified(journal, files, scans_root(root))
    return _listed(cases).select("attempt_id", "prompt_id", "violations")


def _tagged(letter: str):
    return F.concat(F.lit(letter), F.col("doc_id").cast("string"))


def _event(kind: str, **fields):
    return F.to_json(F.struct(F.lit(kind).alias("event"), *[v.alias(k) for k, v in fields.items()]))


def scans_root(root: str) -> str:
    """A folder name as ``plain_path`` spells it."""
    return root.replace("file://", "", 1) if root.startswith("file://") else root


@query("journal_scan", with_ctes(ad.SQL_JOURNAL, "SELECT event, count(*) AS n, count(DISTINCT attempt_id) AS attempts FROM journal GROUP BY event"))
def journal_scan(t):
    """Writes the journal as manifest files and scans them back."""
    root = shared_dir(t.spark, "journal")
    rows = ad.journal(t).withColumn("manifest", F.col("file") % 4).drop("file")
    rows.write.partitionBy("manifest").json(root)
    back = scans.read_journal(t.spark, root, pattern="*.json")
    return back.groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("attempt_id").alias("attempts"))


@query("journal_append", with_ctes(ad.SQL_JOURNAL, "SELECT status, count(*) AS n FROM journal WHERE event = 'review' GROUP BY status"))
def journal_append(t):
    """Two appends to one journal, then a scan of the whole journal."""
    root = shared_dir(t.spark, "append")
    reviews = ad.journal(t).where("event = 'review'").select("event", "attempt_id", "status", "line")
    sinks.append_journal(reviews.where("status = 'accepted'"), root)
    sinks.append_journal(reviews.where("status = 'rejected'"), root)
    return t.spark.read.schema("status string").json(root).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "case_load",
    with_ctes(
        ad.SQL_RESULTS,
        """SELECT prompt_id, line, array_to_string(list_filter([CASE WHEN status <> 'ok' THEN 'failed_case' END,
            CASE WHEN count(*) OVER (PARTITION BY prompt_id) > 1 THEN 'duplicate_case' END,
            CASE WHEN sha256 = '' THEN 'missing_sha256' END, CASE WHEN text IS NULL THEN 'missing_text' END],
            lambda v: v IS NOT NULL), ',') AS violations FROM results WHERE event = 'case'""",
    ),
)
def case_load(t):
    """The result file written as JSON lines and read by the result scan."""
    root = shared_dir(t.spark, "result-lines")
    sinks.append_journal(ad.results(t).select("event", "status", "prompt_id", "sha256", "text", "line"), root)
    schema = "event string, status string, prompt_id string, sha256 string, text string, line bigint"
    return _listed(jn.check_cases(scans.read_results(t.spark, root, schema)).select("prompt_id", "line", "violations"))


@query(
    "run_summary",
    with_ctes(
        ad.SQL_RESULTS,
        """SELECT run_id, count(*) AS planned, count(*) FILTER (status = 'ok') AS completed,
          count(*) FILTER (status <> 'ok') AS failed, min(line) AS first_line,
          arg_min(elapsed_seconds, line) AS first_elapsed FROM results WHERE event = 'case' GROUP BY run_id""",
    ),
)
def run_summary(t):
    return ad.results(t).where("event = 'case'").groupBy("run_id").agg(
        F.count("*").alias("planned"),
        F.count_if(F.col("status") == "ok").alias("completed"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.min("line").alias("first_line"),
        F.min_by("elapsed_seconds", "line").alias("first_elapsed"),
    )


_PLAN_LINES_SQL = """
lines AS (SELECT page_id, '| ' || CASE page_id % 3 WHEN 0 THEN 'BG' WHEN 1 THEN 'EN' ELSE 'MX' END
    || lpad((page_id % 12)::VARCHAR, 2, '0') || ' | ' ||
    CASE WHEN page_id % 17 = 0 THEN 'EN' WHEN page_id % 3 = 0 THEN 'BG' WHEN page_id % 3 = 1 THEN 'EN' ELSE 'MIXED' END
    || CASE WHEN page_id % 19 = 0 THEN ' - ' ELSE ' | ' END
    || coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'untitled') || ' |' AS value FROM pages)"""


@query(
    "plan_extract",
    with_ctes(
        _PLAN_LINES_SQL,
        r"""SELECT page_id, id AS prompt_id, label, text,
          CASE WHEN (CASE WHEN id[1:2] = 'MX' THEN 'MIXED' ELSE id[1:2] END) <> label THEN 'label_mismatch'
               WHEN trim(text) = '' THEN 'empty_text' END AS violation
        FROM (SELECT page_id, regexp_extract(value, '^\| ((?:BG|EN|MX)\d{2}) \| (BG|EN|MIXED) \| (.+?) \|$', 1) AS id,
            regexp_extract(value, '^\| ((?:BG|EN|MX)\d{2}) \| (BG|EN|MIXED) \| (.+?) \|$', 2) AS label,
            regexp_extract(value, '^\| ((?:BG|EN|MX)\d{2}) \| (BG|EN|MIXED) \| (.+?) \|$', 3) AS text FROM lines)
        WHERE id <> ''""",
    ),
)
def plan_extract(t):
    p = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    line = F.concat(
        F.lit("| "),
        F.when(p % 3 == 0, "BG").when(p % 3 == 1, "EN").otherwise("MX"),
        F.lpad((p % 12).cast("string"), 2, "0"),
        F.lit(" | "),
        F.when(p % 17 == 0, "EN").when(p % 3 == 0, "BG").when(p % 3 == 1, "EN").otherwise("MIXED"),
        F.when(p % 19 == 0, " - ").otherwise(" | "),
        F.when(title == "", "untitled").otherwise(title),
        F.lit(" |"),
    )
    return scans.plan_rows(t("pages").select("page_id", line.alias("value")))


@query(
    "plan_ids",
    with_ctes(
        _PLAN_LINES_SQL,
        r"""found AS (SELECT DISTINCT regexp_extract(value, '^\| ((?:BG|EN|MX)\d{2}) \| (BG|EN|MIXED) \| (.+?) \|$', 1) AS prompt_id FROM lines),
        wanted AS (SELECT p || lpad(i::VARCHAR, 2, '0') AS prompt_id FROM (VALUES ('BG'),('EN'),('MX')) v(p), range(1, 9) r(i))""",
        """SELECT prompt_id, 'missing' AS kind FROM wanted WHERE prompt_id NOT IN (SELECT prompt_id FROM found)
        UNION ALL SELECT prompt_id, 'unexpected' FROM found WHERE prompt_id <> '' AND prompt_id NOT IN (SELECT prompt_id FROM wanted)""",
    ),
)
def plan_ids(t):
    found = plan_extract(t).select("prompt_id").distinct()
    wanted = scans.expected_plan_ids(t.spark)
    return wanted.join(found, "prompt_id", "left_anti").withColumn("kind", F.lit("missing")).unionByName(
        found.join(wanted, "prompt_id", "left_anti").withColumn("kind", F.lit("unexpected"))
    )


@query(
    "content_digest",
    """SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 13 = 0 THEN 'digest_mismatch' END AS violation FROM documents""",
)
def content_digest(t):
    docs = t("documents")
    files = docs.select(F.col("doc_id").alias("filename"), F.sha2("text", 256).alias("digest"))
    listed = docs.select(
        F.col("doc_id"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256")
    )
    return scans.verify_files(listed, files, "doc_id", found_digest="digest").select("doc_id", "digest", "violation")


@query(
    "corpus_union",
    """
    SELECT 'doc-' || doc_id AS item, 1 AS label, 'documents' AS "set", 'calibration' AS split, n_chars AS n_chars FROM documents
    UNION ALL SELECT 'bench-' || item_id, 0, 'benchmark', CASE WHEN item_id % 2 = 0 THEN 'calibration' ELSE 'test' END, length(text) FROM benchmark
    UNION ALL SELECT 'conv-' || conv_id || '-' || turn, 1, 'conversations', 'test', length(text) FROM conversations
    """,
)
def corpus_union(t):
    docs = t("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("item"), "n_chars")
    bench = t("benchmark").select(
        F.concat(F.lit("bench-"), "item_id").alias("item"), F.length("text").cast("long").alias("n_chars"), "item_id"
    )
    conv = t("conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("item"), F.length("text").cast("long").alias("n_chars")
    )
    parts = [
        (docs.withColumn("item_id", F.lit(None).cast("long")), 1, "documents", F.lit("calibration")),
        (bench, 0, "benchmark", scans.parity_split(F.col("item_id"))),
        (conv.withColumn("item_id", F.lit(None).cast("long")), 1, "conversations", F.lit("test")),
    ]
    return scans.tagged_union(parts).select("item", "label", "set", "split", "n_chars")


@query(
    "report_envelope",
    with_ctes(
        ad.SQL_RESULTS,
        f"""SELECT 'start' AS event, NULL::BIGINT AS completed, NULL::BIGINT AS failed, 1 AS n,
          {sinks.sql_rows_digest(("prompt_id", "status", "text"))} AS inputs_digest FROM results WHERE event = 'case'
        UNION ALL SELECT 'case', NULL, NULL, count(*), NULL FROM results WHERE event = 'case'
        UNION ALL SELECT 'end', count(*) FILTER (status = 'ok'), count(*) FILTER (status <> 'ok'), 1, NULL FROM results WHERE event = 'case'""",
    ),
)
def report_envelope(t):
    cases = ad.results(t).where("event = 'case'").select("prompt_id", "status", "text")
    report = sinks.report_envelope(cases, "status")
    return report.groupBy("event", "completed", "failed", "inputs_digest").agg(F.count("*").alias("n"))


@query(
    "label_merge",
    """
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 10 = 0 THEN 'fresh' END,
        CASE WHEN l.quality = 1 THEN 'good' WHEN l.toxic = 1 THEN 'toxic' END) AS label
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE d.doc_id % 10 = 0 OR l.quality = 1 OR l.toxic = 1
    """,
)
def label_merge(t):
    old = t("labels").select(
        "doc_id", F.when(F.col("quality") == 1, " good ").when(F.col("toxic") == 1, "toxic").otherwise("  ").alias("label")
    )
    new = t("documents").select("doc_id").where("doc_id % 10 = 0").withColumn("label", F.lit("fresh"))
    return jn.merge_labels(t("documents"), old, new, "doc_id", "label")


@query(
    "plan_round_robin",
    """
    WITH phrases AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot,
        count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, unnest(range(slot, greatest(n * 2 + 3, 1), n)) AS item, doc_id FROM phrases
    """,
)
def plan_round_robin(t):
    """Two and a bit rounds over every language's documents."""
    docs = t("documents").select("lang", "doc_id").withColumn("_b", F.floor(F.col("doc_id") / 65_536))
    numbered = bucket_running(docs, ["lang"], "_b", ["doc_id"], sums={"_pos": F.lit(1)})
    sizes = checked_broadcast(docs.groupBy("lang").agg(F.count("*").alias("_n")), "lang-sizes")
    return numbered.join(sizes, "lang").select(
        "lang",
        F.explode(F.sequence(F.col("_pos") - 1, F.col("_n") * 2 + 2, F.col("_n"))).alias("item"),
        "doc_id",
    )


@query(
    "quality_gate",
    """
    SELECT doc_id, round(n_chars / 500.0, 6)::DOUBLE AS duration, array_to_string(list_filter([
        CASE WHEN n_chars / 500.0 < 1.5 THEN 'too_short' END, CASE WHEN n_chars / 500.0 > 8.0 THEN 'too_long' END,
        CASE WHEN (doc_id % 50) / 2000.0 < 0.008 THEN 'too_quiet' END], lambda v: v IS NOT NULL), ',') AS reasons
    FROM documents
    """,
)
def quality_gate(t):
    duration, rms = F.col("n_chars") / 500.0, (F.col("doc_id") % 50) / 2000.0
    return ad.rounded(
        t("documents").select(
            "doc_id", duration.alias("duration"), F.array_join(ct.capture_quality(duration, rms), ",").alias("reasons")
        )
    )


@query(
    "keyword_predicate",
    with_ctes(
        """said AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Aurora! ' || text WHEN 1 THEN text || ' аврора'
            WHEN 2 THEN text || ' —Аурората—' WHEN 3 THEN text || ' auroras.' WHEN 4 THEN text || ' xaurora' ELSE text END AS text FROM documents)""",
        r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '),
            lambda w: w IN ('аурора', 'aurora', 'أورورا', 'أرور', 'أورور') OR starts_with(w, 'аурора') OR starts_with(w, 'aurora'))) > 0 AS has_wake
        FROM said""",
    ),
)
def keyword_predicate(t):
    k = F.col("doc_id") % 7
    said = (
        F.when(k == 0, F.concat(F.lit("Aurora! "), "text")).when(k == 1, F.concat("text", F.lit(" аврора")))
        .when(k == 2, F.concat("text", F.lit(" —Аурората—"))).when(k == 3, F.concat("text", F.lit(" auroras.")))
        .when(k == 4, F.concat("text", F.lit(" xaurora"))).otherwise(F.col("text"))
    )
    docs = spread_small(t("documents").select("doc_id", "text")).select("doc_id", said.alias("text"))
    return docs.select("doc_id", kw.contains_wake(F.col("text")).alias("has_wake"))


@query(
    "keyword_normalised",
    r"""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS words FROM documents""",
)
def keyword_normalised(t):
    """The words of a text as the keyword search sees them."""
    return t("documents").select("doc_id", keyword_normalise(F.col("text")).alias("words"))


@query(
    "select_by_route",
    """
    SELECT conv_id, any_value(route) AS route, arg_min(text, turn) FILTER (mode = route) AS text,
      min(turn) FILTER (mode = route) AS turn, count(*) FILTER (mode = route) > 1 AS duplicate_run
    FROM (SELECT conv_id, turn, text, ['bg','en','mixed'][turn % 3 + 1] AS mode, ['bg','en','mixed'][conv_id % 3 + 1] AS route
          FROM conversations)
    GROUP BY conv_id
    """,
)
def select_by_route(t):
    """The turns of a conversation stand for runs in three modes, some repeated."""
    modes = F.array(F.lit("bg"), F.lit("en"), F.lit("mixed"))

    def mode(i):
        return F.element_at(modes, (i % 3 + 1).cast("int"))

    runs = t("conversations").select(
        "conv_id", "turn", "text", mode(F.col("turn")).alias("mode"), mode(F.col("conv_id")).alias("route")
    )
    return tr.select_by_route(runs, "conv_id", "mode", "route", ["text", "turn"], ["turn"])


@query("resume_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 500")
def resume_slice(t):
    return jn.resume_slice(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


_CASES_SQL = ad.SQL_PAIRS + r""",
b AS (SELECT prompt_id, conv_id, reference_text, text, 'ok' AS status, conv_id AS attempt FROM pairs),
o AS (SELECT prompt_id, regexp_replace(reference_text, '^[^ ]+ ', '') AS text,
    CASE WHEN conv_id % 11 = 3 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN conv_id % 10 = 7 THEN conv_id + 1 ELSE conv_id END AS attempt FROM pairs),
pc AS (SELECT b.prompt_id, b.reference_text, o.text, b.attempt = o.attempt AS same, o.status
  FROM b JOIN o ON b.prompt_id = o.prompt_id),
cand AS (SELECT prompt_id, reference_text, text FROM pc)"""


@query(
    "paired_compare",
    with_ctes(
        _CASES_SQL,
        ad.sql_word_errors("pairs", "base_scored"),
        ad.sql_word_errors("cand", "cand_scored").replace("tok AS", "tok2 AS").replace("FROM tok\n", "FROM tok2\n")
        .replace("dp AS", "dp2 AS").replace("FROM dp ", "FROM dp2 ").replace("FROM tok)", "FROM tok2)"),
        """SELECT prompt_id, bs.errors AS baseline_errors, cs.errors AS errors, bs.reference_words,
          array_to_string(list_filter([CASE WHEN pc.status <> 'ok' THEN 'run_failed' END,
            CASE WHEN NOT same THEN 'attempt_id_mismatch' END], lambda v: v IS NOT NULL), ',') AS violations
        FROM pc JOIN base_scored bs USING (prompt_id) JOIN cand_scored cs USING (prompt_id)""",
    ),
)
def paired_compare(t):
    pairs = ad.transcript_pairs(t)
    c = F.col("conv_id")
    base = va.score_words(
        pairs.select(
            "prompt_id", "reference_text", "text", F.lit("ok").alias("status_in"),
            c.cast("string").alias("attempt_id"), F.sha2("prompt_id", 256).alias("sha256"),
        ),
        "reference_text", "text",
    ).withColumn("status", F.col("status_in"))
    other = va.score_words(
        pairs.select(
            "prompt_id", "reference_text", F.regexp_replace("reference_text", "^[^ ]+ ", "").alias("text"),
            F.when(c % 11 == 3, "error").otherwise("ok").alias("status_in"),
            F.when(c % 10 == 7, c + 1).otherwise(c).cast("string").alias("attempt_id"),
            F.sha2("prompt_id", 256).alias("sha256"),
        ),
        "reference_text", "text",
    ).withColumn("status", F.col("status_in"))
    return _listed(jn.paired_compare(base, other)).select(
        F.col("b_prompt_id").alias("prompt_id"), F.col("b_errors").alias("baseline_errors"),
        F.col("o_errors").alias("errors"), F.col("b_reference_words").alias("reference_words"), "violations",
    )


@query(
    "coverage_diff",
    """
    SELECT coalesce(e.doc_id, a.doc_id) AS doc_id,
      CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' ELSE 'mismatch' END AS kind,
      CASE WHEN a.doc_id IS NOT NULL AND e.doc_id IS NOT NULL THEN array_to_string(list_filter([
        CASE WHEN e.quality IS DISTINCT FROM a.quality THEN 'quality' END,
        CASE WHEN e.toxic IS DISTINCT FROM a.toxic THEN 'toxic' END], lambda v: v IS NOT NULL), ',') END AS fields
    FROM (SELECT doc_id, CASE WHEN n_chars % 5 > 0 THEN 1 ELSE 0 END AS quality, CASE WHEN lang = 'en' THEN 0 END AS toxic FROM documents) e
    FULL JOIN (SELECT CASE WHEN doc_id % 21 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, quality, toxic FROM labels) a ON e.doc_id = a.doc_id
    WHERE a.doc_id IS NULL OR e.doc_id IS NULL OR e.quality IS DISTINCT FROM a.quality OR e.toxic IS DISTINCT FROM a.toxic
    """,
)
def coverage_diff(t):
    expected = t("documents").select(
        "doc_id", F.when(F.col("n_chars") % 5 > 0, 1).otherwise(0).alias("quality"),
        F.when(F.col("lang") == "en", 0).alias("toxic"),
    )
    d = F.col("doc_id")
    actual = t("labels").select(F.when(d % 21 == 0, -d - 1).otherwise(d).alias("doc_id"), "quality", "toxic")
    return jn.coverage_diff(expected, actual, "doc_id", ["quality", "toxic"])


@query(
    "manifest_reconcile",
    """
    WITH o AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS key FROM orders),
    l AS (SELECT DISTINCT CASE WHEN l_orderkey % 10 = 3 THEN -l_orderkey ELSE l_orderkey END AS key FROM lineitem)
    SELECT key, 'listed_only' AS side FROM o WHERE key NOT IN (SELECT key FROM l)
    UNION ALL SELECT key, 'present_only' FROM l WHERE key NOT IN (SELECT key FROM o)
    """,
)
def manifest_reconcile(t):
    o, l = F.col("o_orderkey"), F.col("l_orderkey")
    listed = t("orders").select(F.when(F.col("o_orderstatus") == "P", -o).otherwise(o).alias("key"))
    present = t("lineitem").select(F.when(l % 10 == 3, -l).otherwise(l).alias("key"))
    return jn.reconcile_keys(listed, present, "key")


@query(
    "wake_correlate",
    """
    WITH ph AS (SELECT user_id AS phrase_id, min(ts) AS start_ts, bool_or(event_type = 'purchase' AND value >= 30) AS finished
                FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id),
    rs AS (SELECT CASE WHEN user_id % 7 = 0 THEN -user_id - 1 ELSE user_id END AS phrase_id, count(*) AS checks, bool_or(value >= 160) AS hit,
             arg_min('heard ' || event_id, (ts, event_id)) FILTER (value >= 160) AS txt
           FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
    SELECT ph.*, coalesce(checks, 0) AS checks, coalesce(hit, false) AS wake_detected, CASE WHEN hit THEN txt END AS wake_text,
      CASE WHEN finished AND coalesce(hit, false) THEN 'delivered' WHEN finished THEN 'discarded' ELSE 'open' END AS outcome
    FROM ph LEFT JOIN rs USING (phrase_id)
    """,
)
def wake_correlate(t):
    e = t("events")
    phrases = (
        e.where("event_type IN ('signup', 'purchase')").groupBy(F.col("user_id").alias("phrase_id"))
        .agg(
            F.min("ts").alias("start_ts"),
            F.bool_or((F.col("event_type") == "purchase") & (F.col("value") >= 30)).alias("finished"),
        )
    )
    user = F.col("user_id")
    results = e.where("event_type IN ('view', 'click')").select(
        F.when(user % 7 == 0, -user - 1).otherwise(user).alias("phrase_id"), (F.col("value") >= 160).alias("detected"),
        F.concat(F.lit("heard "), "event_id").alias("wake_text"), F.struct("ts", "event_id").alias("rank"),
    )
    return jn.correlate_wake(phrases, results, ["phrase_id"], "rank")


@query(
    "band_assign",
    """
    SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 10 THEN 'BG' WHEN n BETWEEN 11 AND 20 THEN 'EN' WHEN n BETWEEN 21 AND 30 THEN 'MIXED' END AS track,
      n NOT BETWEEN 1 AND 30 AS outside
    FROM (SELECT o_orderkey, o_orderkey % 40 AS n FROM orders)
    """,
)
def band_assign(t):
    bands = [(1, 10, "BG"), (11, 20, "EN"), (21, 30, "MIXED")]
    return t("orders").select("o_orderkey", jn.assign_bands(F.col("o_orderkey") % 40, bands).alias("track")).withColumn(
        "outside", F.col("track").isNull()
    )


@query(
    "manifest_validate",
    """
    SELECT item_id, filename, array_to_string(list_filter([CASE WHEN filename = '' THEN 'missing_filename' END,
        CASE WHEN filename <> '' AND count(*) OVER (PARTITION BY filename) > 1 THEN 'duplicate_filename' END,
        CASE WHEN label NOT IN ('BG', 'EN') THEN 'invalid_label' END, CASE WHEN trim(text) = '' THEN 'missing_text' END],
        lambda v: v IS NOT NULL), ',') AS violations
    FROM (SELECT conv_id * 1000 + turn AS item_id,
            CASE WHEN turn = 5 THEN '' WHEN conv_id % 5 = 0 AND turn < 2 THEN 'rec_' || conv_id || '.wav' ELSE 'rec_' || conv_id || '_' || turn || '.wav' END AS filename,
            CASE role WHEN 'user' THEN 'BG' WHEN 'assistant' THEN 'EN' ELSE 'SYSTEM' END AS label,
            CASE WHEN (conv_id + turn) % 17 = 0 THEN ' ' ELSE text END AS text FROM conversations)
    """,
)
def manifest_validate(t):
    c, n = F.col("conv_id"), F.col("turn")
    rows = t("conversations").select(
        (c * 1000 + n).alias("item_id"),
        F.when(n == 5, "").when((c % 5 == 0) & (n < 2), F.concat(F.lit("rec_"), c, F.lit(".wav")))
        .otherwise(F.concat(F.lit("rec_"), c, F.lit("_"), n, F.lit(".wav"))).alias("filename"),
        F.when(F.col("role") == "user", " bg ").when(F.col("role") == "assistant", "en").otherwise("SYSTEM").alias("label"),
        F.when((c + n) % 17 == 0, " ").otherwise(F.col("text")).alias("text"),
    )
    return _listed(ct.validate_manifest(rows, "filename", "label", "text").select("item_id", "filename", "violations"))


@query(
    "balance_check",
    """
    SELECT coalesce(w.label, g.lang) AS label, coalesce(expected, 0)::BIGINT AS expected, coalesce(observed, 0) AS observed,
      CASE WHEN expected IS NULL THEN 'unexpected_label' WHEN expected <> coalesce(observed, 0) THEN 'wrong_count' END AS violation
    FROM (VALUES ('en', 100), ('fr', 150), ('bg', 10)) w(label, expected)
    FULL JOIN (SELECT lang, count(*) AS observed FROM documents GROUP BY lang) g ON g.lang = w.label
    """,
)
def balance_check(t):
    return ct.balance_check(t("documents"), "lang", {"en": 100, "fr": 150, "bg": 10})
