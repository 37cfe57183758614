"""File formats written and read back: catalogues, reports, tables, plans, contracts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from voxloom.operators import contracts as ct
from voxloom.operators import evaluate as va
from voxloom.operators import journal as jn
from voxloom.operators import segments as sg
from voxloom.operators.ordered import bucket_running
from voxloom.operators.plugins import detect_wake
from voxloom.plans import adapters as ad
from voxloom.plans.registry import query, with_ctes
from voxloom.session import materialise, shared_dir
from voxloom.sources import scans, sinks

# Documents of one recording file.
FILE_DOCS = 64


@query(
    "file_catalog",
    f"""
    WITH f AS (SELECT doc_id // {FILE_DOCS} AS g, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
    v AS (SELECT *, CASE WHEN g % 13 = 6 THEN 'outside_root' WHEN g % 11 = 4 THEN 'missing_file' WHEN g % 7 = 2 THEN 'digest_mismatch' END AS violation FROM f)
    SELECT g AS recording, CASE WHEN violation NOT IN ('outside_root', 'missing_file') OR violation IS NULL THEN sha256(body) END AS found,
      violation FROM v
    """,
)
def file_catalog(t):
    """Recordings as real files whose bytes are streamed through a digest; of
    those a manifest lists some are changed, missing or outside the root."""
    root = shared_dir(t.spark, "catalog")
    g = F.floor(F.col("doc_id") / FILE_DOCS)
    gone = (g % 11 == 4) & (g % 13 != 6)
    docs = t("documents").select("doc_id", g.alias("g"), F.coalesce("text", F.lit("")).alias("value"))
    present = docs.where(~gone)
    # A file's rows come from one task, in order; a session is a folder of its own.
    (present.repartition("g").sortWithinPartitions("g", "doc_id").select("g", "value")
     .write.partitionBy("g").option("lineSep", "\n").text(f"{root}/recordings"))
    files = scans.digest_files(t.spark, f"{root}/recordings", "*.txt").withColumn(
        "g", F.regexp_extract("path", "/g=([0-9]+)/", 1).cast("long")
    )
    expected = docs.groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda r: F.concat(r["value"], F.lit("\n"))), "").alias("body")
    ).select(
        "g", F.sha2(F.when(F.col("g") % 7 == 2, F.concat("body", F.lit("!"))).otherwise(F.col("body")), 256).alias("sha256")
    )
    names = files.select("g", F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    listed = expected.join(names, "g", "left").select(
        F.col("g").alias("recording"), "sha256", F.lit(f"{root}/recordings/manifest.jsonl").alias("manifest"),
        F.concat(F.when(F.col("g") % 13 == 6, "../").otherwise(""), F.lit("g="), F.col("g"), F.lit("/"), F.coalesce("file", F.lit("none.txt"))).alias("filename"),
    )
    found = files.select("path", F.col("sha256").alias("digest"))
    return scans.verify_files(
        listed, found, manifest="manifest", root=f"{root}/recordings", found_digest="found"
    ).select("recording", "found", "violation")


_LINE = """'{"event":"' || event || '","prompt_id":"' || prompt_id || '","status":"' || status || '"}'"""


@query(
    "report_provenance",
    with_ctes(
        ad.SQL_RESULTS,
        f"""files AS (SELECT 'run=' || line // 4096 AS name, sha256(string_agg({_LINE} || chr(10), '' ORDER BY line)) AS sha256
          FROM results GROUP BY 1)""",
        f"""SELECT 'start' AS event, NULL::BIGINT AS completed, NULL::BIGINT AS failed,
          (SELECT string_agg(sha256, ',' ORDER BY sha256) FROM files) AS inputs,
          (SELECT {sinks.sql_rows_digest(("prompt_id", "status"))} FROM results WHERE event = 'case') AS inputs_digest, 1::BIGINT AS n
        UNION ALL SELECT 'case', NULL, NULL, NULL, NULL, count(*) FROM results WHERE event = 'case'
        UNION ALL SELECT 'end', count(*) FILTER (status = 'ok'), count(*) FILTER (status <> 'ok'), NULL, NULL, 1 FROM results WHERE event = 'case'""",
    ),
)
def report_provenance(t):
    """Result files reviewed into a report that names the digests of their bytes.

    The files are read by the result scan, the report is written once and read back.
    """
    root = shared_dir(t.spark, "results")
    lines = ad.results(t).select(
        F.floor(F.col("line") / 4096).alias("run"), "line",
        F.concat(F.lit('{"event":"'), "event", F.lit('","prompt_id":"'), "prompt_id", F.lit('","status":"'), "status", F.lit('"}')).alias("value"),
    )
    (lines.repartition("run").sortWithinPartitions("run", "line").select("run", "value")
     .write.partitionBy("run").option("lineSep", "\n").text(f"{root}/in"))
    cases = scans.read_results(t.spark, f"{root}/in", "event string, prompt_id string, status string").where("event = 'case'")
    inputs = scans.digest_files(t.spark, f"{root}/in", "*.txt")
    report = sinks.report_envelope(cases.select("prompt_id", "status"), "status", inputs)
    sinks.write_report(report, f"{root}/report")
    schema = "event string, completed bigint, failed bigint, inputs string, inputs_digest string"
    back = t.spark.read.schema(schema).json(f"{root}/report")
    digests = F.from_json("inputs", "array<struct<name:string,sha256:string>>")
    named = back.withColumn("inputs", F.array_join(F.array_sort(F.transform(digests, lambda d: d["sha256"])), ","))
    return named.groupBy("event", "completed", "failed", "inputs", "inputs_digest").agg(F.count("*").alias("n"))


@query(
    "feature_csv",
    with_ctes(ad.SQL_FEATURES, "SELECT sample_id, label, prompt, feature, round(value, 6) AS value FROM long"),
)
def feature_csv(t):
    """The wide feature table as CSV with a byte-order mark and moved columns, read by name."""
    root = shared_dir(t.spark, "features")
    wide = ad.labelled_features(t)
    moved = [*reversed(ad.FEATURES), "label", "prompt", "sample_id"]
    sinks.write_csv_report(wide.withColumnRenamed(moved[0], "﻿" + moved[0]), root, ["﻿" + moved[0], *moved[1:]])
    schema = "sample_id bigint, label string, prompt bigint, " + ", ".join(f"{f} double" for f in ad.FEATURES)
    return ad.rounded(ad.long_features(scans.read_table_csv(t.spark, root, schema)))


@query(
    "plan_generate",
    """
    WITH phrases AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot,
        count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT p.lang AS language, r.item, p.doc_id AS phrase
    FROM phrases p JOIN (SELECT unnest(range((SELECT count(*) FROM documents))) AS item) r ON r.item % p.n = p.slot
    """,
)
def plan_generate(t):
    """A plan as long as the table for every language, from its documents in turn."""
    docs = t("documents").select("lang", "doc_id").withColumn("_b", F.floor(F.col("doc_id") / 65_536))
    numbered = bucket_running(docs, ["lang"], "_b", ["doc_id"], sums={"_pos": F.lit(1)})
    phrases = numbered.select(F.col("lang").alias("language"), (F.col("_pos") - 1).alias("slot"), F.col("doc_id").alias("phrase"))
    return scans.round_robin_plan(materialise(phrases, "phrases"), t("documents").count())


@query(
    "wake_plugin",
    with_ctes(
        ad.SQL_BLOCKS,
        """ph AS (SELECT device_id, block_idx // 48 AS phrase_id, block_idx % 48 AS pos, value / 10000.0 AS amp FROM blocks),
        sizes AS (SELECT device_id, phrase_id, count(*) AS n FROM ph GROUP BY device_id, phrase_id),
        checks AS (SELECT device_id, phrase_id, m AS prefix, false AS is_final FROM sizes, (VALUES (15),(20),(25),(30),(35),(40)) v(m) WHERE n >= m
          UNION ALL SELECT device_id, phrase_id, least(n, 40), true FROM sizes WHERE n < 15 OR (n < 40 AND n % 5 <> 0)),
        heard AS (SELECT c.device_id, c.phrase_id, c.prefix, c.is_final, sqrt(sum(amp * amp) / c.prefix) AS rms
          FROM checks c JOIN ph p ON p.device_id = c.device_id AND p.phrase_id = c.phrase_id AND p.pos < c.prefix
          GROUP BY c.device_id, c.phrase_id, c.prefix, c.is_final)""",
        """SELECT device_id, phrase_id, is_final, count(*) AS checks, count(*) FILTER (rms >= 0.0085) AS detected
        FROM heard WHERE rms >= 0.008 GROUP BY device_id, phrase_id, is_final""",
    ),
)
def wake_plugin(t):
    """Submitted prefixes to decisions by a user's own detector, counted per phrase."""
    ph = ad.blocks(t).select(
        "device_id", F.floor(F.col("block_idx") / 48).alias("phrase_id"), (F.col("block_idx") % 48).alias("pos"),
        (F.col("value") / 10000.0 * (F.col("value") / 10000.0)).alias("energy"),
    )
    submitted = sg.prefix_schedule(ph, ["device_id", "phrase_id"], "pos", "energy").where("submitted")

    def loud(batch: pd.DataFrame) -> pd.DataFrame:
        hit = batch["rms"] >= 0.0085
        return pd.DataFrame({
            "device_id": batch["device_id"], "phrase_id": batch["phrase_id"], "ts": pd.NaT, "is_final": batch["is_final"],
            "detected": hit, "wake_text": hit.map({True: "aurora", False: None}), "score": batch["rms"],
        })

    decisions = detect_wake(submitted, loud)
    return decisions.groupBy("device_id", "phrase_id", "is_final").agg(
        F.count("*").alias("checks"), F.count_if("detected").alias("detected")
    )


@query(
    "contract_quarantine",
    """
    WITH rows AS (SELECT conv_id, turn, role, text,
        (trim(coalesce(text, '')) = '' OR (conv_id + turn) % 17 = 0)::INT + (role NOT IN ('user', 'assistant'))::INT + (turn > 6)::INT AS broken
      FROM conversations)
    SELECT count(*) AS rows, count(*) FILTER (broken > 0) AS bad, sum(broken)::BIGINT AS violations,
      count(*) FILTER (broken = 0) AS good_written, count(*) FILTER (broken > 0) AS bad_written FROM rows
    """,
)
def contract_quarantine(t):
    """One pass that counts, keeps the good rows and sets the bad ones apart."""
    blank = (F.trim(F.coalesce("text", F.lit(""))) == "") | ((F.col("conv_id") + F.col("turn")) % 17 == 0)
    checked = t("conversations").withColumn("violations", ct.violation_list(
        (blank, "missing_text"), (~F.col("role").isin("user", "assistant"), "invalid_label"), (F.col("turn") > 6, "too_many_turns"),
    ))
    good, bad, counts = sinks.write_quarantined(checked, shared_dir(t.spark, "quarantine"))
    written = ct.enforce(good, strict=True).agg(F.count("*").alias("good_written")).join(bad.agg(F.count("*").alias("bad_written")))
    return written.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("rows", "bad", "violations")], "good_written", "bad_written")


@query(
    "band_table",
    """
    WITH bands AS (SELECT n_nationkey * 10 AS low, n_nationkey * 10 + CASE WHEN n_nationkey % 4 = 0 THEN 6 ELSE 9 END AS high, n_name AS label FROM nation),
    o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 260 END AS n FROM orders)
    SELECT o_orderkey, label AS track, label IS NULL AS outside FROM o LEFT JOIN bands ON n BETWEEN low AND high
    """,
)
def band_table(t):
    """Bands from a table, with gaps; orders in none come out apart."""
    key = F.col("n_nationkey").cast("long")
    bands = t("nation").select(
        (key * 10).alias("low"), (key * 10 + F.when(key % 4 == 0, 6).otherwise(9)).alias("high"), F.col("n_name").alias("label")
    )
    orders = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey") % 260).alias("n"))
    found, rest = jn.band_lookup(orders, "n", bands)
    return found.select("o_orderkey", "track", F.lit(False).alias("outside")).unionByName(
        rest.select("o_orderkey", F.lit(None).cast("string").alias("track"), F.lit(True).alias("outside"))
    )


@query(
    "distribution_sketch",
    """
    SELECT l_returnflag, count(*) AS n, true AS p25_close, true AS median_close, true AS p75_close FROM lineitem GROUP BY l_returnflag
    """,
)
def distribution_sketch(t):
    """Quantiles of any span from sketches stored per part; ranks within 2 % of the wanted ones."""
    rows = t("lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), "l_extendedprice")
    stored = materialise(va.quantile_sketches(rows, ["l_returnflag", "year"], "l_extendedprice"), "sketches")
    fractions = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    told = va.sketched_summary(stored, ["l_returnflag"], fractions)
    ranks = rows.join(told.withColumnRenamed("l_returnflag", "_f"), F.col("l_returnflag") == F.col("_f")).groupBy("l_returnflag", "n").agg(
        *[F.struct(F.avg((F.col("l_extendedprice") < F.col(c)).cast("double")).alias("low"),
                   F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double")).alias("high")).alias(c) for c in fractions]
    )
    return ranks.select("l_returnflag", "n", *[
        ((F.col(c)["low"] <= f + 0.02) & (F.col(c)["high"] >= f - 0.02)).alias(f"{c}_close") for c, f in fractions.items()
    ])
