"""The thirteen operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm import (
    fill_middle, fuse_dedup, html_main, lm_score, merkle, mixing, multi_index, packing, quality, simhash, tokens,
    toxicity, warc,
)
from voxloom.llm.common import fold_of, table


def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return tokens.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_multi_index(spark: SparkSession, root: str) -> DataFrame:
    return multi_index.link_vectors(table(spark, root, "embeddings"))


def op3_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, root, "pages"))


def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"))


def op5_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents"))


def op6_lm_difference(spark: SparkSession, root: str) -> DataFrame:
    """Target: what assistants say in ``conversations``. Background: all documents."""
    said = table(spark, root, "conversations").where("role = 'assistant'").select("text")
    return lm_score.score_documents(table(spark, root, "documents"), said)


def op7_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, root, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, root, "labels"))
    return quality.judge(docs, model).drop("text")


def op10_html(spark: SparkSession, root: str) -> DataFrame:
    return html_main.main_text(table(spark, root, "pages"))


def op11_fill_middle(spark: SparkSession, root: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, root, "documents"))


def op12_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    groups = fuse_dedup.deduplicate(table(spark, root, "documents"))
    return groups.select(
        "doc_id", F.col("keep").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_merkle(spark: SparkSession, root: str) -> DataFrame:
    """Tampering adds 1 to n_chars of a seventh of the rows."""
    docs = table(spark, root, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    rows = merkle.manifest(docs, columns, altered=F.when(hit, tampered))
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_multi_index, op3_warc, op4_mixing, op5_simhash,
        op6_lm_difference, op7_toxicity, op8_packing, op9_quality, op10_html,
        op11_fill_middle, op12_exact_dedup, op13_merkle,
    )
}

_VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
near AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN near n ON n.a = e.vec_id
"""

_ARCHIVE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
r AS (
  SELECT *, payload_bytes >= 1000 AND first_id IS NOT NULL
            AND NOT coalesce(page_id = first_id, false) AS again FROM m
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), k AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place,
         coalesce(sum(source_size) OVER before, 0)::DOUBLE AS full_size,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  -- The first source that its share does not lift above the cap sets the level.
  SELECT arg_min((budget - full_size * 2.0::DOUBLE) / rest, place) AS level FROM k
  WHERE weight * ((budget - full_size * 2.0::DOUBLE) / rest) <= source_size * 2.0::DOUBLE
), t AS (
  SELECT source, source_size, least(weight * coalesce((SELECT level FROM l), 1e300), source_size * 2.0::DOUBLE) AS target
  FROM k
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.*, u.source_size, u.target, u.whole,
         CAST(round(u.target) AS BIGINT) - u.whole * u.source_size AS extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, extra - ahead)) AS BIGINT) AS taken
FROM r
"""

_FILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT *, CAST(length(t) AS BIGINT) AS n,
         [CAST(CAST('0x' || substr(h, 1 + 8 * i, 8) AS UBIGINT) AS BIGINT) FOR i IN range(4)] AS r FROM d
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90
              THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, '<P>' || substr(t, 1, a) AS pre, '<M>' || substr(t, a + 1, b - a) AS mid, '<S>' || substr(t, b + 1) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = """[sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]"""

_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS changed,
    -- CRC-32 of the decimal digits, bit by bit.
    xor(4294967295, list_reduce([4294967295] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda c, o: list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 7 = 0 AS hit
  FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), t(lang, k, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM o GROUP BY lang
  UNION ALL
  SELECT lang, k + 1, {_UP} FROM t WHERE len(nodes) > 1
), s AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(nodes) = 1
), u(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM s
  UNION ALL
  SELECT k + 1, {_UP} FROM u WHERE len(nodes) > 1
), low AS (
  SELECT o.doc_id, o.lang, o.pos,
         list(CASE WHEN (o.pos >> t.k) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(t.nodes[xor(o.pos >> t.k, 1) + 1], '')
              ORDER BY t.k) FILTER (len(t.nodes) > 1) AS path
  FROM o JOIN t ON t.lang IS NOT DISTINCT FROM o.lang GROUP BY o.doc_id, o.lang, o.pos
), high AS (
  SELECT s.lang, s.subroot,
         list(CASE WHEN (s.pos >> u.k) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(u.nodes[xor(s.pos >> u.k, 1) + 1], '')
              ORDER BY u.k) FILTER (len(u.nodes) > 1) AS path
  FROM s CROSS JOIN u GROUP BY s.lang, s.subroot
), f AS (
  SELECT o.doc_id, o.leaf, high.subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root,
         CASE WHEN o.hit AND o.changed IS NOT NULL THEN o.changed ELSE o.leaf END AS start,
         coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM o JOIN low ON low.lang IS NOT DISTINCT FROM o.lang AND low.pos = o.pos
  JOIN high ON high.lang IS NOT DISTINCT FROM o.lang
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda x: x[2:]) || [''], 'string_agg', '')) AS proof_sha256,
       list_reduce([start] || path, lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root,
       folded_root = root AS verified
FROM f
"""

SQL: dict[str, str] = {
    "op2_multi_index": _VECTORS,
    "op3_warc": _ARCHIVE,
    "op4_mixing": _MIX,
    "op11_fill_middle": _FILL,
    "op12_exact_dedup": _EXACT,
    "op13_merkle": _MERKLE,
}
