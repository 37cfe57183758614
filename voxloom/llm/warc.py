"""Content-addressed web archive.

Payload bytes are stored once per SHA-256, record headers separately and
exactly, one row per record; a join of the two gives back the original records
byte for byte. The strong digest is verified on both ways: at writing, all
payloads of one digest must agree in length and in a second digest; at reading,
the digest is computed anew from the stored bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.session import materialise, shared_dir

CRLF = "\r\n"
# Payloads below this size are stored with their record, never revisited.
MIN_REVISIT = 1000
_DATE = "2000-01-01T00:00:00Z"


def _lines(*parts: Column) -> Column:
    return F.concat(*[F.concat(p, F.lit(CRLF)) for p in parts])


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> None:
    """Writes ``payloads`` and ``records`` below ``path`` (a shared folder).

    The archive is two tables, not one file: records are put together by a join.
    Besides the standard's fields a record has ``WARC-Payload-Length``.

    One record per row of ``pages``. A null body is the empty payload, a null
    url an empty target; rows with equal key and payload are records each, and
    all that hold the largest key of their payload are responses; rows with a
    null key are responses unless a row with a key has the payload. Other
    columns are ignored. An empty table gives an empty archive.
    """
    text = F.encode(F.coalesce(F.col(f"`{body}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("payload")
    ).withColumn("strong", F.sha2("payload", 256))
    stored = rows.select(
        "page_id", "url", "strong",
        F.sha1("payload").alias("sha1"),
        F.length("payload").cast("long").alias("n"),
    )
    # One narrow copy of the rows: digests are computed once.
    stored = materialise(stored, "digests")
    heads = stored.groupBy("strong").agg(
        F.max("page_id").alias("first_id"),
        F.min("sha1").alias("_a"), F.max("sha1").alias("_b"),
        F.min("n").alias("_m"), F.max("n").alias("_x"),
    ).withColumn(
        "verified",
        F.when((F.col("_a") == F.col("_b")) & (F.col("_m") == F.col("_x")), True)
        .otherwise(F.raise_error(F.concat(F.lit("payloads differ under one digest: "), F.col("strong")))),
    ).select("strong", "first_id", "verified")
    # Bytes are combined per map task before the shuffle: copies move once.
    payloads = rows.groupBy("strong").agg(F.any_value("payload").alias("payload"))
    payloads.write.mode("errorifexists").parquet(f"{path}/payloads")

    revisit = (F.col("n") >= min_revisit) & F.col("first_id").isNotNull() & ~F.coalesce(
        F.col("page_id") == F.col("first_id"), F.lit(False)
    )
    # A header value is one line: control characters travel percent-encoded.
    target = escaped = F.coalesce("url", F.lit(""))
    for code in (*range(32), 127):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    target = F.when(target.rlike(r"[\x00-\x1F\x7F]"), escaped).otherwise(target)
    kind = F.when(revisit, "revisit").otherwise("response")
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    # A revisit's block is its protocol head alone, a response's also the payload.
    http = _lines(
        F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("n").cast("string")), F.lit(""),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    refers = F.when(revisit, F.concat(
        F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">" + CRLF),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
    )).otherwise("")
    header = F.concat(
        _lines(
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: "), record_id),
            F.lit(f"WARC-Date: {_DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), target),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
            F.concat(F.lit("WARC-Payload-Length: "), F.col("n").cast("string")),
        ),
        refers,
        _lines(
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), block.cast("string")), F.lit(""),
        ),
        http,
    )
    records = stored.join(heads, "strong").where("verified").select(
        F.col("page_id"), F.encode(header, "UTF-8").alias("header"), "strong"
    )
    records.write.mode("errorifexists").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Original records: ``page_id``, ``header``, ``payload`` (of the record or,
    for a revisit, of the response it refers to) and ``record``, the full bytes.

    A stored payload that no longer has its digest fails the read, and so does
    a record without payload.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    if verify:
        same = F.sha2("payload", 256) == F.col("strong")
        payloads = payloads.withColumn(
            "payload",
            F.when(same, F.col("payload")).otherwise(
                F.raise_error(F.concat(F.lit("stored payload is damaged: "), F.col("strong"))).cast("binary")
            ),
        )
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(payloads, "strong", "left").withColumn(
        "payload", F.coalesce("payload", F.raise_error(F.lit("a record has no payload")).cast("binary"))
    )
    # The field itself: the words may stand in a target as well.
    is_revisit = F.decode("header", "UTF-8").rlike(r"(?m)^WARC-Type: revisit\r?$")
    end = F.lit(CRLF + CRLF).cast("binary")
    return joined.select(
        "page_id", "header", "payload",
        F.concat(F.col("header"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), end).alias("record"),
    )


def parse_headers(records: DataFrame) -> DataFrame:
    """Adds the fields of the record header that describe the payload."""
    head = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        value = F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
        return F.when(value != "", value)

    return records.withColumns({
        "record_type": field("WARC-Type"),
        "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "refers_to": F.regexp_extract(field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).cast("long"),
        "declared_bytes": field("WARC-Payload-Length").cast("long"),
    })


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive of ``pages`` to the shared folder and reads it back.

    ``page_id``, ``payload_bytes`` and ``payload_digest`` of the bytes read,
    ``record_type`` and ``refers_to`` of the header read.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "archive")
    write_archive(pages, path)
    read = parse_headers(read_archive(spark, path))
    return read.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
