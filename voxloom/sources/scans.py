"""Scans of the file formats the evaluation tools exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from voxloom import schemas
from voxloom.operators.ordered import checked_broadcast


def plain_path(path: Column) -> Column:
    """Local paths in one spelling, whatever the slashes after the scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_journal(
    spark: SparkSession, root: str, schema: str = schemas.JOURNAL, pattern: str = "manifest.jsonl"
) -> DataFrame:
    """Every journal file below ``root``: its events with ``file`` and ``line``.

    ``line`` grows with the position in the file and is not a line number: the
    start of the block a task reads plus the row's place in that task. A task
    reads no more bytes than a block holds and a row has two at least, so the
    rows of a later block always come later. A ``line`` in the JSON is ignored.
    """
    fields = ", ".join(f for f in schema.split(", ") if f.split()[0] != "line")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return (
        spark.read.schema(fields)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(root)
        .withColumn("file", plain_path(F.col("_metadata.file_path")))
        .withColumn("line", F.col("_metadata.file_block_start") + row)
    )


def read_results(spark: SparkSession, path: str, schema: str = schemas.RESULTS) -> DataFrame:
    """All lines of a result file; ``journal.check_cases`` applies the contract."""
    return spark.read.schema(schema).json(path)


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, with or without a byte-order mark.

    Columns are found by their header name in whatever order; a missing column
    and a file without rows are errors.
    """
    wanted = StructType.fromDDL(schema)
    head = spark.read.option("header", True).csv(path)
    names = {c.lstrip("\ufeff").strip(): c for c in head.columns}
    missing = [f.name for f in wanted.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    rows = head.select(*[F.col(f"`{names[f.name]}`").cast(f.dataType).alias(f.name) for f in wanted.fields])
    if head.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows


PLAN_ROW = r"^\| ((?:BG|EN|MX)\d{2}) \| (BG|EN|MIXED) \| (.+?) \|$"


def plan_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Prompt rows of a Markdown plan, with label checks."""
    line = F.col(column)
    label = F.regexp_extract(line, PLAN_ROW, 2)
    prefix = F.substring(F.regexp_extract(line, PLAN_ROW, 1), 1, 2)
    text = F.regexp_extract(line, PLAN_ROW, 3)
    wanted = F.when(prefix == "MX", "MIXED").otherwise(prefix)
    keep = [c for c in lines.columns if c != column]
    return lines.where(line.rlike(PLAN_ROW)).select(
        *keep,
        F.regexp_extract(line, PLAN_ROW, 1).alias("prompt_id"),
        label.alias("label"),
        text.alias("text"),
        F.when(wanted != label, "label_mismatch").when(F.trim(text) == "", "empty_text").alias("violation"),
    )


def expected_plan_ids(spark: SparkSession, per_label: int = 8) -> DataFrame:
    """The IDs a plan must contain: per label 01..n."""
    return spark.range(1, per_label + 1).select(
        F.explode(F.array(*[F.lit(p) for p in ("BG", "EN", "MX")])).alias("prefix"), "id"
    ).select(F.concat("prefix", F.lpad(F.col("id").cast("string"), 2, "0")).alias("prompt_id"))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return plan_rows(spark.read.text(path))


def catalog_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Content digest and size of every matching file below ``root``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.col("length").alias("bytes"),
            F.sha2("content", 256).alias("digest"),
        )
    )


def digest_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path``, ``bytes`` and ``sha256`` of every matching file below ``root``.

    No file is ever one value: Spark reads it as runs of bytes up to a line
    feed, from as many blocks as it has, whatever store it lies in. The runs of
    a file are brought together in order and streamed through a digest, so a
    file of any size takes the memory of its longest run. Bytes are kept as
    they are; whether the last run ended with a line feed follows from the size.
    Spark's scans pass over files without any bytes: those are not found here,
    so a manifest that lists one finds it missing.
    """
    runs = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
            F.col("value").cast("binary").alias("run"),
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, left, digest, done = None, 0, 0, None, []

        def close() -> None:
            if at is not None:
                done.append((at, size, digest.hexdigest()))

        for b in batches:
            for path, n, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if path != at:
                    close()
                    at, size, left, digest = path, n, n, hashlib.sha256()
                data = run.as_buffer()
                digest.update(data)
                left -= len(data)
                if left > 0:
                    digest.update(b"\n")
                    left -= 1
        close()
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([d[0] for d in done], pa.string()), "bytes": pa.array([d[1] for d in done], pa.int64()),
             "sha256": pa.array([d[2] for d in done], pa.string())}
        )

    ordered = runs.repartition(parts, "path").sortWithinPartitions("path", "block", "row")
    return ordered.select("path", "bytes", "run").mapInArrow(stream, "path string, bytes long, sha256 string")


def verify_files(
    listed: DataFrame, files: DataFrame, name: str = "filename", digest: str = "sha256",
    manifest: str | None = None, root: str | None = None, found_digest: str | None = None,
) -> DataFrame:
    """Listed files that are missing, changed or outside the root, as ``violation``.

    With ``manifest``, a column that holds the listing file's path, a name is
    resolved in that file's folder and looked up by full path: two sessions may
    use one file name. A name that leads out of ``root`` is refused. Without
    it, ``files`` are looked up by ``filename``. ``found_digest`` names a
    column for the digest of the file found.
    """
    if manifest is None:
        found = files.select(F.col("filename").alias("_f"), F.col("digest").alias("_d"))
        wanted, outside = F.col(name), F.lit(False)
    else:
        found = files.select(plain_path(F.col("path")).alias("_f"), F.col("digest").alias("_d"))
        wanted = F.concat(F.regexp_replace(plain_path(F.col(manifest)), "[^/]+$", ""), F.col(name))
        below = F.lit(True) if root is None else wanted.startswith(plain_path(F.lit(root.rstrip("/") + "/")))
        outside = F.col(name).rlike(r"^/|(^|/)\.\.(/|$)") | ~below
    out = listed.join(found, wanted == F.col("_f"), "left")
    return out.select(
        *listed.columns,
        *([F.col("_d").alias(found_digest)] if found_digest else []),
        F.when(outside, "outside_root")
        .when(F.col("_f").isNull(), "missing_file")
        .when(~F.col("_d").eqNullSafe(F.col(digest)), "digest_mismatch")
        .alias("violation"),
    )


def tagged_union(parts: list[tuple[DataFrame, int, str, Column]]) -> DataFrame:
    """Sources (df, label, set name, split column) as one labelled corpus."""
    tagged = [
        df.withColumn("label", F.lit(label)).withColumn("set", F.lit(name)).withColumn("split", split)
        for df, label, name, split in parts
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def parity_split(number: Column) -> Column:
    return F.when(number % 2 == 0, "calibration").otherwise("test")


def round_robin_plan(phrases: DataFrame, per_language: int) -> DataFrame:
    """``per_language`` items per language, cycling through its phrases.

    ``phrases`` has (language, slot, phrase), slots from 0 without gaps. Items
    are generated by a range, so a plan of any length spreads over the tasks;
    a language without phrases has no items.
    """
    spark = phrases.sparkSession
    sizes = checked_broadcast(phrases.groupBy("language").agg(F.count("*").alias("n")), "plan-sizes")
    items = spark.range(per_language).join(sizes).select(
        F.col("language").alias("_l"), F.col("id").alias("item"), (F.col("id") % F.col("n")).alias("_s")
    )
    return items.join(phrases, (F.col("_l") == F.col("language")) & (F.col("_s") == F.col("slot"))).select(
        "language", "item", "phrase"
    )
