"""Append-only journals and create-once reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery


def append_journal(events: DataFrame, root: str) -> None:
    """Adds events as JSON lines; nothing already written is touched."""
    events.write.mode("append").option("ignoreNullFields", True).json(root)


def append_batch(events: DataFrame, batch: int, root: str) -> None:
    """Events of one micro-batch, in a folder of the batch's own.

    A batch that is run again replaces what it wrote before, and one that fails
    leaves nothing behind, so every event is in the journal once.
    """
    events.write.mode("overwrite").option("ignoreNullFields", True).json(f"{root}/batch={batch}")


def stream_journal(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of events into the journal below ``root`` until it has caught up."""
    query = (
        events.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, root))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def rows_digest(columns: Sequence[str]) -> Column:
    """Digest of a set of rows: two sums of independent 60-bit row hashes and the count.

    Independent of order, mergeable, and, unlike an exclusive or, equal rows
    do not cancel. A value enters with its length, a null as a dash.
    """
    fields = [
        F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
        for c in columns
    ]
    row = F.md5(F.concat_ws("|", *fields))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(20,0)")).cast("string")

    return F.concat_ws(
        "-", F.coalesce(part(1), F.lit("0")), F.coalesce(part(17), F.lit("0")), F.count(F.lit(1)).cast("string")
    )


def sql_rows_digest(columns: Sequence[str]) -> str:
    """The same digest as a DuckDB aggregate."""
    row = "md5(concat_ws('|', " + ", ".join(
        f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns
    ) + "))"
    parts = [f"coalesce(sum(('0x' || substr({row}, {at}, 15))::BIGINT)::VARCHAR, '0')" for at in (1, 17)]
    return f"concat_ws('-', {parts[0]}, {parts[1]}, count(*)::VARCHAR)"


def files_digest(files: DataFrame) -> Column:
    """Aggregate over (path, sha256): names and digests of input files in order,
    as one JSON text. A report has as many inputs as it was given paths."""
    name = F.element_at(F.split("path", "/"), -1)
    return F.to_json(F.array_sort(F.collect_list(F.struct(name.alias("name"), "sha256"))))


def report_envelope(cases: DataFrame, status: str, inputs: DataFrame | None = None) -> DataFrame:
    """Case rows between a start row and an end row, as one nullable schema.

    The start row carries a digest of all case rows and, given ``inputs``
    (path, sha256 of files as ``digest_files`` finds them), ``inputs`` with
    their names and digests; the end row the completed and failed counts.
    """
    if inputs is not None:
        start = inputs.agg(files_digest(inputs).alias("inputs")).withColumn("event", F.lit("start"))
        plain = report_envelope(cases, status)
        head = plain.where("event = 'start'").join(start, "event")
        return plain.where("event <> 'start'").unionByName(head, allowMissingColumns=True)
    summary = cases.agg(
        F.count_if(F.col(status) == "ok").alias("completed"),
        F.count_if(~F.col(status).eqNullSafe("ok")).alias("failed"),
        rows_digest(cases.columns).alias("inputs_digest"),
    )
    none = F.lit(None)
    ends = summary.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("start").alias("event"), none.cast("long").alias("completed"),
                    none.cast("long").alias("failed"), F.col("inputs_digest"),
                ),
                F.struct(
                    F.lit("end").alias("event"), F.col("completed"), F.col("failed"),
                    none.cast("string").alias("inputs_digest"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    return cases.withColumn("event", F.lit("case")).unionByName(ends, allowMissingColumns=True)


def write_quarantined(rows: DataFrame, path: str, violations: str = "violations") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good and bad rows and their counts from one pass over ``rows``.

    The rows are read once: the job that writes them counts them on the way, by
    observed metrics, and deals them to a good and a bad folder. Returns both
    as written, and ``rows``, ``bad`` and the number of each violation.
    """
    bad = F.size(violations) > 0
    seen = Observation()
    named = rows.withColumn("_bad", bad)
    watched = named.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.size(violations)), F.lit(0)).alias("violations"),
    )
    watched.write.mode("errorifexists").partitionBy("_bad").parquet(path)
    written = rows.sparkSession.read.schema(named.schema).parquet(path)
    return written.where("NOT _bad").drop("_bad"), written.where("_bad").drop("_bad"), seen.get


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; an existing report is an error."""
    df.write.mode("errorifexists").json(path)


def write_csv_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a fixed column order and empty missing values.

    The report keeps the partitioning of its input: one file per partition.
    """
    df.select(*columns).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)
