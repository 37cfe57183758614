"""Replaying a stored table in a fixed order, a slice per micro-batch.

The table is written to the shared folder as numbered slices. A file stream
takes files by their modification time, so the files get times in the order of
their slices and the stream admits one slice at a time: every batch, and with it
every watermark, is the same in each run. After the last slice come
heartbeats, rows that carry nothing but a time past the last one, as a source
sends them while nothing is said; they move the watermark past what is still open.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.ordered import split_bucket, value_splits
from voxloom.session import ROCKSDB_PROVIDER, parallelism, shared_dir

BEAT = "_beat"
# Heartbeats at the end: the first moves the watermark, and what one stateful
# operator then emits reaches the next with the batch after.
BEATS = 3
# Rows of a slice that a lane of keys gets, and lanes that make a partition of the state worth its cost.
LANE = 8192
LANES_OF_A_TASK = 16
# Bytes of a row group: as many tasks as a slice has of them can read it.
GROUP = 4 << 20


@dataclass(frozen=True)
class Slices:
    """A staged table: its folder, schema and time column."""

    spark: SparkSession
    path: str
    schema: object
    ts: str
    count: int
    rows: int = 0

    @property
    def lanes(self) -> int:
        """Groups that share the keys of a slice: a lane's rows of a batch stay few."""
        slices = max(1, self.count - BEATS)
        return max(parallelism(self.spark), -(-self.rows // (slices * LANE)))

    @property
    def partitions(self) -> int:
        """Partitions of a state kept by lanes. Each costs a batch a store and a worker,
        however few its rows, so they follow the cores and the lanes, up to the session's number."""
        slices = max(1, self.count - BEATS)
        cores = self.spark.sparkContext.defaultParallelism
        return min(parallelism(self.spark), max(cores, -(-self.rows // (slices * LANES_OF_A_TASK * LANE))))

    def stream(self, delay: str | None = None) -> DataFrame:
        """The rows, heartbeats among them; with ``delay`` under a watermark and
        without the heartbeats, which have moved it by then."""
        rows = (
            self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(self.path)
        )
        if delay is None:
            return rows
        # Named together with the event time, the mark is not asked for below the watermark.
        real = F.when(F.col(self.ts).isNotNull(), ~F.col(BEAT))
        return rows.withWatermark(self.ts, delay).where(real).drop(BEAT)


def slices_by_time(rows: DataFrame, ts: str, slices: int) -> Column:
    """Slices of about equal size, in the order of a time column; no time comes first."""
    us = F.unix_micros(F.col(ts))
    splits = value_splits(rows.select(us.alias("_us")), "_us", slices)
    return F.coalesce(split_bucket(us.cast("double"), splits), F.lit(0))


def stage(rows: DataFrame, slice_: Column, ts: str, label: str, idle: str = "1 day") -> Slices:
    """Writes ``rows`` slice by slice, then heartbeats ``idle`` after the last time.

    A slice is one file, written by one task: its size is what the stream
    admits at once. The driver handles one path per slice.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, label)
    real = rows.withColumns({BEAT: F.lit(False), "_slice": slice_.cast("int")})
    # By number, not by hash: a task that gets two slices takes twice as long.
    placed = real.repartitionById(parallelism(spark), "_slice")
    placed.write.partitionBy("_slice").option("parquet.block.size", GROUP).parquet(path)
    schema = real.drop("_slice").schema
    written = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(path)
    last = written.agg((F.max(ts) + F.expr(f"INTERVAL {idle}")).alias("at"))
    columns = [F.col("at").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(True).alias(BEAT) if f.name == BEAT
               else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    beat = last.where("at IS NOT NULL").select(*columns).coalesce(1)
    for i in range(BEATS):
        beat.write.parquet(f"{path}/_slice={(1 << 30) + i}")
    return Slices(spark, path, schema, ts, _put_in_order(spark, path), written.where(~F.col(BEAT)).count())


def _put_in_order(spark: SparkSession, path: str) -> int:
    """Modification times in slice order, a second apart; the number of files."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_slice=*/*.parquet")):
        where = status.getPath()
        files.append((int(where.getParent().getName().split("=")[1]), where))
    for i, (_, where) in enumerate(sorted(files, key=lambda f: f[0])):
        fs.setTimes(where, 1_600_000_000_000 + 1000 * i, -1)
    return len(files)


@dataclass(frozen=True)
class Drained:
    """What a finished replay wrote and what its progress reported."""

    rows: DataFrame
    batches: int
    late: int
    peak_state: int


def drain(
    stream: DataFrame, label: str, mode: str = "append", root: str | None = None, partitions: int | None = None
) -> Drained:
    """Runs a replay to the end of what is there, with exactly-once file output.

    Checkpoint and output lie in the shared folder, so a restarted driver or a
    lost executor goes on where the stream was; so does a later call that names
    the same ``root``. ``late`` counts the rows state operators refused,
    ``peak_state`` the most state rows after any batch. A new stream keeps its
    state in ``partitions``, else in as many as the session shuffles to.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    # A batch uploads what it changed, not the whole state.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    root = root or shared_dir(spark, label)
    out = os.path.join(root, "out")
    writer = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True)
    )
    width = parallelism(spark)
    try:
        # A stream takes a copy of the settings when it starts.
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions or width))
        query: StreamingQuery = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
    query.awaitTermination()
    progress = query.recentProgress
    return Drained(
        spark.read.schema(stream.schema).parquet(out),
        len(progress),
        sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators),
        max((sum(op.numRowsTotal for op in p.stateOperators) for p in progress), default=0),
    )


def drain_whole(stream: DataFrame, label: str, partitions: int | None = None) -> Drained:
    """As ``drain``; rows that came behind the watermark are an error."""
    done = drain(stream, label, partitions=partitions)
    if done.late:
        raise ValueError(f"{label}: {done.late} rows came behind the watermark; use a longer delay")
    return done
