"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import voxloom
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# What results depend on: set on a session somebody else created as well.
RESULT_CONF = {"spark.sql.session.timeZone": "UTC"}

# How plans are run: only sessions made here get these.
LOCAL_CONF = {
    **RESULT_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where an aggregate then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on, and make functions portable.

    Functions of this package travel to the Python workers by value: the
    driver may have the package on its own path only, a cluster nowhere.
    """
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    cloudpickle.register_pickle_by_value(voxloom)
    return spark


# Local sessions without a checkpoint folder share one for the process.
_LOCAL_ROOT: str | None = None
# Folders made for intermediates, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint location.

    The location is read from ``spark.checkpoint.dir``. Only where that is
    unset *and* the master is local (tests) a temporary folder is used.
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(
                "spark.checkpoint.dir must name a shared folder on a cluster"
            )
        _LOCAL_ROOT = root = _LOCAL_ROOT or tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(root, f"{label}-{uuid.uuid4().hex}")
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors. The copy stays
    until ``clear_intermediates``: the frame returned reads it lazily.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_intermediates(spark: SparkSession) -> int:
    """Deletes what finished queries of this application left in the shared folder.

    Call it when their results are written: frames that still read an
    intermediate fail afterwards. Returns the number of folders.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_small(df: DataFrame) -> DataFrame:
    """Spreads a table of few files over all cores before heavy row work.

    A table with at least as many files as cores is left alone, so no shuffle
    is added where it would cost. Rows and results are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
