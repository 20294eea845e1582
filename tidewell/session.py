"""Session construction and the few settings every operator relies on."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's own setting; only a local session may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = Path(tempfile.gettempdir(), "tidewell-checkpoints").as_uri()
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result once to the shared folder and reads it from there.

    What is read twice is computed once, and a lost executor costs no recomputation of what came before.
    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that keep one core busy: Spark makes no smaller pieces of files.
PIECE_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table is so small and in so few files that less than half of the cores would work.

    For stages whose time goes into Python on every row. Larger tables stay as they are, without a shuffle; the result is
    the same either way. Only sizes and names of files are looked at, nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if 2 * size >= cores * PIECE_BYTES or 2 * len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
