"""Session settings the operators are written for, and the folder they store results in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # re-plan at run time: coalesce small shuffle partitions, split skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here hold hundreds of columns; recording a Python call site for each costs seconds
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder, shuffle_bytes: int | None = None) -> SparkSession.Builder:
    """The settings above; `shuffle_bytes`, the largest expected shuffle, sizes its partitions.

    Adaptive execution starts from that many partitions of about 128 MB and
    merges those that turn out small.
    """
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    if shuffle_bytes:
        n = max(200, shuffle_bytes // (128 << 20))
        builder = (builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
                   .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m"))
    return builder


_local_base: str | None = None


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by `spark.checkpoint.dir`, removed when Spark ends.

    Where that is unset a local master gets a temporary folder (all its tasks
    share the machine); on a cluster it is an error, since executors would
    write to their own disks.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="bourse-")
        base = _local_base
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    fs.deleteOnExit(top)
    return f"{top.toString()}/table"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a work folder and read again: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
