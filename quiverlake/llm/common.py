"""Shared helpers: scratch tables in the shared checkpoint folder, column checks, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship

#: The ASCII white space that separates words: space and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quiverlake-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes shuffle files once their plans are collected on the driver; without this they can stay on disk until the query ends."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def prepare(spark: SparkSession) -> None:
    """Hand the package to the executors, and take Arrow batches of 2,000 rows unless the session names another number: at Spark's 10,000, long texts fill the workers' memory."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") in (None, "10000"):
        spark.conf.set(name, "2000")
