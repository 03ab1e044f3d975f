"""Durable intermediate tables: survive lost executors and cut the lineage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Shuffle files go when the action that made them has ended; otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set and all is one machine."""
    context = spark.sparkContext
    free_shuffles(spark)
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewright-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once below the checkpoint folder and read back with the same schema."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    # hashes are hexadecimal text, which snappy leaves as it is
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Frames made from now on free their shuffle files at the end of an action. One collected twice is computed twice."""
    spark.conf.set(_CLEANUP, "true")


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    free_shuffles(spark)
    return spark
