"""The folder that driver and executors share, for stored indexes and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one of this machine only where that is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", base)
    return f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, *parts: str) -> DataFrame:
    """df written to path, partitioned by ``parts``, and read again: a cut of the lineage that survives lost executors."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    df.limit(0).write.mode("overwrite").parquet(f"{path}-schema")  # an empty table has no folders to tell it
    return reopened(df.sparkSession, path)


def reopened(spark: SparkSession, path: str) -> DataFrame:
    """What ``stored`` wrote to path."""
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)
