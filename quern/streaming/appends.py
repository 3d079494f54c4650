"""Appending to a stored log or cache exactly once.

A stream hands its batches over with a number that a replay repeats. Each batch is a folder of its own under the stream's name, written by an overwrite of that folder alone, so a
batch that failed half-way is replaced when it comes again; one that was committed is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def committed(spark: SparkSession, path: str, stream: str, batch: int) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batches/stream={stream}/batch={batch}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def append_once(df: DataFrame, path: str, stream: str, batch: int) -> bool:
    """Stores df as the batch of a stream; False, and nothing changes, if it is stored already."""
    if committed(df.sparkSession, path, stream, batch):
        return False
    df.limit(0).write.mode("overwrite").parquet(f"{path}/batches-schema")
    df.write.mode("overwrite").parquet(f"{path}/batches/stream={stream}/batch={batch}")  # its mark comes last
    return True


def sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""
    return lambda df, batch: append_once(df, path, stream, batch) and None


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all streams' committed batches, with columns stream and batch."""
    schema = spark.read.parquet(f"{path}/batches-schema").schema
    return spark.read.schema(schema.add("stream", "string").add("batch", "long")).parquet(f"{path}/batches")
