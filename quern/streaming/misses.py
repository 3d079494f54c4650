"""The query log as a stream: the miss rate of each day, late entries up to an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_miss_rate(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, total, missed, rate) of a static or streaming log (created_at timestamp, matched boolean)."""
    log = log.withWatermark("created_at", late) if log.isStreaming else log
    a = log.groupBy(F.window("created_at", "1 day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("matched")).alias("missed"))
    return a.select(F.col("window.start").alias("day"), "total", "missed", (F.col("missed") / F.col("total")).alias("rate"))
