"""Aggregations over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(rows: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """start, key, n: rows counted by a key in windows of event time, of a stream (or a table). Rows later than `late` behind the newest are not waited for."""
    held = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return held.select(F.col("w.start").alias("start"), key, "n")
