"""Counts by time over a stream of records: the histogram of the query tools, kept up as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(records: DataFrame, width: str, late: str, key: str = "template_id") -> DataFrame:
    """(start, end, key, n) of tumbling windows; a window is final when the watermark, ``late`` behind the latest time, passes it.

    The state has one row per open window and template, partly aggregated before the shuffle.
    """
    marked = records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = marked.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
