"""Intervals of time as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(spans: DataFrame, by: str) -> DataFrame:
    """(by, start, end): the spans of each ``by`` with those joined that overlap or touch; equal spans are taken once before they meet in a task."""
    distinct = spans.select(by, "start", "end").distinct()
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = distinct.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_i", F.sum("_new").over(order))
    return numbered.groupBy(by, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")
