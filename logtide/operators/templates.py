"""Aggregates of templates: over all records, over the incident's window, and their numbering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.ordering import ranked

from logtide.functions.times import ntz
from logtide.operators.records import is_trigger


def totals(records: DataFrame, key: str = "template") -> DataFrame:
    """Per template: total_count, first_ts, last_ts, severity and level of the most severe record."""
    return records.groupBy(key).agg(
        F.count("*").alias("total_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("severity").alias("severity"),
        F.max_by("level", "severity").alias("level"),
    )


def window_totals(records: DataFrame, start: datetime, end: datetime, key: str = "template") -> DataFrame:
    """Totals of every template together with those of the window, in one pass; window columns of absent ones are 0 or null."""
    inside = F.col("ts").between(ntz(start), ntz(end))

    def when(value: Column) -> Column:
        return F.when(inside, value)

    return records.groupBy(key).agg(
        F.count("*").alias("total_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("severity").alias("severity"),
        F.max_by("level", "severity").alias("level"),
        F.count(when(F.lit(1))).alias("window_count"),
        F.min(when(F.col("ts"))).alias("window_first"),
        F.max(when(F.col("ts"))).alias("window_last"),
        F.max(when(F.col("severity"))).alias("window_severity"),
        F.max_by(when(F.col("level")), when(F.col("severity"))).alias("window_level"),
        F.count(when(F.when(is_trigger(records), 1))).alias("trigger_count"),
    )


def component_histogram(records: DataFrame, key: str = "template") -> DataFrame:
    """Per template, its components and their counts, the most frequent first (long form)."""
    counts = records.groupBy(key, F.coalesce("component", F.lit("")).alias("component")).agg(F.count("*").alias("n"))
    by_count = Window.partitionBy(key).orderBy(F.desc("n"), "component")
    return counts.withColumn("rank", F.row_number().over(by_count).cast("long"))


def numbered(records: DataFrame, order: list[str], key: str = "template") -> DataFrame:
    """(template, template_id): T01, T02, … by first appearance in ``order``; wider from 100 templates on.

    Places are counted by ranges, so that no task sees all templates.
    """
    firsts = records.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    table = ranked(firsts, ["_first", key], "template-numbers", "_n")
    table = table.withColumn("_n", F.col("_n") + 1)
    width = F.lit(max(2, len(str(table.count()))))
    return table.select(key, F.concat(F.lit("T"), F.when(F.length(F.col("_n").cast("string")) >= width, F.col("_n").cast("string")).otherwise(F.lpad(F.col("_n").cast("string"), 20, "0").substr(F.lit(21) - width, width))).alias("template_id"))


def file_statistics(records: DataFrame) -> DataFrame:
    """Per file: records, first_ts, last_ts."""
    return records.groupBy("file").agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
