"""Candidates for known noise: templates that recur in normal periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.text import line_id, longest_literal
from logtide.functions.times import Period, within_any
from logtide.operators.noise import Rule, with_match
from logtide.operators.records import WARN

#: Characters that a template's longest fixed piece needs.
LEAST_LITERAL = 8
COMPONENTS_SHOWN = 3


def statistics(records: DataFrame, periods: Sequence[Period], order: Sequence[str], key: str = "template") -> DataFrame:
    """Per template in the periods (ends excluded): n, severity, level, n_hours, n_days, sample (of the first record)."""
    inside = records.where(within_any(F.col("ts"), list(periods)))
    sample = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("@"), line_id(F.col("file"), F.col("lineno"))), F.concat(F.lit("["), F.nullif("component", F.lit("")), F.lit("]")), F.substring("message", 1, 300)) if "lineno" in records.columns else F.substring("message", 1, 300)
    return inside.groupBy(key).agg(
        F.count("*").alias("n"),
        F.max("severity").alias("severity"),
        F.max_by("level", "severity").alias("level"),
        F.countDistinct(F.date_trunc("hour", "ts")).alias("n_hours"),
        F.countDistinct(F.to_date("ts")).alias("n_days"),
        F.min_by(sample, F.struct(*order)).alias("sample"),
    )


def top_components(records: DataFrame, periods: Sequence[Period], key: str = "template") -> DataFrame:
    """(key, components): the most frequent components, as one text."""
    counts = records.where(within_any(F.col("ts"), list(periods))).groupBy(key, F.coalesce("component", F.lit("")).alias("_c")).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), "_c"))).where(F.col("_r") <= COMPONENTS_SHOWN)
    named = F.when(F.col("_c") == "", "-").otherwise(F.col("_c"))
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", named.alias("c")))), lambda s: s["c"]), ", ").alias("components"))


def judged(stats: DataFrame, texts: DataFrame, hours: float, known: Sequence[Rule], rejected: Sequence[Rule], least_count: int, least_hours: int, key: str = "template") -> DataFrame:
    """WARN and worse, with ``why`` they are skipped (null: a candidate): KNOWN, REJECTED, RARE or SHORT; and their hourly rate.

    ``texts``: (key, text).  ``known`` and ``rejected``: the rules whose versions overlap.
    """
    severe = stats.where(F.col("severity") >= WARN).join(texts, key, "left")
    columns = severe.columns
    severe = with_match(with_match(severe, list(known), "text", "_known", "template"), list(rejected), "text", "_rejected", "template")
    hint = longest_literal(F.col("text"))
    why = (
        F.when(F.col("_known").isNotNull(), "KNOWN")
        .when(F.col("_rejected").isNotNull(), "REJECTED")
        .when((F.col("n") < least_count) | (F.col("n_hours") < least_hours), "RARE")
        .when(F.length(hint) < LEAST_LITERAL, "SHORT")
    )
    return severe.select(*columns, hint.alias("search_hint"), why.alias("why"), F.round(F.col("n") / F.lit(hours), 4).alias("per_hour"))


def order(key: str = "template") -> list[Column]:
    """The order in which people go through candidates: the severest and most frequent first."""
    return [F.desc("severity"), F.desc("n"), F.asc(key)]
