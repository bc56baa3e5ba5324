"""The driver's events table as log records, and an incident in it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators.ordering import running
from logtide.operators.records import severity_of

INCIDENT = datetime(2024, 1, 30, 12)
START, END = datetime(2024, 1, 30, 6), datetime(2024, 1, 30, 18)

#: The same view in DuckDB.
LOGS_SQL = """
logs AS (
  SELECT event_id, ts, user_id, value, props, event_type,
         'app-' || (user_id % 4) || '.log' AS file, 'app-' || (user_id % 4) AS alias,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
         CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 ELSE 2 END AS severity,
         event_type AS component, event_type AS template_id, 'U' || user_id AS user_template,
         event_type || ' ' || props AS message
  FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    number = (F.col("user_id") % 4).cast("string")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "value",
        "props",
        "event_type",
        F.concat(F.lit("app-"), number, F.lit(".log")).alias("file"),
        F.concat(F.lit("app-"), number).alias("alias"),
        level.alias("level"),
        severity_of(level).alias("severity"),
        F.col("event_type").alias("component"),
        F.col("event_type").alias("template_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_template"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
    )


def with_lineno(records: DataFrame) -> DataFrame:
    """Lines are numbered per file, as when a file is read from its beginning."""
    ones = records.withColumn("_one", F.lit(1).cast("long"))
    return running(ones, ["file", "ts", "event_id"], "_one", "lined", ["file"]).withColumnRenamed("running", "lineno").drop("_one", "part", "at")


LINED_SQL = LOGS_SQL + ", lined AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS lineno FROM logs)\n"
SEQ_SQL = LOGS_SQL + ", sequenced AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM logs)\n"
