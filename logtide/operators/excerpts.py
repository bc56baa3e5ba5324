"""What a digest shows of tables of any size: the first rows in a stated order, each with its ``place`` from 1.

Spark keeps ``limit`` rows a task, so only bounded rows are numbered.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.baseline import DROP, VANISHED, VERDICTS
from logtide.operators.records import WARN


def first_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows, numbered; the last of ``order`` tells rows apart."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def change_points(points: DataFrame, names: DataFrame, before: date, limit: int) -> DataFrame:
    """Points of earlier days by day; on a day those that vanished come first, then by severity."""
    earlier = points.where(F.col("day") < F.lit(before)).join(names, "template")
    return first_rows(earlier, [F.asc("day"), F.when(F.col("kind") == VANISHED, 0).otherwise(1).asc(), F.desc("severity"), F.asc("template_id")], limit)


def comparisons(found: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Verdicts by kind; of those that became fewer the most expected first, of the others the earliest in the window."""
    kind = F.array_position(F.array(*[F.lit(k) for k in VERDICTS]), F.col("kind"))
    fewer = F.col("kind").isin(VANISHED, DROP)
    order = [kind.asc(), F.when(fewer, -F.col("expected")).asc(), F.when(~fewer, F.col("window_first")).asc(), F.asc("template_id")]
    return first_rows(found.join(names, "template"), order, limit)


def severe(templates: DataFrame) -> DataFrame:
    """Templates of the window that aren't noise, with warnings or triggers."""
    shown = F.col("window_count") > 0
    return templates.where(shown & ~F.col("is_noise") & ((F.col("window_severity") >= WARN) | (F.col("trigger_count") > 0)))


def severe_templates(templates: DataFrame, limit: int) -> DataFrame:
    """Severe templates by their first record in the window."""
    return first_rows(severe(templates), [F.asc("window_first"), F.asc("template_id")], limit)


def noisy_templates(templates: DataFrame, expected: DataFrame, limit: int) -> DataFrame:
    """Noise of the window with the counts to expect, the most frequent first."""
    noisy = templates.where("window_count > 0 AND is_noise").join(expected, "template", "left").fillna(0.0, ["expected"])
    return first_rows(noisy, [F.desc("window_count"), F.asc("window_first"), F.asc("template_id")], limit)


def first_stacks(stream: DataFrame, position: str, limit: int, key: str = "template") -> DataFrame:
    """The first record with a stack trace of each template, with ``n_stacks``, in order of position."""
    stacked = stream.where("has_stack")
    firsts = stacked.groupBy(key).agg(F.min(position).alias(position), F.count("*").alias("n_stacks"))
    return first_rows(stacked.join(firsts, [key, position]), [F.asc(position)], limit)


def block_members(stream: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records of the stream with the block that they lie in; ``blocks`` are the few that are shown."""
    return stream.join(F.broadcast(blocks.select("block", "lo", "hi")), F.col("position").between(F.col("lo"), F.col("hi")))
