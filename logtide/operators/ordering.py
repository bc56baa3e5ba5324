"""Order over a whole table without a task that sees all of it: written tables, places and running sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_local_dir: list[str] = []
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where a local master has no other machines, and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of its own, in the folder of the innermost ``scope`` if there is one."""
    return f"{_scope.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def scope(spark: SparkSession, name: str = "scope") -> Iterator[str]:
    """Tables that are written inside go at the end, so results must be computed by then."""
    folder = new_path(spark, name)
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        removed(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_ordered(df: DataFrame, keys: list[str | Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Sort ``df`` by ``keys`` over all partitions and write it, with its place.

    Gives the table with ``part`` and ``at`` (place inside the part, from 0), and one row
    per part: ``part``, ``part_rows``.  The last key must be unique, so that no hot value
    makes a part uneven.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = ordered.withColumn("_mono", F.monotonically_increasing_id())
    placed = placed.select(
        *[c for c in placed.columns if c != "_mono"],
        F.shiftright("_mono", 33).cast("int").alias("part"),
        F.col("_mono").bitwiseAND((1 << 33) - 1).alias("at"),
    )
    table = written(placed, name)
    return table, table.groupBy("part").agg(F.count("*").alias("part_rows"))


def ranked(df: DataFrame, keys: list[str | Column], name: str, out: str = "place") -> DataFrame:
    """``df`` with ``out``, its gapless place from 0 in the order of ``keys``.

    The table of parts has one row per shuffle partition, which bounds its broadcast.
    """
    table, parts = range_ordered(df, keys, name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("_before"))
    joined = table.join(F.broadcast(offsets), "part")
    return joined.withColumn(out, F.col("at") + F.col("_before")).drop("part", "at", "_before")


def running(df: DataFrame, keys: list[str | Column], value: str, name: str, within: list[str] | None = None, how: Callable[[str], Column] = F.sum) -> DataFrame:
    """``df`` with ``part``, ``at`` and ``running``: ``how`` (sum, max) of ``value`` up to the row, in the order of ``keys``.

    ``within``: columns without nulls that lead the keys; it starts anew for each value.
    Each part sums up its own rows; what comes before it is added from one row per part (and
    value), so that a hot value spreads over as many tasks as it fills parts.
    """
    table, _ = range_ordered(df, keys, name)
    return carried(table, value, within, how)


def carried(table: DataFrame, value: str, within: list[str] | None = None, how: Callable[[str], Column] = F.sum) -> DataFrame:
    """``table``, which ``range_ordered`` placed, with ``running`` as above; it is read twice."""
    within = within or []
    group = ["part", *within]
    earlier = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(*group).agg(how(value).alias("_sum"))
    offsets = sums.select(*group, how("_sum").over(earlier).alias("_before"))
    own = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = table.withColumn("_own", how(value).over(own))
    out = summed.join(offsets if within else F.broadcast(offsets), group)
    both = F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before") if how is F.sum else F.greatest("_own", "_before")
    return out.withColumn("running", both).drop("_own", "_before")


def running_sum(df: DataFrame, keys: list[str | Column], value: str, name: str, within: list[str] | None = None) -> DataFrame:
    return running(df, keys, value, name, within)


def preceded(table: DataFrame, value: str, out: str) -> DataFrame:
    """``table``, which ``range_ordered`` placed, with ``out``: ``value`` of the row before, null at the first.

    The first row of a part takes the last value of the part before it, from one row per part.
    """
    lasts = table.groupBy("part").agg(F.max_by(value, "at").alias("_last"))
    before = lasts.select("part", F.lag("_last").over(Window.orderBy("part")).alias("_before"))
    own = F.lag(value).over(Window.partitionBy("part").orderBy("at"))
    joined = table.withColumn("_own", own).join(F.broadcast(before), "part")
    return joined.withColumn(out, F.when(F.col("at") == 0, F.col("_before")).otherwise(F.col("_own"))).drop("_own", "_before")


#: A group is hot when it has more than one row of so many; there are fewer hot groups than this, which bounds their broadcast.
HOT_SHARE = 256


def attached(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each value of ``on``, with its number of rows.

    Rows of hot groups take theirs from a broadcast of fewer than HOT_SHARE rows, the others
    by shuffle, so that no task gets a hot group whole.  Rows without a group go.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = groups.where(is_hot)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(groups.where(~is_hot).hint("merge"), on)
    return near.unionByName(far.select(near.columns))
