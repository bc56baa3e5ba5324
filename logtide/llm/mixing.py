"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, passed at most
``MAX_PASSES`` times.  A document's virtual finish time is the words of its source up to
and with it, divided by the source's weight.  All queues are then merged: documents are
sorted by finish time over all partitions, and the mix takes them until the budget is
full.  A queue that ran out leaves its share to the others in proportion to their weights.

Null texts have no words and null sources are one source, the last.  Ties of finish time
go to the earlier source, then the smaller id.  An empty table gives no rows.  Rows of equal
id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import attached, numbered, ranked, running_sum, text_or_empty, written

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
MAX_PASSES = 3
SEED = 17


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, n_rows, idx, weight, source_size, total, target; a written table.

    Targets share the total size by weight; none exceeds ``passes`` times its source's size,
    and the excess goes to the others by weight.  Sources may be as many as rows: they are
    ordered over all partitions, and only three sums and the level reach the driver.
    """
    named = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    table = F.array(*[F.lit(w) for w in weights])
    s = ranked(named, [F.col("source").asc_nulls_last()], "mix-names", "idx")
    s = s.withColumn("weight", F.get(table, (F.col("idx") % len(weights)).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * passes)
    # Sources fill up in the order of cap by weight; the level is set where the first one doesn't.
    s = s.withColumn("_full_at", F.col("cap") / F.col("weight"))
    s = running_sum(s, ["_full_at", "idx", "cap", "weight", "source", "source_size", "n_rows"], "cap", "mix-caps").drop("part", "at").withColumnRenamed("running", "_caps")
    s = written(running_sum(s, ["_full_at", "idx"], "weight", "mix-weights").drop("part", "at").withColumnRenamed("running", "_weights"), "mix-fill")
    total, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (total - (F.col("_caps") - F.col("cap"))) / (weight - (F.col("_weights") - F.col("weight")))
    found = s.select("_full_at", "idx", level.alias("level")).where("level <= _full_at").agg(F.min_by("level", F.struct("_full_at", "idx"))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(float(found or 0.0)) * F.col("weight"))
    return written(s.select("source", "n_rows", "idx", "weight", "source_size", F.lit(total).cast("long").alias("total"), target.alias("target")), "mix-sources")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, times (how often it is taken), taken (words)."""
    return _times(docs, F.monotonically_increasing_id(), key, text, source, weights, passes, seed).drop("_row")


def _times(docs: DataFrame, row: Column, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """What ``mix`` gives, with ``_row``, the value of ``row``, which tells rows of equal id apart."""
    rows = written(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), row.alias("_row")), "mix-sizes")
    # A null source is a source, so names are marked before they meet.
    marked = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s")
    sources = source_targets(rows, weights, passes)
    queued = attached(rows.select("doc_id", "size", "_row", marked), sources.select(marked, *[c for c in sources.columns if c != "source"]), "_s", "n_rows").drop("_s", "n_rows")
    queued = queued.withColumn("_shuffle", F.xxhash64(F.lit(seed), "doc_id"))
    queue = running_sum(queued, ["idx", "_shuffle", "doc_id", "size", "_row"], "size", "mix-queues", ["idx"])
    queue = queue.withColumnRenamed("part", "_part").withColumnRenamed("at", "_at").withColumnRenamed("running", "_sofar").drop("_shuffle")

    entries = queue.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    entries = entries.withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_sofar")) / F.col("weight"))
    merged = running_sum(entries, ["_finish", "idx", "_part", "_at", "_pass"], "size", "mix-merged")
    fits = F.col("running") <= F.col("total")
    found = merged.groupBy("doc_id", "_row", "_part", "_at", "size", "source_size", "target").agg(F.sum(fits.cast("int")).alias("times"), F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken"))
    return found.select("doc_id", "size", "source_size", "target", "times", "taken", "_row")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as in ``docs``.  Keys may repeat."""
    rows, row = numbered(docs, key, text)
    times = _times(rows, F.col(row), key, text, **options).where("times > 0").select(F.col("_row").alias("_mix_id"), F.sequence(F.lit(1), F.col("times").cast("int")).alias("_mix_times"))
    # Both sides are unique, so no task gets more than its share.
    taken = rows.join(times.hint("merge"), F.col(row) == F.col("_mix_id"))
    return taken.withColumn("_mix_time", F.explode("_mix_times")).select(*[F.col(f"`{c}`") for c in docs.columns])
