"""Blocks of context around errors: positions of triggers in a stream, merged and selected."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.operators.ordering import carried, preceded, range_ordered, written
from logtide.operators.shipping import ship


def _with_island(triggers: DataFrame, before: int, after: int, position: str) -> DataFrame:
    """(position, island) of each trigger: a new island begins where the one before is further away than both margins reach."""
    t, _ = range_ordered(triggers.select(F.col(position).cast("long").alias("position")), ["position"], "triggers")
    t = preceded(t, "position", "_last")
    near = F.col("position") - F.col("_last") <= before + after + 1
    return carried(t.withColumn("_new", F.when(near, 0).otherwise(1).cast("long")), "_new").select("position", F.col("running").alias("island"))


def islands(triggers: DataFrame, before: int, after: int, length: int, position: str = "position") -> DataFrame:
    """Blocks without a cap: (block, lo, hi, n_triggers), the ranges around triggers, merged where they overlap or touch."""
    return _with_island(triggers, before, after, position).groupBy(F.col("island").alias("block")).agg(
        F.greatest(F.lit(0), F.min("position") - before).cast("long").alias("lo"),
        F.least(F.lit(length - 1), F.max("position") + after).cast("long").alias("hi"),
        F.count("*").alias("n_triggers"),
    )


#: Positions that a task walks at a time, and ranges of positions at most.
CHUNK_POSITIONS, MOST_CHUNKS = 1 << 16, 10_000


class Walk:
    """Blocks of at most ``cap`` records (or one trigger's range) over ascending triggers; a block that is cut leaves its rest to the next.

    All that a block needs to know of those before it is ``free``, the first position that none of
    them covers: the block begins with the first trigger from there on, and no earlier than there.
    """

    def __init__(self, at: list[int], before: int, after: int, cap: int, length: int):
        self.at, self.before, self.after, self.cap, self.length = at, before, after, cap, length
        #: The last trigger of each run whose margins touch.
        self.ends = [i for i in range(len(at)) if i + 1 == len(at) or at[i + 1] - at[i] > before + after + 1]

    def block(self, free: int, until: int) -> tuple[int, int, int, int] | None:
        """(lo, hi, first trigger, trigger behind the last) of the next block; None if it begins at ``until`` or later."""
        i = bisect_left(self.at, free)
        if i == len(self.at) or self.at[i] >= until:
            return None
        lo = max(0, self.at[i] - self.before, free)
        # The block goes on while its triggers touch, and while their margins leave it no longer than the cap.
        last = self.ends[bisect_left(self.ends, i)]
        if self.length - 1 - lo >= self.cap:
            last = min(last, bisect_right(self.at, lo + self.cap - 1 - self.after) - 1)
        hi = min(self.length - 1, self.at[max(i, last)] + self.after)
        return lo, hi, i, bisect_right(self.at, hi)

    def blocks(self, free: int, until: int) -> Iterator[tuple[int, int, list[int]]]:
        while found := self.block(free, until):
            lo, hi, i, end = found
            yield lo, hi, self.at[i:end]
            free = hi + 1

    def exits(self, entries: range, until: int) -> list[int]:
        """Where positions are free behind the blocks that begin before ``until``, for each place from which they may be free; walks that meet go on as one."""
        known: dict[int, int] = {}
        out = []
        for free in entries:
            path = []
            while free not in known:
                path.append(free)
                if (found := self.block(free, until)) is None:
                    known[free] = free
                    break
                free = found[1] + 1
            for x in path:
                known[x] = known[free]
            out.append(known[free])
        return out


def capped(triggers: DataFrame, before: int, after: int, cap: int, length: int, position: str = "position") -> DataFrame:
    """Blocks with a cap: (lo, hi, triggers).

    Where a block ends by the cap depends on where it began, and so on all blocks before it that
    touch; but it only depends on the first position that they leave free, which is one of a few
    behind any place.  So positions are cut into ranges; a task finds where each of these few
    leads to at its range's end, the ranges' tables are followed from one to the next, and
    each range is walked from where it is really entered.  However long a run of triggers is, no
    task has more of it than a range.
    """
    ship(triggers.sparkSession)
    if cap >= length:
        # Nothing is cut.
        lo, hi = F.greatest(F.lit(0), F.min("position") - before).cast("long"), F.least(F.lit(length - 1), F.max("position") + after).cast("long")
        every = _with_island(triggers, before, after, position).groupBy("island").agg(lo.alias("lo"), hi.alias("hi"), F.array_sort(F.collect_list("position")).alias("triggers"))
        return every.drop("island")
    look = max(cap, before + after + 1)
    width = max(CHUNK_POSITIONS, look, -(-length // MOST_CHUNKS))
    at = triggers.select(F.col(position).cast("long").alias("at"))
    chunk = F.floor(F.col("at") / width).cast("long")
    # What a range's last blocks may cover belongs to it as well.
    own = at.select("at", F.explode(F.when((F.col("at") % width < look) & (F.col("at") >= width), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))).alias("chunk"))
    own = written(own, "block-triggers")

    def ranges(batches) -> Iterator[tuple[int, list[int], object]]:
        """(range, its triggers, the last column's value) where a range's rows follow each other."""

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for number, held in groupby(rows(), itemgetter(1)):
            held = list(held)
            yield number, [r[0] for r in held], held[0][-1]

    def entries(number: int) -> range:
        return range(max(0, number * width - before), number * width + look + 1)

    def transfer(batches):
        for number, found, _ in ranges(batches):
            out = Walk(found, before, after, cap, length).exits(entries(number), (number + 1) * width)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([out], pa.list_(pa.int64()))], names=["chunk", "exits"])

    def followed(batches):
        free = 0
        for batch in batches:
            number, exits = batch.column("chunk").to_pylist(), batch.column("exits").to_pylist()
            out = []
            for k, e in zip(number, exits, strict=True):
                entry = max(free, entries(k).start)
                out.append(entry)
                free = e[entry - entries(k).start]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.int64())], names=["chunk", "entry"])

    def walk(batches):
        for number, found, entry in ranges(batches):
            out = []
            for block in Walk(found, before, after, cap, length).blocks(entry, (number + 1) * width):
                out.append(block)
                if len(out) >= 1024:
                    yield _blocks(out)
                    out = []
            if out:
                yield _blocks(out)

    by_chunk = own.repartition("chunk").sortWithinPartitions("chunk", "at").select("at", "chunk")
    # A row for each range, of a few numbers; there are MOST_CHUNKS ranges at most.
    tables = written(by_chunk.mapInArrow(transfer, "chunk long, exits array<long>"), "block-ranges")
    entered = written(tables.coalesce(1).sortWithinPartitions("chunk").mapInArrow(followed, "chunk long, entry long"), "block-entries")
    placed = own.join(F.broadcast(entered), "chunk").repartition("chunk").sortWithinPartitions("chunk", "at").select("at", "chunk", "entry")
    return placed.mapInArrow(walk, "lo long, hi long, triggers array<long>")


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["lo", "hi", "triggers"])


def selected(blocks: DataFrame, triggers: DataFrame, limit: int, position: str = "position", key: str = "template") -> DataFrame:
    """Blocks that are the first with some trigger's template, at most ``limit``, numbered E01, E02, …

    ``blocks`` has lo, hi and triggers; a block that is left out has no template that an
    earlier one hasn't, so being first is the same as being unseen among the kept ones.
    """
    blocks = written(blocks, "blocks")
    members = blocks.select("lo", F.explode("triggers").alias("_at")).join(triggers.select(F.col(position).alias("_at"), F.col(key).alias("_key")), "_at")
    firsts = members.groupBy("_key").agg(F.min("lo").alias("lo")).select("lo").distinct()
    kept = blocks.join(firsts, "lo").orderBy("lo").limit(limit)
    number = F.row_number().over(Window.orderBy("lo"))
    total = F.count("*").over(Window.partitionBy())
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return kept.withColumn("_n", number.cast("string")).withColumn("block", F.concat(F.lit("E"), F.repeat(F.lit("0"), width - F.length("_n")), F.col("_n"))).drop("_n")
