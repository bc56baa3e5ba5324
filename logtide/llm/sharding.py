"""Sharding along a Hilbert curve: near rows share a shard in every metadata dimension at once.

The dimensions are quantised by ranks: a row's cell says which part of all rows has smaller
values, so that cells are even however values are spread, and equal values share a cell.
The curve index orders the rows, and the order is cut into runs.  A reader that filters on
any of the dimensions can then skip most files by their minimum and maximum.  With few
shards only the curve's first turns matter, so a dimension may sit out the first of them.

Rows whose text occurs more than once lie before all others, along the curve by the first
row of their group, copies beside copies: a group is cut by a shard's end only, and spoils
the ranges of no shard of other rows.  (Along with the others, copies of other sources would lie
in all shards: a source then met 7.9 of 8 at sf0.1, not 4.9.)

Null values of a dimension take its lowest cell; null texts have no bytes.  Ids that aren't
numbers are no dimension.  Rows of equal id are rows of their own.  All steps are DataFrame
functions; the text itself is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.common import attached, numbered, ranked, running_sum, text_or_empty, written
from logtide.operators.ordering import HOT_SHARE

#: Bits of each dimension on the curve.
BITS = 6
#: The first turns of the curve that numbers (size and id) sit out, so that names split the shards first.
SIT_OUT = 1
#: How exact the quantiles of numbers are: an error of one in so many of the rows.
ACCURACY = 10_000


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve through a grid of ``2**bits`` cells a side, by the axes-to-transpose rule (Skilling 2004).

    For each bit, from the highest to the second, and each axis: where the axis has the bit,
    the lower bits of the first axis are inverted, else they are exchanged with the axis's.
    """
    n = len(cells)

    def steps(lowest: int) -> Column:
        return F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, lowest - 1, -1) for i in range(n)]).cast("array<struct<bit:bigint,axis:int>>")

    def turned(x: Column, step: Column) -> Column:
        low = step["bit"] - 1
        has = F.get(x, step["axis"]).bitwiseAND(step["bit"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, step["axis"])).bitwiseAND(low)
        inverted = F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = F.transform(x, lambda v, k: F.when((k == 0) | (k == step["axis"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(has, inverted).otherwise(exchanged)

    def gray(x: Column) -> Column:
        """Each axis takes up all axes before it."""
        zero = F.lit(0).cast("long")
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k + 1), zero, lambda a, v: a.bitwiseXOR(v)))

    def parity(g: Column) -> Column:
        """The last axis's higher bits turn all axes."""
        highs = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]).cast("array<bigint>")
        return F.aggregate(highs, F.lit(0).cast("long"), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def woven(g: Column) -> Column:
        return F.aggregate(steps(0), F.lit(0).cast("long"), lambda acc, s: acc * 2 + F.when(F.get(g, s["axis"]).bitwiseAND(s["bit"]) != 0, 1).otherwise(0))

    x = F.aggregate(steps(1), F.array(*[c.cast("long") for c in cells]), turned)
    return _let(x, lambda x: _let(gray(x), lambda g: _let(parity(g), lambda t: _let(F.transform(g, lambda v: v.bitwiseXOR(t)), woven))))


def quantile_cell(value: Column, bounds: list[float], bits: int = BITS) -> Column:
    """Cell of a number among the quantiles ``bounds`` of all rows, ascending; nulls go to cell 0."""
    if not bounds:
        return F.lit(0).cast("long")
    # By halving: a row is compared with as many bounds as the cell has bits.
    table = F.array(*[F.lit(float(b)) for b in bounds])
    cell = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        step = 1 << bit
        cell = cell + F.when(F.get(table, (cell + step - 1).cast("int")) < value, step).otherwise(0)
    return F.coalesce(cell, F.lit(0).cast("long"))


def name_cells(rows: DataFrame, name: str, total: int, bits: int = BITS) -> DataFrame:
    """(name, n, cell) of each value of the column ``name``: the share of rows with smaller values, in cells."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    before = running_sum(counts, [name], "n", "hilbert-names")
    return written(before.select(name, "n", F.expr(f"(running - n) * {1 << bits} DIV {max(total, 1)}").cast("long").alias("cell")), "hilbert-cells")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), sit_out: int = SIT_OUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    Law ``rows``: the counts of shards are at most one apart.
    """
    return _sharded(docs, shards, key, text, names, sit_out)


def _sharded(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), sit_out: int = SIT_OUT, row: str | None = None) -> DataFrame:
    """What ``shard_documents`` gives, with ``_row``, the value of a column that tells rows of equal key apart, if there is one."""
    own = [F.col(f"`{row}`").alias("_row")] if row else []
    body = text_or_empty(text).cast("binary")
    # Nulls come before all names, empty ones too.
    marked = [F.coalesce(F.concat(F.lit("="), F.col(f"`{n}`").cast("string")), F.lit("")).alias(f"_n{i}") for i, n in enumerate(names)]
    numeric = isinstance(docs.schema[key].dataType, T.NumericType)
    place = F.col(f"`{key}`").cast("double" if numeric else "string")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), place.alias("_place"), *marked, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_text"), *own)
    rows = written(rows, "hilbert-rows")

    # Copies take the place of their group's first row; hashes that collide only lay two groups side by side.
    first = F.struct("_place", *[f"_n{i}" for i in range(len(names))])
    groups = written(rows.groupBy("_text").agg(F.count("*").alias("_copies"), F.min(first).alias("_first")).where("_copies > 1"), "hilbert-groups")
    copies = attached(rows, groups, "_text", "_copies")
    copies = copies.select(*["doc_id", "size", "text_crc32", "_text", *["_row"] * len(own)], F.lit(0).alias("_single"), "_first.*")
    singles = _without_groups(rows, groups).withColumn("_single", F.lit(1))
    placed = copies.unionByName(singles.select(copies.columns))

    points = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    numbers = F.struct(F.count("*").alias("n"), *[F.percentile_approx(c, points, ACCURACY).alias(c) for c in ["size", *["_place"] * numeric]])
    found = rows.select(numbers.alias("q")).first()["q"]
    cells = []
    for i in range(len(names)):
        name = f"_n{i}"
        placed = attached(placed, name_cells(rows, name, found["n"]).withColumnRenamed("cell", f"_c{i}").withColumnRenamed("n", f"_m{i}"), name, f"_m{i}").drop(name, f"_m{i}")
        cells.append(F.col(f"_c{i}"))
    cells += [F.shiftright(quantile_cell(F.col(c).cast("double"), found[c] or []), sit_out) for c in ["size", *["_place"] * numeric]]
    keep = ["doc_id", "size", "text_crc32", "_text", "_single", *["_row"] * len(own)]
    curved = placed.select(*keep, hilbert_index(cells).alias("curve"))
    order = ["_single", "curve", "_text", "doc_id", *["_row"] * len(own)]
    placed = ranked(curved, order, "hilbert")
    # Shard s begins at the first place p with p * shards DIV total = s.
    total = max(found["n"], 1)
    shard = F.expr(f"place * {shards} DIV {total}")
    begins = F.expr(f"((place * {shards} DIV {total}) * {total} + {shards - 1}) DIV {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("place") - begins).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *["_row"] * len(own))


def _without_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose text occurs once.  Those of hot groups go by broadcast first, so that no task gets a hot group whole."""
    total = groups.agg(F.sum("_copies")).first()[0] or 0
    hot = groups.where(F.col("_copies") * HOT_SHARE > F.lit(total)).select("_text")
    return rows.join(F.broadcast(hot), "_text", "left_anti").join(groups.select("_text").hint("merge"), "_text", "left_anti")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", shard: str = "shard") -> None:
    """Write ``docs`` as one folder a shard, in curve order; extra columns are kept.

    Keys may repeat.  A column of ``docs`` that is called ``shard`` goes, since the folders are named by it.
    """
    rows, row = numbered(docs, key)
    where = _sharded(rows, shards, key, row=row).select(F.col("_row").alias("_where_id"), F.col("shard").alias("_where_shard"), F.col("slot").alias("_where_slot"))
    kept = rows.join(where, F.col(f"`{row}`") == F.col("_where_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != shard.lower()]
    ordered = kept.repartitionByRange("_where_shard", "_where_slot").sortWithinPartitions("_where_shard", "_where_slot")
    ordered.select(*columns, F.col("_where_shard").alias(shard)).write.partitionBy(shard).parquet(path)
