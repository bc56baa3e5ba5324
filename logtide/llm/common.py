"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators.ordering import attached, range_ordered, ranked, running_sum, scratch_dir, written
from logtide.operators.shipping import ship

__all__ = ["attached", "documents", "free_name", "map_rows", "numbered", "over_cores", "range_ordered", "ranked", "running_sum", "scratch_dir", "shuffle_partitions", "sized", "small_batches", "table", "text_or_empty", "tidied", "without", "written"]

#: Rows that a Python task turns into objects at a time.
SLICE_ROWS = 256
#: ASCII white space of the contracts, as a Java and Python character class.
BLANK = r"[\x20\x09-\x0D]"


def over_cores(df: DataFrame) -> DataFrame:
    """``df``; rows of a table that is read in fewer tasks than there are cores are dealt over all cores first."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return over_cores(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Make workers ready for texts: the package on their path, and batches of a few MB where a user hasn't set less.

    The usual 10,000 rows of long texts are tens of MB, which the JVM holds outside its heap
    and the worker holds as well, for each task.
    """
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def tidied(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, which gives memory back at a task's end.

    Allocators keep what was freed, and workers wait for later stages beside those of other
    plans; so what is kept by each would add up.
    """

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        # Of glibc; others have no such call.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``fn`` over the rows of each partition, a bounded slice of an Arrow batch at a time.

    ``fn`` takes an iterator of dicts and yields tuples of ``schema``.
    """
    small_batches(df.sparkSession)
    fields = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from batch.slice(at, SLICE_ROWS).to_pylist()

    def run(batches):
        held: list[tuple] = []
        for out in fn(rows(batches)):
            held.append(out)
            if len(held) >= SLICE_ROWS:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(tidied(run), fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Ids (8 bytes each) up to which a list of them is broadcast; longer lists are joined by shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, a written table of narrow rows, marked for broadcast if it is short enough, else for a join by shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")


def without(docs: DataFrame, key: str, dropped: DataFrame, name: str = "_dropped") -> DataFrame:
    """``docs`` without the rows whose key is in column ``name`` of the written table ``dropped``."""
    return docs.join(sized(dropped.select(name)), F.col(f"`{key}`") == F.col(name), "left_anti")


def numbered(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart.

    That is ``key`` where it is an integer, unique and has no nulls.  Else it is a new column
    of a written copy: the row's place in the order of key (nulls last) and text.
    """
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        ids = docs.select(F.col(f"`{key}`").alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
        most, nulls = ids.agg(F.max("_n"), F.max(F.col("_k").isNull())).first()
        if not nulls and (most or 0) <= 1:
            return docs, key
    name = free_name(docs, "_row")
    # The last key tells equal rows apart, so that a row that repeats often spreads over tasks.
    rows = docs.select(F.struct("*").alias("_doc"), F.col(f"`{key}`").alias("_k"), F.xxhash64(text_or_empty(text)).alias("_h"), F.monotonically_increasing_id().alias("_m"))
    return ranked(rows, [F.col("_k").asc_nulls_last(), "_h", "_m"], "numbered").select("_doc.*", F.col("place").alias(name)), name
