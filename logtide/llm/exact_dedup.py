"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Null texts count as empty.  Texts are equal when identical after each run of ASCII white
space became one space.  Everything is DataFrame functions: one narrow shuffle of hashes
before which each task pre-aggregates, and the bytes of texts move only where a hash
repeats, pre-aggregated again, so that a group of any size sends one copy a task.
Rows of equal id and text count as separate rows of one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import BLANK, attached, numbered, sized, text_or_empty, without, written

#: Up to so many repeated hashes (16 bytes each) are broadcast to find the texts to compare; more are joined by shuffle.
BROADCAST_HASHES = 500_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), BLANK + "+", " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    ``hashed`` may collide: rows whose hashes agree while their bytes differ are told apart.
    """
    rows = docs.select(F.col(key).alias("doc_id"), normalised(text).alias("norm"))
    marks = written(rows.select("doc_id", hashed(F.col("norm")).alias("h"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "exact-marks")
    groups = written(marks.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")

    repeated = sized(groups.where("group_size > 1").select("h"), BROADCAST_HASHES)
    suspects = rows.withColumn("h", hashed(F.col("norm"))).join(repeated, "h", "left_semi")
    texts = suspects.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    collided = texts.groupBy("h").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("h")
    # One row a collided hash: with 128 bits there are none, and the join below is an empty broadcast.
    collided = written(collided, "exact-collided")

    if collided.isEmpty():
        found = attached(marks, groups, "h", "group_size").drop("h")
    else:
        clean = attached(marks.join(collided, "h", "left_anti"), groups, "h", "group_size").drop("h")
        # Where hashes collide, the bytes themselves are the key.
        mixed = rows.withColumn("h", hashed(F.col("norm"))).join(collided, "h", "left_semi")
        apart = mixed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        own = mixed.join(apart.hint("merge"), "norm").select("doc_id", "keep_id", "group_size", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
        found = clean.unionByName(own)
    # One row stays even where an id repeats with its text: such rows can't be told apart, so all carry the same answer.
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that of the smallest key; columns as in ``docs``.  Keys may repeat, and nulls are the largest."""
    rows, row = numbered(docs, key, text)
    dropped = written(exact_groups(rows, row, text).where("NOT kept").select(F.col("doc_id").alias("_dropped")), "exact-dropped")
    return without(rows, row, dropped).select(*[F.col(f"`{c}`") for c in docs.columns])
