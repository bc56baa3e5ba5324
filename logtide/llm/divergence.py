"""Source divergence audit: how far the sources of a language are apart in their words, and by which.

Counts of terms by (language, source) are smoothed to whole numbers p, and two sources differ by
the sum of abs(p - q) over the language's kept terms.  The sum is split in two:

* Heavy terms, which occur in at least a share of the language's sources, are laid into dense
  tiles (terms by sources, sources without the term at their smoothed zero), and differences are
  taken tile by tile with numpy.
* Light terms stay posting lists.  A light term moves the difference of two sources away from what
  it is if neither had it.  That is a correction for each source that has the term, which only
  depends on its p and the other source's zero and is summed over a histogram of p, and another
  one for each pair of sources that both have it.

All is whole numbers, so both partial sums add up to the exact one.  Tasks add pairs up in blocks
of sources and emit sums, never a row for a pair and term.

Null texts, languages and sources count as ''.  Groups without terms are there, with counts of 0;
a language without kept terms has pairs of value 0 and no term rows.  Repeated rows are rows of
their own.  Sums are exact up to 9 thousand million kept terms a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import sized, small_batches, text_or_empty, tidied, written

#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 30
#: Ranks of terms that are returned for a group.
TOP_TERMS = 50
#: Added to each count, and what shares are multiplied by.
ADDED, SCALE = 5, 1_000_000_000
#: A term is heavy if it occurs in at least one of so many sources of its language.
DENSE_ONE_IN = 4
#: Sources on a side of a block of pairs, numbers in a tile of terms by sources, and blocks that a task holds before it emits them.
BLOCK, TILE, MOST_BLOCKS = 256, 1 << 20, 64
#: Distinct terms that a task counts before it emits them, and bytes of a text that are looked at in one go.
MOST_TERMS, CHUNK = 250_000, 1 << 20
#: Groups up to which their table is broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 100_000

#: Bytes of terms stay, with A to Z in lower case; all others become spaces.  Bytes of characters beyond ASCII are all over 0x7F.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        # A chunk ends behind the first separator from there on.
        while end < len(text) and _TERM_BYTES[text[end - 1]] != 0x20:
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = counts[lang, source]
            held -= len(group)
            own: set[bytes] = {b""}
            for terms in term_pieces(text):
                group.update(terms)
                own.update(terms)
            # The empty term stands for the group itself.
            group[b""] = 0
            docs[lang, source].update(own)
            held += len(group)
            if held > MOST_TERMS:
                yield from _counted(counts, docs)
                held = 0
    yield from _counted(counts, docs)


def _counted(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), group in counts.items():
        terms, own = list(group), docs[lang, source]
        for at in range(0, len(terms), 20_000):
            some = terms[at : at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([group[t] for t in some], pa.int64()), pa.array([own[t] for t in some], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
    counts.clear()
    docs.clear()


def kept_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, postings: source and n) of the kept terms, a written table; the empty term's postings are all sources of the language."""
    small_batches(docs.sparkSession)
    sent = docs.select(text_or_empty(lang).alias("lang"), text_or_empty(source).alias("source"), text_or_empty(text).cast("binary").alias("text"))
    counted = sent.mapInArrow(tidied(_count), "lang string, source string, term binary, n long, docs long")
    # Dealt by language and term, so that both sums are made behind one shuffle; a task sends a term once a source, however frequent it is.
    of_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = of_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = of_term.where((F.col("docs") >= least_docs) | (F.length("term") == 0))
    return written(kept.select("lang", F.col("term").cast("string").alias("term"), "postings"), "divergence-kept")


def _share(n: str, total: str, v: str):
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * v)), exact beyond 64 bits; null where there is no term."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {ADDED} AS DECIMAL(20, 0))) DIV CAST({total} + {ADDED} * {v} AS DECIMAL(20, 0)) END")


def source_groups(kept: DataFrame) -> DataFrame:
    """(lang, source, gid, total, p0, lang_total, v, n_groups), a written table; gid counts from 0 within the language."""
    flat = kept.select("lang", F.length("term").alias("_at"), F.explode("postings").alias("p"))
    sums = flat.groupBy("lang", "p.source").agg(F.sum(F.when(F.col("_at") > 0, F.col("p.n")).otherwise(0)).alias("total"))
    terms = kept.groupBy("lang").agg(F.count_if(F.length("term") > 0).alias("v"))
    of_lang = Window.partitionBy("lang")
    groups = sums.join(terms, "lang").select("*", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("gid"), F.sum("total").over(of_lang).alias("lang_total"), F.count("*").over(of_lang).cast("int").alias("n_groups"))
    return written(groups.withColumn("p0", F.coalesce(_share("0", "total", "v"), F.lit(0))), "divergence-groups")


def postings(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, k, all, source, gid, n, p, p0, n_groups): one row per kept term and source that has it, a written table."""
    flat = kept.where("term <> ''").select("lang", "term", F.size("postings").alias("k"), F.expr("aggregate(postings, 0L, (s, p) -> s + p.n)").alias("all"), F.explode("postings").alias("_p"))
    flat = flat.select("lang", "term", "k", "all", "_p.source", "_p.n").join(sized(groups, BROADCAST_GROUPS), ["lang", "source"])
    return written(flat.select("*", _share("n", "total", "v").alias("p"), _share("all", "lang_total", "v").alias("q")), "divergence-postings")


class _Blocks:
    """Sums of pairs of sources, by language and pair of blocks of sources."""

    def __init__(self):
        self.sums: dict[tuple, np.ndarray] = {}

    def at(self, lang: str, a: int, b: int) -> np.ndarray:
        if (found := self.sums.get((lang, a, b))) is None:
            found = self.sums[lang, a, b] = np.zeros((BLOCK, BLOCK), np.int64)
        return found

    def emitted(self) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), block in self.sums.items():
            rows, columns = np.nonzero(np.triu(block, 1) if a == b else block)
            yield _pairs(lang, rows + a * BLOCK, columns + b * BLOCK, block[rows, columns])
        self.sums.clear()


def _pairs(lang: str, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(lo), pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(value, pa.int64())], names=["lang", "lo", "hi", "value"])


def _cuts(gids: np.ndarray) -> list[tuple[int, slice]]:
    """(block, where its sources are) in ascending gids."""
    blocks = gids // BLOCK
    begins = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(gids)]
    return [(int(blocks[a]), slice(a, b)) for a, b in zip(begins, begins[1:], strict=False)]


def sparse_corrections(lang: str, gids: np.ndarray, p: np.ndarray, p0: np.ndarray, to: _Blocks) -> None:
    """Add for each pair of sources that have a term what it moves their difference beyond both sources' own corrections."""
    cuts = _cuts(gids)
    for i, (a, x) in enumerate(cuts):
        for b, y in cuts[i:]:
            moved = np.abs(p[x, None] - p[y]) - np.abs(p[x, None] - p0[y]) - np.abs(p0[x, None] - p[y]) + np.abs(p0[x, None] - p0[y])
            to.at(lang, a, b)[np.ix_(gids[x] % BLOCK, gids[y] % BLOCK)] += moved


def dense_tile(lang: str, tile: np.ndarray, to: _Blocks) -> None:
    """Add the differences of all pairs of sources over a tile: a row for each term, a column for each source."""
    begins = range(0, tile.shape[1], BLOCK)
    for a in begins:
        for b in begins[a // BLOCK :]:
            sums, right = to.at(lang, a // BLOCK, b // BLOCK), tile[:, b : b + BLOCK]
            for i in range(min(BLOCK, tile.shape[1] - a)):
                sums[i, : right.shape[1]] += np.abs(right - tile[:, a + i, None]).sum(axis=0)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are (lang, found: gid, p and p0; zeros: all p0 of the language, for heavy terms only)."""
    blocks, tiles = _Blocks(), {}
    for batch in batches:
        for lang, found, zeros in zip(*(batch.column(i) for i in range(3)), strict=True):
            lang, values = lang.as_py(), found.values
            gids, p, p0 = (values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not zeros.is_valid:
                order = np.argsort(gids)
                sparse_corrections(lang, gids[order], p[order], p0[order], blocks)
            else:
                row = zeros.values.to_numpy(zero_copy_only=False).copy()
                row[gids] = p
                tile = tiles.setdefault(lang, [])
                tile.append(row)
                if len(tile) * len(row) >= TILE:
                    dense_tile(lang, np.stack(tiles.pop(lang)), blocks)
            if len(blocks.sums) > MOST_BLOCKS or sum(len(t) * len(t[0]) for t in tiles.values()) > 8 * TILE:
                for of, tile in tiles.items():
                    dense_tile(of, np.stack(tile), blocks)
                tiles.clear()
                yield from blocks.emitted()
    for lang, tile in tiles.items():
        dense_tile(lang, np.stack(tile), blocks)
    yield from blocks.emitted()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are (lang, gid, light: light terms of the language, found: p and n of the source's light terms, zeros: all p0 of the language).

    Emits for the source and each other one what light terms add if the other has none of them;
    with sources behind it, also what they add if neither has.
    """
    for batch in batches:
        for lang, gid, light, found, zeros in zip(*batch.columns, strict=True):
            lang, gid, light = lang.as_py(), gid.as_py(), light.as_py()
            p0 = zeros.values.to_numpy(zero_copy_only=False)
            p, n = (found.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)) if found.is_valid else (np.zeros(0, np.int64),) * 2
            order = np.argsort(p)
            p, n = p[order], n[order]
            count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
            below = np.searchsorted(p, p0)
            away = count[below] * p0 - total[below] + (total[-1] - total[below]) - (count[-1] - count[below]) * p0
            neither = np.abs(p0 - p0[gid])
            value = away - count[-1] * neither
            others = np.arange(len(p0))
            value += np.where(others > gid, light * neither, 0)
            for at in range(0, len(p0), 20_000):
                some = others[at : at + 20_000]
                some = some[some != gid]
                yield _pairs(lang, np.minimum(some, gid), np.maximum(some, gid), value[some])


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, lo, hi, value) of each pair of a language's sources, by gid; ``rows`` are postings."""
    heavy = F.col("k") * DENSE_ONE_IN >= F.col("n_groups")
    few = groups.count() <= BROADCAST_GROUPS
    # One row a language, with a number for each of its groups.
    zeros = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("gid", "p0"))), lambda s: s["p0"]).alias("zeros"))

    def with_zeros(df: DataFrame, how: str = "inner") -> DataFrame:
        if few:
            return df.join(F.broadcast(zeros), "lang", how)
        # A language may have most rows, so its array goes to many tasks.
        salts = 64
        spread = zeros.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["lang", "_salt"], how).drop("_salt")

    of_term = rows.groupBy("lang", "term", heavy.alias("heavy")).agg(F.collect_list(F.struct("gid", "p", "p0")).alias("found"))
    dense = with_zeros(of_term.where("heavy")).select("lang", "found", "zeros")
    sparse = of_term.where("NOT heavy AND size(found) > 1").select("lang", "found", F.lit(None).cast("array<bigint>").alias("zeros"))
    pair_schema = "lang string, lo int, hi int, value long"
    compared = dense.unionByName(sparse).mapInArrow(tidied(_compare), pair_schema)

    light = rows.where(~heavy)
    histogram = light.groupBy("lang", "gid", "p").agg(F.count("*").alias("n")).groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "n")).alias("found"))
    # Each light term once: its first source's posting stands for it.
    terms = light.groupBy("lang", "term").agg(F.lit(1).alias("_one")).groupBy("lang").agg(F.count("*").alias("light"))
    own = groups.select("lang", "gid").join(histogram, ["lang", "gid"], "left").join(terms, "lang", "left")
    own = with_zeros(own).select("lang", "gid", F.coalesce("light", F.lit(0)).alias("light"), "found", "zeros")
    return compared.unionByName(own.mapInArrow(tidied(_alone), pair_schema)).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for the terms that set a source most above its language."""
    kept = kept_terms(docs, lang, source, text, least_docs)
    groups = source_groups(kept)
    rows = postings(kept, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Spark keeps each task's first rows of a group before it shuffles them.
    terms = rows.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    both = written(pair_values(rows, groups), "divergence-pairs").select("lang", "value", F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("_ab"))
    both = both.select("lang", "value", "_ab.a", "_ab.b")
    for gid, name in (("a", "source"), ("b", "item")):
        both = both.join(sized(groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(name)), BROADCAST_GROUPS), ["lang", gid])
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
