"""Near-dedup: SuperMinHash signatures, banding, exact verification and union-find grouping.

A text's set is its distinct five-word shingles (64-bit hashes of them), words being runs
without ASCII white space with A-Z lower-cased; with fewer words, the whole sequence is its
one shingle.  Texts with 100 * intersection >= 75 * union are linked, and linked texts form
groups.  Texts without words, and nulls, are linked with nothing.

1. Texts of equal sets form classes; only a class's smallest id goes on.
2. 32 bands of 4 signature registers put it into buckets; a bucket's smallest id is its hub.
   A pair at the threshold misses all buckets with a probability of 5e-6.
3. Each member is verified against its hub on full sets, in blocks, and linked.
4. What lies in one group by now needs no further comparison.  Members outside the hub's
   group are compared with the members of the bucket whose sets are of a size that can be
   linked, block by block; a block gives only the links that join groups.  So no link is
   lost, and no pairs are listed.
5. Union-find over all links, as repeated joins of the smallest label.

Ids may be null or repeat, and may be of any type: rows count by their place in the order of
id (nulls last) and text, and a group's id is that of its first row.  Of such rows,
``near_dedup`` keeps the first; in ``near_groups`` all rows of the group's id are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import attached, map_rows, numbered, sized, small_batches, tidied, without, written

WIDTH = 5
#: Links need this share, in hundredths, of the union.
SHARE = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Members that a block compares on either side, and shingles (8 bytes each) that they have, on average.
BLOCK = 128
BLOCK_SHINGLES = 1 << 21
#: Sets whose sizes are this factor apart can't be linked (100 / SHARE is enough; a little more is safe from rounding); sizes are
#: put into levels by its powers, so links are within a level or to the next.
LEVEL = 100 / SHARE + 0.01
#: Words whose hashes a worker remembers.
MEMO_WORDS = 100_000
#: Columns of the membership matrix that are multiplied at a time.
MATRIX_COLUMNS = 4_096

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 pseudo-random bits of each number and a salt (the finaliser of splitmix64)."""
    x = x + np.uint64(salt * _STEP & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, words: dict) -> np.ndarray:
    """The text's set, sorted."""
    # Bytes lower-case and split by ASCII alone.
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(hashes):
        return hashes
    width = min(WIDTH, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out ^ hashes[i : len(hashes) - width + 1 + i], i + 1)
    return np.unique(out)


def superminhash(items: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash (Ertl 2017): in step j each item draws a value in [j, j + 1) for the j-th register of its own random permutation.

    The steps run over all items at once and stop as soon as every register holds a value
    below the next step's.  Registers are a step in the upper 16 bits and the value's fraction.
    """
    held = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    if not len(items):
        return held
    order = None
    rows = np.arange(len(items))
    for j in range(registers):
        draw = _mixed(items, 2 * j + 1)
        other = (j + _mixed(items, 2 * j + 2) % np.uint64(registers - j)).astype(np.intp)
        if j == 0:
            register = other
        else:
            if order is None:
                order = np.broadcast_to(np.arange(registers, dtype=np.int16), (len(items), registers)).copy()
                order[rows, 0], order[rows, first] = first, 0
            register = order[rows, other]
            order[rows, other] = order[:, j]
        value = (draw >> np.uint64(16)) | np.uint64(j << 48)
        np.minimum.at(held, register, value)
        if j == 0:
            first = other
        if int(held.max()) >> 48 <= j:
            break
    return held


def bands(signature: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in signature.reshape(BANDS, ROWS).T:
        keys = _mixed(keys ^ row, 7)
    return keys.view(np.int64)


def _sketch(rows: Iterator[dict]) -> Iterator[tuple]:
    words = Words()
    for row in rows:
        own = shingles(row["text"], words)
        if len(own):
            yield row["doc_id"], len(own), xxhash.xxh3_128_digest(own.tobytes()), bands(superminhash(own)).tolist()
        else:
            yield row["doc_id"], 0, None, None


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_key (128-bit hash of the set), bands."""
    sent = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(sent, _sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(rows: Iterator[dict]) -> Iterator[tuple]:
    words = Words()
    for row in rows:
        yield row["doc_id"], shingles(row["text"], words).tobytes()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    ends = np.cumsum([len(s) for s in right])
    starts = ends - [len(s) for s in right]
    all_right = np.concatenate(right)
    if len(left) <= 4:
        out = np.empty((len(left), len(right)), np.int64)
        for i, own in enumerate(left):
            at = np.minimum(np.searchsorted(own, all_right), len(own) - 1)
            out[i] = np.add.reduceat((own[at] == all_right).astype(np.int64), starts)
        return out
    # Only items that both sides hold can be shared; each is a column of two 0/1 matrices.
    all_left = np.concatenate(left)
    shared = np.intersect1d(all_left, all_right)
    out = np.zeros((len(left), len(right)), np.float32)

    def rows_columns(sets: list[np.ndarray], items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, items), max(len(shared) - 1, 0))
        hit = shared[at] == items if len(shared) else np.zeros(len(items), bool)
        return row[hit], at[hit]

    (lr, lc), (rr, rc) = rows_columns(left, all_left), rows_columns(right, all_right)
    for low in range(0, len(shared), MATRIX_COLUMNS):
        width = min(MATRIX_COLUMNS, len(shared) - low)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = (lc >= low) & (lc < low + width)
        a[lr[here], lc[here] - low] = 1
        here = (rc >= low) & (rc < low + width)
        b[rr[here], rc[here] - low] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def _block_links(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between the two sides of a block that join groups, as few as do: rows are (side, doc_id, group, set)."""
    left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    if not left or not right:
        return []
    a, b = [np.frombuffer(r[3], np.uint64) for r in left], [np.frombuffer(r[3], np.uint64) for r in right]
    shared = _overlaps(a, b)
    sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    links = []
    for i, j in zip(*np.nonzero(100 * shared >= SHARE * (sizes - shared)), strict=True):
        (_, x, gx, _), (_, y, gy, _) = left[i], right[j]
        if (p := root(gx)) != (q := root(gy)):
            parent[max(p, q)] = min(p, q)
            links.append((min(x, y), max(x, y)))
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive one after the other, sorted by (hub, a, b)."""
    block, rows, out = None, [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for part in batches:
        for hub, a, b, *row in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if (hub, a, b) != block:
                out += _block_links(rows)
                block, rows = (hub, a, b), []
            rows.append(tuple(row))
        if out:
            yield batch()
            out = []
    out += _block_links(rows)
    if out:
        yield batch()


def _links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (u < v) of blocks (hub, a, b, side, doc_id, group)."""
    small_batches(blocks.sparkSession)
    carried = blocks.join(sets.hint("merge"), "doc_id").select("hub", "a", "b", "side", "doc_id", "group", "items")
    return carried.repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b").mapInArrow(tidied(_verify), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of a link (u, v); a written table.

    Each round takes the smallest label among a node and its neighbours, then the label's own
    label, until none changes.
    """
    both = written(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"), F.count("*").alias("n_links")), "near-labels")
    while True:
        # A node with many links takes its label from a broadcast of few.
        near = attached(both, labels.select(F.col("node").alias("v"), "component", "n_links"), "v", "n_links").groupBy(F.col("u").alias("_n")).agg(F.min("component").alias("_low"))
        lower = labels.join(near, F.col("node") == F.col("_n")).select("node", "component", "n_links", F.least("component", "_low").alias("_low"))
        up = labels.select(F.col("node").alias("_up"), F.col("component").alias("_up_component"))
        jumped = lower.join(up, F.col("_low") == F.col("_up")).select("node", "n_links", F.least("_low", "_up_component").alias("component"), (F.least("_low", "_up_component") != F.col("component")).alias("moved"))
        labels = written(jumped, "near-labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "component")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, row = numbered(docs, key, text)
    groups = _groups(rows, row, text)
    if row == key:
        return groups
    # Back from places to ids: of the row itself and of its group's first row.
    ids = rows.select(F.col(row).alias("_at"), F.col(f"`{key}`").alias("_id"))
    own = groups.join(ids.hint("merge"), F.col("doc_id") == F.col("_at")).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
    # A group's first row is met by all its rows, which may be many.
    sizes = written(own.groupBy("component_id").agg(F.count("*").alias("_n")).join(ids, F.col("component_id") == F.col("_at")).select("component_id", "_n", "_id"), "near-firsts")
    return attached(own, sizes, "component_id", "_n").select("doc_id", "n_shingles", F.col("_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("_id")).alias("kept"))


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same for a column of unique integers."""
    sketch = written(sketches(docs, key, text), "near-sketches")
    full = sketch.where("n_shingles > 0")
    classes = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "near-classes")
    reps = full.select("doc_id", "n_shingles", "bands").join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    keyed = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    keyed = written(keyed, "near-bands")
    buckets = keyed.groupBy("band").agg(F.min(F.struct("doc_id", "n_shingles")).alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.select("band", "n", F.col("first.doc_id").alias("hub"), F.col("first.n_shingles").alias("hub_size")), "near-buckets")
    members = attached(keyed, buckets, "band", "n").where("doc_id <> hub").groupBy("hub", "doc_id").agg(F.first("n_shingles").alias("size"), F.first("hub_size").alias("hub_size"))
    members = written(members, "near-members")

    ids = written(members.select("doc_id").union(members.select("hub")).distinct(), "near-ids")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = written(map_rows(source.join(sized(ids), "doc_id", "left_semi"), _sets, "doc_id long, items binary"), "near-sets")

    # Each member against its hub: sizes further apart than the share can't be linked.
    fit = members.where((F.least("size", "hub_size") * 100) >= F.greatest("size", "hub_size") * SHARE)
    # Written, so that the members of a hot hub aren't dealt out by hub to meet one row.
    numbers = sized(written(fit.groupBy("hub").agg(_blocks("size").alias("n_blocks")), "near-numbers"))
    placed = fit.join(numbers, "hub").select("hub", F.lit(0).cast("long").alias("a"), F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).alias("b"), F.lit(1).alias("side"), "doc_id", F.col("doc_id").alias("group"))
    hubs = numbers.select("hub", F.lit(0).cast("long").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"), F.lit(0).alias("side"), F.col("hub").alias("doc_id"), F.col("hub").alias("group"))
    stars = written(_links(placed.unionByName(hubs), sets), "near-links")
    first = components(stars)

    links = stars.unionByName(_links(_open_blocks(members, first), sets))
    final = components(written(links, "near-links"))
    groups = classes.join(final, F.col("rep") == F.col("node"), "left").select("set_key", "n_rows", F.coalesce("component", "rep").alias("component_id"))
    found = attached(full.select("doc_id", "n_shingles", "set_key"), written(groups, "near-groups"), "set_key", "n_rows")
    none = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = found.select("doc_id", "n_shingles", "component_id").unionByName(none)
    return every.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _blocks(size: str) -> Column:
    """Blocks that a group of members is dealt to, so that neither members nor their shingles are too many."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_SHINGLES))


def _open_blocks(members: DataFrame, first: DataFrame) -> DataFrame:
    """Blocks of members outside their hub's group against the members of the hub, by levels of size; hub and members are compared already."""

    def grouped(rows: DataFrame, of: str, name: str) -> DataFrame:
        labels = first.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return rows.join(labels, F.col(of) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", of)).drop("_node", "_component")

    everyone = grouped(grouped(members.select("hub", "doc_id", "size"), "doc_id", "group"), "hub", "hub_group")
    level = F.floor(F.log("size") / math.log(LEVEL)).cast("int")
    everyone = written(everyone.select("hub", "doc_id", "group", "size", level.alias("level"), (F.col("group") != F.col("hub_group")).alias("outside")), "near-everyone")
    # A level's open members meet the members of the levels beside it and of its own.
    beside = everyone.withColumn("of", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)))
    own = everyone.where("outside").groupBy("hub", F.col("level").alias("of")).agg(_blocks("size").alias("n_a"))
    met = beside.groupBy("hub", "of").agg(_blocks("size").alias("n_b"), F.count("*").alias("n_all"))
    # A member that is alone there has nothing left to meet.
    counts = own.join(met, ["hub", "of"]).where("n_all > 1").drop("n_all")
    rows = beside.join(sized(written(counts, "near-open")), ["hub", "of"])
    # The side of a block is told by hub and level, and blocks count from 0 in each.
    place = F.xxhash64("hub", "of").alias("hub")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def spot(n: str):
        return F.pmod(F.xxhash64("doc_id"), F.col(n))

    left = rows.where("outside AND level = of").select(place, spot("n_a").alias("a"), every("n_b").alias("b"), F.lit(0).alias("side"), "doc_id", "group")
    right = rows.select(place, every("n_a").alias("a"), spot("n_b").alias("b"), F.lit(1).alias("side"), "doc_id", "group")
    return left.unionByName(right)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the smallest id; columns as in ``docs``.  Ids may repeat, and nulls are the largest."""
    rows, row = numbered(docs, key, text)
    dropped = written(_groups(rows, row, text).where("NOT kept").select(F.col("doc_id").alias("_dropped")), "near-dropped")
    return without(rows, row, dropped).select(*[F.col(f"`{c}`") for c in docs.columns])
