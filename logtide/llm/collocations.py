"""Phrase collocations, counted by slots of minimal perfect hashes.

Phrases are rows of word ids: 64-bit hashes of language and word, which are checked to tell each
frequent word from all others (else another seed is taken).

1. Words are counted exactly.  Then texts are written as word ids, where rare words are gaps;
   all that follows reads these, three times however much there is.
2. Pairs of frequent words are counted by bucket, which is the front of a phrase's hash, and then
   triples both of whose pairs have full buckets.  A bucket holds at least as many as any of its
   phrases, and a phrase occurs at most as often as its parts, so nothing that is frequent is lost.
   Mappers sum up what they hold and deal it to shards, which are ranges of hashes; a shard sums
   its own buckets, and gives the bits of the full ones.
3. Phrases whose buckets are full, and whose parts' are, are the candidates.  They are dealt to
   shards likewise, as words and numbers of times.
4. In each shard a minimal perfect hash gives each of its candidates a slot, the slot keeps the
   candidate's words, and ``numpy.bincount`` sums up by slot.

There are so many shards that each gets a bounded number of rows; all are counted in one stage, so
that work follows the number of words.  What a cut's parts count is joined from the frequent
words and phrases.

Null texts are empty, null languages ``und``.  Repeated rows count each time.  Counts are exact up
to 10**15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.llm.common import shuffle_partitions, sized, small_batches, text_or_empty, tidied, written

#: Occurrences of a candidate, the percentage of its own that a longer one must have to replace it, and phrases returned for a language.
LEAST, REPLACED, TOP = 10, 50, 2000
#: Bits of the numbers of buckets, of places in the filter of frequent words (2 MB of bits), and of those in the filters of full buckets at most (16 MB each).
BUCKET_BITS, WORD_BITS, FULL_BITS = 36, 24, 27
#: Words of all texts for which there is a shard: it gets so many pairs and triples at most, less what mappers sum up.
SHARD_KEYS = 1 << 21
#: Numbers in a slice of an array that is summed.
SLICE = 1 << 16
#: Words that are looked at in one go, those of a written row, and those that a worker knows the ids of.
WINDOW, ROW_WORDS, MEMO_WORDS = 1 << 16, 1 << 14, 150_000
#: Distinct words, and places of candidates, that a task holds before it emits them; twice as many hashes.
MOST_WORDS, MOST_PLACES = 200_000, 1 << 20
#: Bytes of a text that are cut into words in one go.
CHUNK = 1 << 20
#: Frequent words up to which their table is broadcast.
BROADCAST_WORDS = 200_000
#: Times that seeds are tried.
SEEDS = 8

#: A to Z in lower case, tabs as spaces, and all ends of pieces as full stops.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_END = b"."
_U = np.uint64


def token_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, with a full stop at each end of a piece, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and _WORD_BYTES[text[end - 1]] not in b" .":
            end += 1
        # White space of split() that isn't a blank has become an end of a piece.
        yield text[at:end].translate(_WORD_BYTES).replace(b".", b" . ").split()
        at = end


class _Ids(dict):
    """Memo from a word to its id in a language; no id is 0, which stands for an end."""

    def __init__(self, lang: str, seed: int):
        super().__init__()
        self.prefix, self.seed = lang.encode() + b"\x00", seed
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(self.prefix + word, self.seed) or 1
        return found


# Columns: lang (string), text (binary).
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), each word once for every MOST_WORDS or so."""
    counts: dict[str, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = counts[lang]
            for tokens in token_pieces(text):
                held -= len(own)
                own.update(tokens)
                held += len(own)
                if held > MOST_WORDS:
                    yield from _counted(counts)
                    own, held = counts[lang], 0
    yield from _counted(counts)


def _counted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        own.pop(_END, None)
        words, n = list(own), list(own.values())
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array(n[at : at + 20_000], pa.int64())], names=["lang", "word", "n"])
    counts.clear()


def _with_ids(seed: int) -> Callable:
    """Rows of (lang, word, n) with the words' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {lang: _Ids(lang, seed) for lang in batch.column("lang").unique().to_pylist()}
            found = [own[lang].__missing__(word) for lang, word in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "word")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), pa.array(np.array(found, _U).view(np.int64)), batch.column("n")], names=["lang", "word", "id", "n"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of unsigned numbers over all bits, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase of hash ``h`` with one more word; 0 stands for no word."""
    return _mix(h * _U(0x9E3779B97F4A7C15) + word)


def hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _joined(_joined(a, b), c)


def _texts_ids(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    """Ids of words over rows of (lang, text), in rows that end in the two ids with which the next one begins; 0 where a piece has ended."""
    memos: dict[str, _Ids] = {}
    held, size = [], 0
    end = np.zeros(2, _U)
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sum(map(len, memos.values())) > MEMO_WORDS:
                memos.clear()
            if (memo := memos.get(lang)) is None:
                memo = memos[lang] = _Ids(lang, seed)
            for tokens in token_pieces(text):
                held.append(np.fromiter(map(memo.__getitem__, tokens), _U, len(tokens)))
                size += len(tokens)
                if size >= WINDOW:
                    # The last two words wait for what comes behind them.
                    ids = np.concatenate(held)
                    yield ids
                    held, size = [ids[-2:]], 2
            held.append(end)
            size += 2
    if held:
        yield np.concatenate([*held, end])


def _written_ids(words: Broadcast, seed: int) -> Callable:
    """Ids of frequent words, as packed bytes; rare words are gaps, and gaps are one 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, packer = np.frombuffer(words.value, np.uint8), zstandard.ZstdCompressor(level=1)
        for ids in _texts_ids(batches, seed):
            known = np.where(_bits(frequent, _place(ids, WORD_BITS)), ids, _U(0))
            own, tail = known[:-2], known[-2:]
            own = own[(own != 0) | (np.concatenate([[1], own[:-1]]) != 0)]
            known = np.concatenate([own, tail])
            rows = [packer.compress(known[at : at + ROW_WORDS + 2].tobytes()) for at in range(0, len(own), ROW_WORDS)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words and the two behind each, over written rows of ids; 0 stands for a gap."""
    held, size, unpacker = [], 0, zstandard.ZstdDecompressor()

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([x[:-2] for x in held]), np.concatenate([x[1:-1] for x in held]), np.concatenate([x[2:] for x in held])

    for batch in batches:
        for row in batch.column(0):
            held.append(np.frombuffer(unpacker.decompress(row.as_buffer()), _U))
            size += len(held[-1])
            if size >= WINDOW:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> _U(64 - bits)


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(slice, salt, counts) of an array, packed; slices of zeros only are left out."""
    packer = zstandard.ZstdCompressor(level=1)
    salt = int(np.random.default_rng().integers(64))
    for k in range(0, -(-len(counts) // SLICE)):
        part = counts[k * SLICE : (k + 1) * SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([packer.compress(part.tobytes())], pa.binary())], names=["slice", "salt", "counts"])


_SLICES = "slice int, salt int, counts binary"


def _summed(kind: str, most: int | None) -> Callable:
    """Sums of slices that come one after the other; ``most``: sums stop there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, total, salt = zstandard.ZstdCompressor(level=1), None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([salt], pa.int32()), pa.array([packer.compress(total.tobytes())], pa.binary())], names=["slice", "salt", "counts"])

        for batch in batches:
            for k, s, packed in zip(batch.column("slice").to_pylist(), batch.column("salt").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed.as_py()), kind)
                if k != now:
                    if total is not None:
                        yield out()
                    now, salt, total = k, s, part.copy()
                elif most is None:
                    total += part
                else:
                    total = np.minimum(total.astype(np.uint16) + part, most).astype(kind)
        if total is not None:
            yield out()

    return run


def tree_sum(arrays: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """(slice, salt, counts): slices of all tasks' arrays summed, first by slice and salt, then by slice."""
    for by in (["slice", "salt"], ["slice"]):
        arrays = arrays.repartition(*by).sortWithinPartitions("slice").mapInArrow(tidied(_summed(kind, most)), _SLICES)
    return arrays


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _dealt(h: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Each shard that any of the rising hashes belong to, and where they are; shards are ranges of hashes, a power of two of them."""
    bits = shards.bit_length() - 1
    ends = [0, *np.searchsorted(h >> _U(64 - bits), np.arange(shards, dtype=_U), "right").tolist()] if bits else [0, len(h)]
    return [(k, slice(ends[k], ends[k + 1])) for k in range(shards) if ends[k] < ends[k + 1]]


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on, packed; those of small numbers pack well."""
    return _packer().compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplaned(packed: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(_unpacked(packed, "u1").reshape(wide, -1).T).reshape(-1).view(kind)


def _bucketed(pairs: Broadcast | None, shards: int) -> Callable:
    """(shard, buckets, n): counts by bucket, each once for every 2 * MOST_PLACES or so; of pairs, or of triples both of whose pairs have full buckets."""

    def emitted(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.concatenate(held)
        held.clear()
        buckets.sort()
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        n = np.diff(starts, append=len(buckets)).astype("<u4")
        buckets = buckets[starts]
        rows = [(k, _planes(np.diff(buckets[own], prepend=_U(0))), _planes(n[own])) for k, own in _dealt(buckets << _U(64 - BUCKET_BITS), shards)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "buckets", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for a, b, c in _windows(batches):
            if pairs is None:
                at = np.flatnonzero((a != 0) & (b != 0))
                h = hashed(a[at], b[at], np.zeros(len(at), _U))
            else:
                at = _triples(a, b, c, np.frombuffer(pairs.value, np.uint8))
                h = hashed(a[at], b[at], c[at])
            held.append(_place(h, BUCKET_BITS))
            size += len(h)
            if size > 2 * MOST_PLACES:
                yield emitted(held)
                size = 0
        if size:
            yield emitted(held)

    return run


def _full_buckets(least: int, shards: int, bits: int) -> Callable:
    """(shard, bits): where the filter of 2**bits places has the shard's full buckets."""
    first = shards.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        for batch in batches:
            for k, buckets, n in zip(batch.column("shard").to_pylist(), batch.column("buckets"), batch.column("n"), strict=True):
                # What is behind the shard's number, and then the count, which has fewer than 28 bits.
                own = np.cumsum(_unplaned(buckets.as_py(), "<u8")) & _U((1 << BUCKET_BITS - first) - 1)
                held[k].append(own << _U(28) | _unplaned(n.as_py(), "<u4"))
        for k in list(held):
            both = np.concatenate(held.pop(k))
            both.sort()
            buckets, n = both >> _U(28), (both & _U((1 << 28) - 1)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            full = buckets[starts][np.add.reduceat(n, starts) >= least]
            marks = np.zeros(1 << bits - first, np.uint8)
            marks[full >> _U(BUCKET_BITS - bits)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

    return run


def _full_of(dealt: DataFrame, least: int, shards: int, bits: int) -> bytes:
    """The filter of full buckets; a bounded number of bytes for the driver, which come from a written table."""
    # The shard is the partition, so that a task has one of them.
    made = dealt.repartitionById(shards, "shard").mapInArrow(tidied(_full_buckets(least, shards, bits)), "shard int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = len(out) // shards
    for row in written(made, "phrase-full").collect():
        out[row.shard * size : (row.shard + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _is_full(full: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _bits(full, _place(h, len(full).bit_length() + 2))


def _full_pairs(a: np.ndarray, b: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = (a != 0) & (b != 0)
    at = np.flatnonzero(out)
    out[at] = _is_full(full, hashed(a[at], b[at], np.zeros(len(at), _U)))
    return out


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Where triples begin both of whose pairs have full buckets."""
    at = np.flatnonzero(_full_pairs(a, b, full))
    return at[_full_pairs(b[at], c[at], full)]


def _candidates(pairs: Broadcast, triples: Broadcast, shards: int) -> Callable:
    """(shard, pairs, triples, n): candidates of two and three words as packed bytes, and their numbers, each once for every MOST_PLACES or so."""

    def emitted(keys: np.ndarray, n: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        rows = []
        for k, at in _dealt(h, shards):
            own, times = keys[:, at], n[at]
            wide = own[2] != 0
            rows.append((k, _packer().compress(own[:2, ~wide].tobytes()), _packer().compress(own[:, wide].tobytes()), _planes(np.concatenate([times[~wide], times[wide]]))))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "pairs", "triples", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, distinct = [], 0, 0
        for a, b, c in _windows(batches):
            for at, width in _candidate_places(a, b, c, pairs, triples):
                held.append((np.stack([a[at], b[at], c[at] if width == 3 else np.zeros(len(at), _U)]), np.ones(len(at), "<u8")))
                size += len(at)
            if size > 2 * distinct + MOST_PLACES // 4:
                # What is distinct so far stays, until there is too much of it.
                keys, n, h = _together(held)
                size = distinct = len(n)
                if size > MOST_PLACES:
                    yield emitted(keys, n, h)
                    size = distinct = 0
                else:
                    held.append((keys, n))
                del keys, n, h
        if size:
            yield emitted(*_together(held))

    return run


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the arrays with their numbers summed up, and their hashes, which rise; the arrays are let go.  Where others share the front of a hash, some may stay twice."""
    keys, n = np.concatenate([k for k, _ in held], axis=1), np.concatenate([n for _, n in held])
    held.clear()
    h = hashed(*keys)
    # Hashes with their places behind are sorted faster than places by hashes are.
    low = _U((1 << len(h).bit_length()) - 1)
    order = h & ~low | np.arange(len(h), dtype=_U)
    order.sort()
    order = (order & low).astype(np.int64)
    starts = _starts(keys, order)
    first = order[starts]
    return keys[:, first], np.add.reduceat(n[order], starts) if len(starts) else n, h[first] & ~low


def _starts(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in the order where a column differs from the one before."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for word in keys:
        word = word[order]
        new[1:] |= word[1:] != word[:-1]
    return np.flatnonzero(new)


def _by_slot(least: int, shards: int) -> Callable:
    """(a, b, c, f): a shard's phrases that occur often enough, counted by slots of their perfect hash."""
    first = shards.bit_length() - 1

    def counted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Most of what came through the filters by chance has no full bucket in a finer division.
        bits = max(1, len(n).bit_length())
        place = (hashed(*keys) << _U(first) >> _U(64 - bits)).astype(np.int64)
        kept = np.bincount(place, n, 1 << bits)[place] >= least
        del place
        keys, n = keys[:, kept], n[kept]
        table = PerfectHash.build(_unique([keys]))
        f = np.bincount(table.slots(*keys), n, table.keys.shape[1]).astype(np.int64)
        often = np.flatnonzero(f >= least)
        for at in range(0, len(often), 50_000):
            own = often[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[own].view(np.int64)) for k in table.keys), pa.array(f[own])], names=["a", "b", "c", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            for k, two, three, n in zip(batch.column("shard").to_pylist(), *(batch.column(x) for x in ("pairs", "triples", "n")), strict=True):
                short, long = _unpacked(two.as_py(), "<u8").reshape(2, -1), _unpacked(three.as_py(), "<u8").reshape(3, -1)
                short = np.concatenate([short, np.zeros((1, short.shape[1]), _U)])
                held[k].append((np.concatenate([short, long], axis=1), _unplaned(n.as_py(), "<u8").astype(np.uint32)))
        for k in list(held):
            own = held.pop(k)
            keys, n = np.concatenate([x for x, _ in own], axis=1), np.concatenate([x for _, x in own])
            del own
            yield from counted(keys, n)

    return run


def _candidate_places(a, b, c, pairs: Broadcast, triples: Broadcast) -> list[tuple[np.ndarray, int]]:
    """Where candidates of two and of three words begin."""
    full = np.frombuffer(pairs.value, np.uint8)
    two = np.flatnonzero(_full_pairs(a, b, full))
    three = two[_full_pairs(b[two], c[two], full)]
    three = three[_is_full(np.frombuffer(triples.value, np.uint8), hashed(a[three], b[three], c[three]))]
    return [(two, 2), (three, 3)]


def _unique(held: list[np.ndarray]) -> np.ndarray:
    """Distinct columns of the arrays, which are let go.  Equal ones come together by their hashes; where others share a hash, some may stay twice."""
    keys = np.concatenate(held, axis=1)
    held.clear()
    order = np.argsort(hashed(*keys))
    return keys[:, order[_starts(keys, order)]]


@dataclass
class PerfectHash:
    """A minimal perfect hash of phrases, with the phrases by slot.

    On each level, the keys that are still without a slot go to places of a bit array; a bit is
    set where just one key went, and the others go on to the next level.  A key's slot is the
    number of bits before its own.
    """

    sizes: list[int]
    words: np.ndarray
    ranks: np.ndarray
    keys: np.ndarray

    #: Bits of a level for each of its keys, and levels at most.
    ROOM = 2
    LEVELS = 64

    @staticmethod
    def _spread(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return _mix(h + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct phrases, a column each."""
        left, h, sizes, levels = np.arange(keys.shape[1]), hashed(*keys), [], []
        while len(left):
            if len(sizes) == cls.LEVELS:
                raise ValueError("two phrases have the same hash")
            size = max(64, -(-cls.ROOM * len(left) // 64) * 64)
            at = cls._spread(h[left], len(sizes), size)
            n = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(np.packbits(n == 1, bitorder="little").view(_U))
            sizes.append(size)
            left = left[n[at.astype(np.int64)] > 1]
        words = np.concatenate(levels) if levels else np.zeros(0, _U)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32)
        made = cls(sizes, words, ranks, keys)
        by_slot = np.empty_like(keys)
        by_slot[:, made._slots(h)] = keys
        made.keys = by_slot
        return made

    def _slots(self, h: np.ndarray) -> np.ndarray:
        out, left, offset = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = self._spread(h[left], level, size) + _U(offset)
            word, bit = at >> _U(6), at & _U(63)
            held = self.words[word]
            hit = (held >> bit) & _U(1) == 1
            below = np.bitwise_count(held[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[left[hit]] = self.ranks[word[hit]].astype(np.int64) + below
            left, offset = left[~hit], offset + size
            if not len(left):
                break
        return out

    def slots(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """The phrases' slots; -1 for those that aren't keys."""
        out = self._slots(hashed(a, b, c) if h is None else h)
        x, y, z = self.keys
        at = np.maximum(out, 0)
        if len(x):
            out[(x[at] != a) | (y[at] != b) | (z[at] != c)] = -1
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes, len(self.words), self.keys.shape[1]], np.int64)
        return b"".join([head.tobytes(), self.words.tobytes(), self.keys.tobytes()])

    @classmethod
    def unpacked(cls, content: bytes) -> PerfectHash:
        n = int(np.frombuffer(content, np.int64, 1)[0])
        head = np.frombuffer(content, np.int64, n + 3)
        at, bits, count = 8 * (n + 3), int(head[n + 1]), int(head[n + 2])
        words = np.frombuffer(content, _U, bits, at)
        keys = np.frombuffer(content, _U, 3 * count, at + 8 * bits).reshape(3, count)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32)
        return cls(head[1 : n + 1].tolist(), words, ranks, keys)


def _set_bits(places: DataFrame, bits: int) -> bytes:
    """A bit array of fixed size with the bits of column ``h``'s highest bits set; made in tasks, a slice of it at a time."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(size, np.uint8)
        for batch in batches:
            marks[_place(batch.column(0).to_numpy().view(_U), bits)] = 1
        yield from _slices(marks)

    return _full(tree_sum(places.mapInArrow(tidied(run), _SLICES), "u1", 1), bits, 1)


def _full(slices: DataFrame, bits: int, least: int) -> bytes:
    """Bits of the places whose count is ``least`` or more; a fixed number of bytes for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(_unpacked(x.as_py(), "u1") >= least, bitorder="little").tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(packed, pa.binary())], names=["slice", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in slices.mapInArrow(tidied(run), "slice int, bits binary").toLocalIterator():
        part = np.frombuffer(row.bits, np.uint8)
        out[row.slice * SLICE // 8 : row.slice * SLICE // 8 + len(part)] = part
    return out.tobytes()


def word_counts(sent: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, id, n) of all words, a written table, and the seed by which no frequent word shares its id."""
    for seed in range(SEEDS):
        counted = sent.mapInArrow(tidied(_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = written(counted.mapInArrow(tidied(_with_ids(seed)), "lang string, word binary, id long, n long"), "phrase-words")
        if words.groupBy("id").agg(F.count("*").alias("of"), F.max("n").alias("most")).where((F.col("of") > 1) & (F.col("most") >= least)).isEmpty():
            return words, seed
    raise ValueError("words share ids under all seeds")


def phrase_counts(spark: SparkSession, sent: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """(a, b, c, f): phrases of two (c = 0) and three word ids that occur at least ``least`` times; a written table."""
    context = spark.sparkContext
    frequent = words.where(F.col("n") >= least)
    known = context.broadcast(_set_bits(frequent.select("id"), WORD_BITS))
    ids = written(sent.mapInArrow(tidied(_written_ids(known, seed)), "ids binary"), "phrase-ids")
    known.destroy()
    most = frequent.agg(F.sum("n")).first()[0] or 0
    shards = 1 << (max(shuffle_partitions(spark), -(-most // SHARD_KEYS)) - 1).bit_length()
    # A place for every second word, and whole bytes for each shard.
    bits = max(min(FULL_BITS, most.bit_length() - 1), shards.bit_length() + 2)

    def full(pairs: Broadcast | None) -> Broadcast:
        return context.broadcast(_full_of(ids.mapInArrow(tidied(_bucketed(pairs, shards)), "shard int, buckets binary, n binary"), least, shards, bits))

    pairs = full(None)
    triples = full(pairs)
    dealt = ids.mapInArrow(tidied(_candidates(pairs, triples, shards)), "shard int, pairs binary, triples binary, n binary")
    found = written(dealt.repartitionById(shards, "shard").mapInArrow(tidied(_by_slot(least, shards)), "a long, b long, c long, f long"), "phrase-often")
    pairs.destroy()
    triples.destroy()
    return found


def _score(left: str, right: str):
    """floor(1000000 * f * f / (left * right)), exact beyond 64 bits; null where a part is missing."""
    parts = f"CAST({left} AS DECIMAL(15, 0)) * CAST({right} AS DECIMAL(15, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(15, 0)) * CAST(f AS DECIMAL(15, 0))) DIV nullif({parts}, 0)")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, replaced: int = REPLACED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).cast("binary").alias("text"))
    words, seed = word_counts(sent, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = phrase_counts(spark, sent, words, seed, least)
    frequent = words.where(F.col("n") >= least)
    two, three = found.where("c = 0").drop("c"), found.where("c <> 0")

    def times(df: DataFrame, column: str, out: str, *more: str) -> DataFrame:
        """``df`` with its words' counts; all words of a frequent phrase are frequent."""
        return df.join(sized(frequent.select(F.col("id").alias(column), F.col("n").alias(out), *more), BROADCAST_WORDS), column)

    # A pair goes if a longer phrase that holds it occurs half as often, or more.
    longer = three.select("f", F.explode(F.array_distinct(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))).alias("k"))
    longer = longer.groupBy("k.a", "k.b").agg(F.max("f").alias("_longer"))
    kept = two.join(longer, ["a", "b"], "left").where(f"_longer IS NULL OR 100 * _longer < {replaced} * f")
    short = times(times(kept, "a", "l", "lang"), "b", "r").select("lang", "a", "b", F.lit(0).cast("long").alias("c"), "f", "l", "r", _score("l", "r").alias("score"))

    # All parts of a frequent phrase are frequent phrases or words.
    parts = three.join(two.select("a", "b", F.col("f").alias("l2")), ["a", "b"]).join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("r1")), ["b", "c"])
    parts = times(times(parts, "a", "l1", "lang"), "c", "r2")
    # The least of both by score, then by the cut's place.
    cut = F.least(*[F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    long = parts.select("lang", "a", "b", "c", "f", cut.alias("cut")).select("lang", "a", "b", "c", "f", "cut.l", "cut.r", "cut.score")

    # The first of each language and all that equal the last of them, which words tell apart.
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc())
    best = written(short.unionByName(long).withColumn("_place", F.rank().over(place)).where(F.col("_place") <= top), "phrase-best")
    met = best.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    names = written(frequent.join(sized(written(met, "phrase-words-met"), BROADCAST_WORDS), "id").select("id", F.col("word").cast("string").alias("word")), "phrase-names")

    def named(df: DataFrame, column: str, how: str = "inner") -> DataFrame:
        return df.join(sized(names.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word")), BROADCAST_WORDS), column, how)

    full = named(named(named(best, "a"), "b"), "c", "left")
    rows = full.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # Spark keeps each task's first rows of a language before it shuffles them.
    ranks = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranks.join(F.broadcast(totals) if totals.count() <= BROADCAST_WORDS else totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
