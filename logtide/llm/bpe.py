"""Byte-level BPE: exact encoding by longest matches and backtracking, and decoding.

Two facts carry the encoder.  A row of tokens is the BPE encoding of its bytes exactly when
each adjacent pair is the encoding of the pair's own bytes, and every prefix has just one
encoding.  So it is enough to walk from left to right, take the longest token that fits
behind the last one, and step back where none does; a position that was left by stepping
back never has to be tried again, which keeps the walk linear.

Null and empty texts encode to no tokens.  Other columns are kept; the columns that an
operator adds replace columns of the same name.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import ahocorasick
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.common import SLICE_ROWS, free_name, small_batches, tidied

#: Entries after which a worker's memo of pieces or of token pairs is emptied.
MEMO_ENTRIES = 300_000


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Encoder(dict):
    """Memo from piece (str) to its ids, packed as little-endian unsigned 32-bit integers.

    The ranks must be in merge order: a token of several bytes ranks above the two it is made of.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.split = regex.compile(pattern).findall
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token = [""] * (max(ranks.values(), default=-1) + 1)
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.token[rank] = token
            self.trie.add_word(token, rank)
        self.trie.make_automaton()
        self.size = [len(t) for t in self.token]
        self.fits: dict[int, bool] = {}
        #: Each token's longest proper prefix that is a token, or -1, and its edges; found when asked for.
        self.shorter: dict[int, int] = {}
        self.edges: dict[int, tuple[list, list]] = {}

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if len(self.fits) > MEMO_ENTRIES:
            self.fits.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.piece(piece.encode().decode("latin-1")))
        packed = ids.tobytes() if ids.itemsize == 4 and _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def piece(self, piece: str) -> list[int]:
        """Token ids of one piece, given as Latin-1."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, size, fits = len(piece), self.size, self.fits
        longest = array("i", b"\xff" * (4 * n)) if n > 256 else [-1] * n
        for end, rank in self.trie.iter(piece):
            # Ends ascend, so what is written last for a start is its longest match.
            longest[end + 1 - size[rank]] = rank
        stuck: set[int] = set()
        out: list[int] = []
        at, rank, before = 0, longest[0], -1
        while at < n:
            while rank >= 0:
                end = at + size[rank]
                if end not in stuck:
                    if before < 0:
                        break
                    if (known := fits.get(before << 32 | rank)) is None:
                        known = fits[before << 32 | rank] = self.fit(before, rank)
                    if known:
                        break
                rank = self.prefix(rank)
            if rank >= 0:
                out.append(rank)
                at, before = end, rank
                if at < n:
                    rank = longest[at]
            elif out:
                stuck.add(at)
                last = out.pop()
                at -= size[last]
                rank, before = self.prefix(last), out[-1] if out else -1
            else:
                raise ValueError("the ranks lack a byte of the text")
        return out

    def prefix(self, rank: int) -> int:
        if (found := self.shorter.get(rank)) is None:
            token = self.token[rank]
            found = next((r for end in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:end])) is not None), -1)
            self.shorter[rank] = found
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when their joined bytes are encoded.

        They don't if a merge across the border has its turn while the two parts beside the
        border stand: before the left one goes into a larger part (or at the same rank: the
        leftmost pair has its turn first), and not after the right one does.
        """
        ranks = self.ranks
        for x, x_until in self.spines(left)[1]:
            for y, y_until in self.spines(right)[0]:
                if (rank := ranks.get(x + y)) is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def spines(self, rank: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """The parts that stand at the token's left and right border while it is merged, each with the rank that ends it."""
        if (found := self.edges.get(rank)) is None:
            token, never = self.token[rank], 1 << 40
            if len(token) == 1:
                found = [(token, never)], [(token, never)]
            else:
                a, b = self.halves(token)
                if not self.ranks[a] < rank > self.ranks[b]:
                    raise ValueError("the ranks are not in merge order")
                found = tuple([(token, never), *((t, min(until, rank)) for t, until in self.spines(self.ranks[half])[side])] for side, half in ((0, a), (1, b)))
            self.edges[rank] = found
        return found

    def halves(self, token: str) -> list[str]:
        """The two parts that are left before a token's last merge."""
        parts = list(token)
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                raise ValueError("a token can't be made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


_LITTLE = array("H", [1]).tobytes()[0] == 1
_encoders: dict[int, Encoder] = {}
_tables: dict[int, list[bytes]] = {}


def _encoder(shared: Broadcast, key: int, pattern: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(parse_ranks(shared.value), pattern)
    return _encoders[key]


def _table(shared: Broadcast, key: int) -> list[bytes]:
    if key not in _tables:
        ranks = parse_ranks(shared.value)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _tables.clear()
        _tables[key] = table
    return _tables[key]


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The content of a rank file (a vocabulary: fixed size, under a few MB) for the workers."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def arrow_map(df: DataFrame, column: str, outs: list[str], convert, kept: list[str] | None = None) -> DataFrame:
    """Replace or add the binary columns ``outs``, computed from ``column`` a slice of rows at a time.

    ``convert`` makes a function of a value that gives one value for each of ``outs``.
    ``kept``: the other columns to keep; all if None.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    keep = [c for c in (df.columns if kept is None else kept) if c.lower() not in {o.lower() for o in outs}]
    # The source goes along under a private name, so that columns of any name may be kept.
    sent = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(free_name(df, "_source")))
    schema = T.StructType([*sent.schema.fields[:-1], *[T.StructField(o, T.BinaryType()) for o in outs]])

    def run(batches):
        fn = convert()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                values = [fn(v) for v in part.column(part.num_columns - 1).to_pylist()]
                made = [pa.array([v[i] for v in values], pa.binary()) for i in range(len(outs))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, *outs])

    return sent.mapInArrow(tidied(run), schema)


def _encoding(ranks: Broadcast, pattern: str):
    key = zlib.crc32(ranks.value)

    def convert():
        encoder = _encoder(ranks, key, pattern)
        return lambda text: encoder.encode(text) if text else b""

    return convert


def _decoding(ranks: Broadcast):
    key = zlib.crc32(ranks.value)

    def convert():
        import numpy as np

        table = _table(ranks, key)
        return lambda packed: b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist())) if packed else b""

    return convert


def encode(df: DataFrame, ranks: Broadcast, pattern: str, text: str = "text", out: str = "token_ids", kept: list[str] | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole text, as little-endian unsigned 32-bit integers (binary)."""
    encoding = _encoding(ranks, pattern)

    def convert():
        fn = encoding()
        return lambda text: (fn(text),)

    return arrow_map(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, [out], convert, kept)


def decode(df: DataFrame, ranks: Broadcast, ids: str = "token_ids", out: str = "decoded", kept: list[str] | None = None) -> DataFrame:
    """Add ``out``: the bytes (binary) of the packed ids; null ids decode to no bytes."""
    decoding = _decoding(ranks)

    def convert():
        fn = decoding()
        return lambda packed: (fn(packed),)

    return arrow_map(df, ids, [out], convert, kept)


def round_trip(df: DataFrame, ranks: Broadcast, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded", kept: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``out``, what encode and then decode give, in one pass through one worker a task."""
    encoding, decoding = _encoding(ranks, pattern), _decoding(ranks)

    def convert():
        to_ids, to_bytes = encoding(), decoding()

        def fn(text):
            packed = to_ids(text)
            return packed, to_bytes(packed)

        return fn

    return arrow_map(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, [ids, out], convert, kept)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes, from the columns of encode and decode."""
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
