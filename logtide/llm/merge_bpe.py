"""BPE by a priority queue of merges over a linked list of symbols; decoding by concatenation.

Each piece of a text begins as a doubly linked list of the symbols of its bytes.  A heap holds
the merges that are possible, by rank and place; the lowest is made, and its neighbours' new
pairs join the heap.  Entries whose symbols have changed since are stale: they are skipped
when they come up.  n symbols take O(n log n) steps, however long the piece is.

Tokens that the vocabulary adds by name (such as an end of text) are cut out of the text
first, wherever they stand.  Null and empty texts encode to no tokens.  Other columns are
kept; the columns that an operator adds replace columns of the same name.
"""

from __future__ import annotations

import json
import zlib
from array import array
from heapq import heapify, heappop, heappush

import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.bpe import MEMO_ENTRIES, arrow_map

#: How a byte-level pre-tokenizer cuts texts; a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LITTLE = array("H", [1]).tobytes()[0] == 1


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer's JSON file; files that ask for anything else are refused."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, cut, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        plain = cut.get("type") == decoder.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        if model.get("type", "BPE") != "BPE" or odd or not plain or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("only plain byte-level BPE without normalizer, post-processor, prefix space or unknown token is supported")
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        #: Symbol of each byte.
        self.first = [vocab[s] for s in symbols]
        #: Rank of the pair a, b at ``a << 32 | b``, and the symbol that each rank makes.
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        #: Strings of the vocabulary, each character a byte (Latin-1).
        added = spec.get("added_tokens") or []
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in added)], default=-1))
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token).decode("latin-1")
        self.added: dict[str, int] = {}
        for t in added:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError("added tokens that look at their surroundings aren't supported")
            self.added[t["content"]] = t["id"]
            # A decoder takes characters of an added token for bytes too, where all of them stand for one.
            known = all(c in byte_of for c in t["content"])
            self.strings[t["id"]] = (bytes(byte_of[c] for c in t["content"]) if known else t["content"].encode()).decode("latin-1")


class MergeEncoder(dict):
    """Memo from piece (str) to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.split = regex.compile(PIECES).findall
        longest_first = sorted(vocabulary.added, key=lambda t: (-len(t), t))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.packed = {t: _packed([i]) for t, i in vocabulary.added.items()}

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if self.cut is None or not any(t in text for t in self.packed):
            return b"".join(map(self.__getitem__, self.split(text)))
        # Texts and added tokens take turns.
        parts = self.cut(text)
        return b"".join(self.packed[p] if i % 2 else b"".join(map(self.__getitem__, self.split(p))) for i, p in enumerate(parts))

    def __missing__(self, piece: str) -> bytes:
        packed = _packed(self.merge(piece.encode()))
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        rank_of, made = self.vocabulary.pairs.get, self.vocabulary.made
        symbols = list(map(self.vocabulary.first.__getitem__, piece))
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry is rank * n + place, which orders by rank, then from left to right.
        heap = [rank * n + at for at in range(n - 1) if (rank := rank_of(symbols[at] << 32 | symbols[at + 1])) is not None]
        heapify(heap)
        while heap:
            rank, at = divmod(heappop(heap), n)
            gone = after[at]
            # Stale: the pair that stands here now isn't the one that the entry is of.  What was merged away is -1, which is in no pair.
            if gone == n or rank_of(symbols[at] << 32 | symbols[gone]) != rank:
                continue
            symbol = symbols[at] = made[rank]
            symbols[gone] = -1
            behind = after[at] = after[gone]
            if behind < n:
                before[behind] = at
                if (rank := rank_of(symbol << 32 | symbols[behind])) is not None:
                    heappush(heap, rank * n + at)
            if (ahead := before[at]) >= 0 and (rank := rank_of(symbols[ahead] << 32 | symbol)) is not None:
                heappush(heap, rank * n + ahead)
        return [s for s in symbols if s >= 0]

    def decode(self, packed: bytes) -> str:
        """The text of the ids' strings; bytes that are no UTF-8 become replacement characters."""
        ids = array("I")
        ids.frombytes(packed)
        if not _LITTLE:
            ids.byteswap()
        return "".join(map(self.vocabulary.strings.__getitem__, ids)).encode("latin-1").decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    return packed.tobytes() if packed.itemsize == 4 and _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)


_encoders: dict[int, MergeEncoder] = {}


def _encoder(shared: Broadcast, key: int) -> MergeEncoder:
    """One encoder a worker process, kept from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = MergeEncoder(Vocabulary(shared.value))
    return _encoders[key]


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The content of a tokenizer's JSON file (fixed size, a few MB) for the workers; it is checked here."""
    with open(path, "rb") as file:
        content = file.read()
    Vocabulary(content)
    return spark.sparkContext.broadcast(content)


def encode(df: DataFrame, vocabulary: Broadcast, text: str = "text", out: str = "token_ids", kept: list[str] | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole text, as little-endian unsigned 32-bit integers (binary)."""
    key = zlib.crc32(vocabulary.value)

    def convert():
        encoder = _encoder(vocabulary, key)
        return lambda text: (encoder.encode(text) if text else b"",)

    return arrow_map(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, [out], convert, kept)


def decode(df: DataFrame, vocabulary: Broadcast, ids: str = "token_ids", out: str = "decoded", kept: list[str] | None = None) -> DataFrame:
    """Add ``out``: the text (string) of the packed ids; null ids decode to an empty text."""
    key = zlib.crc32(vocabulary.value)

    def convert():
        encoder = _encoder(vocabulary, key)
        return lambda packed: (encoder.decode(packed).encode() if packed else b"",)

    return _as_text(arrow_map(df, ids, [out], convert, kept), out)


def round_trip(df: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "token_ids", out: str = "decoded", kept: list[str] | None = None) -> DataFrame:
    """Add ``ids`` and ``out``, what encode and then decode give, in one pass through one worker a task."""
    key = zlib.crc32(vocabulary.value)

    def convert():
        encoder = _encoder(vocabulary, key)

        def fn(text):
            packed = encoder.encode(text) if text else b""
            return packed, encoder.decode(packed).encode()

        return fn

    return _as_text(arrow_map(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, [ids, out], convert, kept), out)


def _as_text(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])
