"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Each byte and the four before it give six triplets; each is hashed to one of 128 buckets.
The digest holds, as hexadecimal text, a checksum of the bytes, the length on a logarithmic
scale, and for each bucket the quartile its count lies in.  Two digests differ by the
distance of their quartiles (far quartiles count more) plus that of lengths, and by no more
than MOST; their likeness is one minus the share of MOST.  Null texts count as empty; texts of
fewer than five bytes are padded with zero bytes.  Equal texts have equal digests.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logtide.llm.common import SLICE_ROWS, free_name, shuffle_partitions, small_batches, text_or_empty, tidied, written

BUCKETS = 128
#: Of a five-byte window (0: newest byte), the pairs that join the newest byte in a triplet.
PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Bytes that are counted at a time, so that memory doesn't grow with the text.
CHUNK = 1 << 16
#: Steps of the length scale.
LENGTH_BASE = 1.1
#: The largest difference there is: checksum, lengths at both ends of the scale, all buckets in opposite quartiles.  No two texts lie beyond it, so that unlike texts have an order too.
MOST = 1 + 2 * 255 + 6 * BUCKETS
_ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 3141592653], dtype=np.uint32)


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of ``data``."""
    if len(data) < 5:
        data = data.ljust(5, b"\0") if data else b""
    counts = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8)
    for at in range(0, len(b) - 4, CHUNK):
        w = b[at : at + CHUNK + 4].astype(np.uint32)
        new = w[4:]
        for (i, j), odd in zip(PAIRS, _ODD, strict=True):
            # A triplet is a 24-bit number; the top bits of its odd multiple are the bucket.
            hit = ((new | w[4 - i : len(w) - i] << 8 | w[4 - j : len(w) - j] << 16) * odd) >> 25
            counts += np.bincount(hit, minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(math.log(len(data) + 1) / math.log(LENGTH_BASE)))
    return bytes([zlib.crc32(data) & 0xFF, length]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Difference of two digests, which the digests' form bounds: 0 to MOST."""
    if a == b:
        return 0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int32), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int32)
    total = int(x[0] != y[0])
    apart = abs(int(x[1]) - int(y[1]))
    total += apart if apart <= 2 else 2 * apart
    for shift in (0, 2, 4, 6):
        d = np.abs((x[2:] >> shift & 3) - (y[2:] >> shift & 3))
        # Opposite quartiles weigh twice their distance.
        total += int(d.sum() + 3 * (d == 3).sum())
    return total


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out``, the digest of the whole text.  A column of that name is replaced."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    sent = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).cast("binary").alias(free_name(docs, "_bytes")))
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                values = pa.array([fingerprint(v) for v in part.columns[-1].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*keep, out])

    return sent.mapInArrow(tidied(run), schema)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(key: int, own: str, after: str, own_print: str, after_print: str) -> tuple:
    import hashlib

    half = len(own) // 2
    edited = (own[: len(own) - half] + after[:half]).encode()
    edited_print = fingerprint(edited)
    return key, len(own), hashlib.sha256(edited).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, after_print)


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How near each text is to an edited copy of itself and to the next text in the order of ``key``.

    The edited text's last floor(n_chars/2) code points are the first as many (or all) of the
    next document's; the last document's next is the first.  Texts are dealt once, by ranges
    of the key; only the first and last text of a range go further, to meet their neighbours.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    n = shuffle_partitions(spark)
    # The checksum orders rows of equal keys.
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary"))).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for doc, own, part in zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns], strict=True):
                    row = doc, own, fingerprint(own.encode()), part
                    if held is None:
                        out.append((None,) * 7 + (part, "first", doc, own))
                    else:
                        out.append(_row(held[0], held[1], own, held[2], row[2]) + (part, None, None, None))
                    held = row
                if out:
                    yield _batch(out)
        if held is not None:
            yield _batch([(None,) * 7 + (held[3], "last", held[0], held[1])])

    wide = f"{_RESULT}, part int, edge string, edge_id long, edge_text string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(wide))

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    done = written(dealt.mapInArrow(tidied(run), wide), "digest-ranges")
    # Two rows per range: as many as there are shuffle partitions, twice.
    edges = done.where("edge IS NOT NULL").select("part", "edge", F.col("edge_id"), F.col("edge_text"))
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("_part"), F.col("edge_text").alias("after"))
    order = firsts.select("_part").withColumn("_next", F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.min("_part").over(Window.partitionBy(F.lit(0)))))
    lasts = edges.where("edge = 'last'").join(F.broadcast(order), F.col("part") == F.col("_part")).drop("_part")
    met = lasts.join(firsts.hint("merge"), F.col("_next") == F.col("_part")).select("edge_id", "edge_text", "after")

    def finish(batches):
        for batch in batches:
            out = [_row(i, a, b, fingerprint(a.encode()), fingerprint(b.encode())) for i, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[:7], strict=True)], schema=pa.schema(list(arrow)[:7]))

    names = [f.strip().split(" ")[0] for f in _RESULT.split(",")]
    return done.where("edge IS NULL").select(names).unionByName(met.mapInArrow(tidied(finish), _RESULT))
