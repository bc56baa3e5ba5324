"""Language ID by compression: the language whose text, as a zstandard raw-content dictionary, encodes a text smallest.

Texts are lower-cased and all but letters (and their marks) become single spaces; the whole
text is encoded, a block at a time, so that what a long text says of itself doesn't drown
the dictionary.  The margin is the share of bytes that the smallest encoding saves over the
second.  Which margins are narrow is learned from labelled rows that no dictionary was made
of and from mixtures of two such rows of different languages, which no answer is right for:
the bound is where fewest right answers are rejected and fewest others accepted, a mixture
counting MIXTURE_WEIGHT.  Equal sizes are always narrow.  The score is 0.5 at the bound.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if no
labelled rows exist.  Sizes that tie go to the language with more labelled rows.  Rows of
one id are told one by one; rows without an id aren't held out, and aren't learned from.
A text is encoded once for each language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import free_name, map_rows, small_batches, tidied, written

UNKNOWN = "und"
#: Bounds of the sample that is learned from: bytes of a dictionary, labelled rows a language (half for dictionaries, half for
#: the margin), and languages (those with most labelled rows are learned), so that the model is small enough to go to every task.
DICTIONARY_BYTES = 1 << 16
SAMPLE_ROWS = 2_000
MAX_LANGUAGES = 256
#: Bytes that are encoded at a time.
BLOCK = 8_192
#: How bad it is to accept a mixture, where a wrong answer accepted and a right one rejected are 1: one text in a hundred is taken for one.
MIXTURE_WEIGHT = 0.01
#: The margin of score 0.5 where no narrow one was found.
USUAL_MARGIN = 0.01

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, languages with more labelled rows first, and the largest narrow margin."""

    dictionaries: tuple[tuple[str, bytes], ...] = ()
    narrow: float = 0.0


def letters_only(text: str) -> str:
    """Letters in lower case between single spaces; empty if there is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def learning_rows(docs: DataFrame, key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Rows to learn from: labelled, and not held out."""
    return docs.where(F.col(label).isNotNull() & ~held_out(key))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """The model of a sample that is fixed by a hash of the key.

    Tasks keep the first rows of each language before anything is shuffled, and only ids
    travel until the rows are chosen; the chosen rows' whole texts are written.
    """
    rows = learning_rows(docs, key, label).where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("string").alias("_lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_LANGUAGES).collect()}
    # The first rows by hash are in the lowest part of all hashes; only twice as many as are wanted are ordered, however many tasks there are.
    lowest = {lang: int(-(1 << 63) + (1 << 64) * min(1.0, 2 * SAMPLE_ROWS / n)) - 1 for lang, n in counts.items()}
    if not counts:
        return Model()
    bound = F.element_at(F.create_map(*[F.lit(x) for item in lowest.items() for x in item]), F.col("_lang"))
    low = rows.where(F.col("_lang").isin(*counts)).where(F.xxhash64("_id") <= bound).distinct()
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = low.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= SAMPLE_ROWS)
    # Where a key repeats, each place in the sample takes one text; rows of one key and language have one place.
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(text).cast("string").alias("_text"))
    met = texts.join(F.broadcast(chosen), (F.col("_key") == F.col("_id")) & (F.col("_label") == F.col("_lang")))
    sample = written(met.groupBy("_lang", "_rank").agg(F.min("_text").alias("text")), "language-sample")
    made = _dictionaries(sample)
    dictionaries = tuple((lang, made[lang]) for lang in sorted(made, key=lambda k: (-counts[k], k)))
    return Model(dictionaries, narrow_margin(_margins(sample, dictionaries)))


def _dictionaries(sample: DataFrame) -> dict[str, bytes]:
    """By language, the texts of odd places that fit whole, in their order; the shortest is cut where none does."""
    odd = sample.where("_rank % 2 = 1")
    room: dict[str, int] = {}
    taken: list[tuple[str, int]] = []
    # At most SAMPLE_ROWS / 2 numbers a language.
    sizes = sorted(tuple(r) for r in odd.select("_lang", "_rank", F.octet_length("text") + 1).collect())
    for lang, rank, size in sizes:
        if size <= room.setdefault(lang, DICTIONARY_BYTES):
            room[lang] -= size
            taken.append((lang, rank))
    without = {lang for lang, _, _ in sizes} - {lang for lang, _ in taken}
    taken += [min((size, lang, rank) for lang, rank, size in sizes if lang == w)[1:] for w in without]
    if not taken:
        return {}
    wanted = odd.sparkSession.createDataFrame(taken, "_lang string, _rank int")
    # At most DICTIONARY_BYTES a language, besides one text that is longer.
    cut = F.substring("text", 1, DICTIONARY_BYTES)
    out: dict[str, bytes] = {}
    for lang, _, body in sorted(tuple(r) for r in odd.join(F.broadcast(wanted), ["_lang", "_rank"]).select("_lang", "_rank", cut).collect()):
        out[lang] = out.get(lang, b"") + letters_only(body).encode() + b" "
    return {lang: body[:DICTIONARY_BYTES] for lang, body in out.items()}


def _margins(sample: DataFrame, dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[float, float]]:
    """Margin, and how good it is to accept it, of the texts of even places and of their mixtures; at most SAMPLE_ROWS numbers a language."""
    if len(dictionaries) < 2:
        return []
    even = sample.where("_rank % 2 = 0").select("_lang", "_rank", "text")
    names = sorted(lang for lang, _ in dictionaries)
    # Each text is mixed with that of the same place in the next language: as much of one as of the other.
    after = even.select(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, names[i - 1])]), F.col("_lang")).alias("_lang"), "_rank", F.col("text").alias("_next"))
    least = F.least(F.length("text"), F.length("_next"))
    mixed = even.join(after, ["_lang", "_rank"]).select(F.lit(None).cast("string").alias("_lang"), F.concat_ws(" ", F.substr("text", F.lit(1), least), F.substr("_next", F.lit(1), least)).alias("text"))

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        classifier = Classifier(Model(dictionaries))
        for row in rows:
            if found := classifier.best(row["text"]):
                yield found[1], -MIXTURE_WEIGHT if row["_lang"] is None else 1.0 if found[0] == row["_lang"] else -1.0

    return [tuple(r) for r in map_rows(even.select("_lang", "text").unionByName(mixed), run, "margin double, worth double").collect()]


def narrow_margin(told: Iterable[tuple[float, float]]) -> float:
    """The margin up to which all answers together are worth least, the smallest of equals; 0 if none is worth less than nothing."""
    narrow, least, sofar, rows = 0.0, 0.0, 0.0, sorted(told)
    for i, (margin, worth) in enumerate(rows):
        sofar += worth
        if sofar < least - 1e-9 and (i + 1 == len(rows) or rows[i + 1][0] > margin):
            narrow, least = margin, sofar
    return narrow


class Classifier:
    def __init__(self, model: Model):
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        # Greedy search for matches of three bytes and more: parts of words count, which the faster strategies don't look for.
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_GREEDY, **options)
        self.narrow = model.narrow
        self.encoders = []
        for lang, body in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            self.encoders.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)))

    def best(self, text: str | None) -> tuple[str, float] | None:
        """The language of the smallest encoding and its margin; None where nothing can be told."""
        body = letters_only(text or "").encode()
        if not body or not self.encoders:
            return None
        blocks = [body[at : at + BLOCK] for at in range(0, len(body), BLOCK)]
        sizes = [sum(len(e.compress(b)) for b in blocks) for _, e in self.encoders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        return self.encoders[order[0]][0], 1.0 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the answer is accepted."""
        if (found := self.best(text)) is None:
            return UNKNOWN, 0.0, False
        lang, margin = found
        return lang, margin / (margin + (self.narrow or USUAL_MARGIN)), margin > self.narrow


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        classifier = Classifier(model)
        for row in rows:
            yield row["doc_id"], bool(row["held_out"]), *classifier(row["text"])

    sent = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return map_rows(sent, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, columns as in ``docs``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        classifier = Classifier(model)
        for batch in batches:
            keep = pa.array([classifier(t)[2] for at in range(0, batch.num_rows, 256) for t in batch.slice(at, 256).columns[-1].to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(c, keep) for c in batch.columns[:-1]], names=names)

    return docs.select("*", F.col(text).cast("string").alias(free_name(docs, "_text"))).mapInArrow(tidied(run), docs.schema)
