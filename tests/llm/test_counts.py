"""Phrases, merges and divergence of sources, held against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from logtide.llm import collocations, divergence, merge_bpe, queries

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(seed, n):
    """Texts of few words, so that phrases repeat; with nulls, signs, long runs and empty texts."""
    rng = random.Random(seed)
    words = ["The", "of", "é", "Ünit", "x1", "\x00z", "a-b", "日本", "end", "`q`", " ", "or"]
    out = []
    for i in range(n):
        text = rng.choice(["", None, " \t", "...", "!"]) if rng.random() < 0.1 else "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in range(rng.randint(1, 40)))
        out.append((i, text, rng.choice(["en", "de", None, "", "und"]), rng.choice(["a", "b", None, "", "é", "zz"])))
    return out + [out[1]] * 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("term", F.lit(2)).withColumn("docs", F.lit(3))


# --- merges


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def merges():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        return merge_bpe.MergeEncoder(merge_bpe.Vocabulary(file.read()))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_merges_equal_the_library(merges, library):
    rng = random.Random(5)
    strings = merges.vocabulary.strings
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "it's 12,345.67", "日本語 \u0085 　", "\x00\x1c\x1f a", "ab" * 30_000, " " * 9_999 + "x", "é" * 5_000]
    texts += ["".join(rng.choice(strings) for _ in range(rng.randint(0, 9))).encode("latin-1").decode("utf-8", "ignore") for _ in range(5_000)]
    texts += ["".join(rng.choice("aab  e.-=xzéß9") for _ in range(rng.randint(1, 60))) for _ in range(2_000)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(merges.encode(text)) == expected, text[:60]
        assert merges.decode(merges.encode(text)) == library.decode(expected, skip_special_tokens=False)


def test_merges_cut_all_characters_alike(merges, library):
    for at in range(0, 0x30000, 7):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}1{chr(at)} {chr(at)}b {chr(at)}{chr(at)}"
            assert ids(merges.encode(text)) == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_merges_decode_any_ids(merges, library):
    rng = random.Random(6)
    for _ in range(500):
        row = [rng.randrange(50_257) for _ in range(6)]
        assert merges.decode(np.array(row, "<u4").tobytes()) == library.decode(row, skip_special_tokens=False)


def test_merges_refuse_other_models():
    with pytest.raises(ValueError):
        merge_bpe.Vocabulary(b'{"model": {"type": "BPE", "vocab": {}, "merges": [], "dropout": 0.1}, "pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}}')


def test_merges_operator(spark, library):
    shared = merge_bpe.share_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "hello hello", "é\n" * 1000, "hello hello"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_source", F.lit(1)).withColumn("decoded", F.lit("old"))
    both = merge_bpe.round_trip(df, shared).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, merge_bpe.decode(merge_bpe.encode(df, shared), shared).select(*both[0].__fields__).collect()))
    for r in both:
        text = texts[r.doc_id] or ""
        assert ids(bytes(r.token_ids)) == library.encode(text, add_special_tokens=False).ids and r.decoded == text and r._source == 1
    assert merge_bpe.round_trip(df.where("false"), shared).count() == 0


def test_merges_query(spark, library):
    found = {r.doc_id: r for r in queries.op12_merge_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        own = library.encode(d.text or "", add_special_tokens=False).ids
        assert found[d.doc_id].n_tokens == len(own)
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- phrases


def phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least or len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and f[q] >= least and 100 * f[q] >= 50 * a for q in f):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard_keys", [1_500_000, 20])
def test_phrases(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(collocations, "SHARD_KEYS", shard_keys)
    rows = rows_of(1, 300)
    found = collocations.mine(frame(spark, rows), least=4, top=25).collect()
    assert sorted(map(tuple, found)) == phrases(rows, 4, 25) and len(found) > 60


def test_phrases_of_many_shards_take_no_more_passes(spark, monkeypatch):
    """What is written, and with it how often ids are read, doesn't grow with the number of shards."""
    names, write, rows = [], collocations.written, rows_of(6, 80)
    monkeypatch.setattr(collocations, "written", lambda df, name: names[-1].append(name) or write(df, name))
    for shard_keys in (1_500_000, 60):
        monkeypatch.setattr(collocations, "SHARD_KEYS", shard_keys)
        names.append([])
        assert sorted(map(tuple, collocations.mine(frame(spark, rows), least=3, top=30).collect())) == phrases(rows, 3, 30)
    assert names[0] == names[1]


@pytest.mark.parametrize("shards", [1, 8, 256])
def test_shards_of_phrases(monkeypatch, shards):
    """All steps over ids, with tasks that emit often, against counts; the filters have places for few."""
    monkeypatch.setattr(collocations, "MOST_PLACES", 100)
    monkeypatch.setattr(collocations, "WINDOW", 64)
    rng = np.random.default_rng(shards)
    words = np.concatenate([[0, 0], rng.integers(1, 1 << 63, 30).astype(np.uint64)]).astype(np.uint64)
    texts = [np.concatenate([words[np.minimum(rng.geometric(0.25, 400), 31)], [0, 0]]).astype(np.uint64) for _ in range(9)]
    tasks = [[pa.RecordBatch.from_arrays([pa.array([zstandard.compress(x.tobytes()) for x in texts[i::3]], pa.binary())], names=["ids"])] for i in range(3)]
    least, bits = 7, shards.bit_length() + 2

    def over(step):
        """Rows of all tasks, dealt by shard."""
        rows = [b.slice(i, 1) for task in tasks for b in step(iter(task)) for i in range(b.num_rows)]
        assert len(rows) > 2 * len({r["shard"][0].as_py() for r in rows})
        return iter(sorted(rows, key=lambda r: r["shard"][0].as_py()))

    class Shared:
        def __init__(self, step):
            made = {k: b for r in collocations._full_buckets(least, shards, bits)(over(step)) for k, b in zip(r["shard"].to_pylist(), r["bits"].to_pylist(), strict=True)}
            self.value = b"".join(made.get(k, bytes((1 << bits) // 8 // shards)) for k in range(shards))

    pairs = Shared(collocations._bucketed(None, shards))
    triples = Shared(collocations._bucketed(pairs, shards))
    found = Counter()
    for r in collocations._by_slot(least, shards)(over(collocations._candidates(pairs, triples, shards))):
        for *key, f in zip(*(np.array(c).tolist() for c in r.columns), strict=True):
            assert tuple(key) not in found
            found[tuple(key)] = f
    expected = Counter()
    for x in texts:
        own = x.view(np.int64).tolist()
        expected.update((a, b, 0) for a, b in zip(own, own[1:], strict=False) if a and b)
        expected.update((a, b, c) for a, b, c in zip(own, own[1:], own[2:], strict=False) if a and b and c)
    assert found == Counter({k: n for k, n in expected.items() if n >= least}) and len({bool(k[2]) for k in found}) == 2


def test_phrases_of_one_language_and_one_word(spark):
    rows = [(i, "Buffalo " * 40, None, None) for i in range(30)]
    assert sorted(map(tuple, collocations.mine(frame(spark, rows)).collect())) == phrases(rows, 10, 2000)


def test_phrases_of_nothing(spark):
    docs = frame(spark, rows_of(1, 5))
    assert collocations.mine(docs.where("false")).count() == 0
    assert collocations.mine(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 50, (3, 30_000)).astype(np.uint64)
    keys = np.unique(keys, axis=1)
    table = collocations.PerfectHash.unpacked(collocations.PerfectHash.build(keys).packed())
    slots = table.slots(*keys)
    assert sorted(slots.tolist()) == list(range(keys.shape[1])) and (table.keys[:, slots] == keys).all()
    others = rng.integers(50, 99, (3, 30_000)).astype(np.uint64)
    assert (table.slots(*others) == -1).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(random.Random(2).choice(["one", "two. ", "three!", "é", "four"]) for _ in range(3_000)).encode()
    docs = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, b"tail"], pa.binary())], names=["lang", "text"])

    def all_rows():
        """Words with the two behind them, by what rows of ids say."""
        rows = [pa.RecordBatch.from_arrays([pa.array([zstandard.compress(x.tobytes())], pa.binary())], names=["ids"]) for x in collocations._texts_ids(iter([docs]), 0)]
        return [np.concatenate(x).tolist() for x in zip(*collocations._windows(iter(rows)), strict=True)]

    whole, terms = all_rows(), [t for part in divergence.term_pieces(text) for t in part]
    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(collocations, "WINDOW", 50)
    assert all_rows() == whole and [t for part in divergence.term_pieces(text) for t in part] == terms


# --- divergence


def divergences(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, peers = len(kept), {s: c for (x, s), c in groups.items() if x == lang}

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p, q = shares(counts), shares(sum(peers.values(), Counter()))
        pairs = [(-sum(abs(p[t] - x[t]) for t in kept), s.encode()) for s, c in peers.items() if s != source for x in [shares(c)]]
        terms = [(q[t] - p[t], t.encode()) for t in kept if counts[t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("one_in", [1, 2, 100])
def test_divergence(spark, monkeypatch, one_in):
    """All terms light, some heavy, all heavy."""
    monkeypatch.setattr(divergence, "DENSE_ONE_IN", one_in)
    rows = rows_of(3, 250)
    found = sorted(map(tuple, divergence.audit(frame(spark, rows), least_docs=6, top=5).collect()))
    assert found == divergences(rows, 6, 5) and len(found) > 100


def test_divergence_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 2)
    rows = rows_of(4, 120)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), least_docs=5).collect())) == divergences(rows, 5, 50)


def test_divergence_without_terms(spark):
    rows = [(1, None, "en", "a"), (2, "1 2 3", "en", "b"), (3, "x", None, None)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(frame(spark, rows).where("false")).count() == 0


def test_divergence_in_blocks(monkeypatch):
    """Sources beyond a block, dense and sparse, against all pairs."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "TILE", 40)
    monkeypatch.setattr(divergence, "MOST_BLOCKS", 3)
    n, p0 = 11, rng.integers(1, 100, 11)
    full = np.where(rng.random((30, n)) < 0.5, p0 + rng.integers(1, 1000, (30, n)), p0)
    held = [np.flatnonzero(row != p0) for row in full]
    kind = pa.list_(pa.struct([("gid", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())]))
    found = pa.array([[{"gid": int(g), "p": int(row[g]), "p0": int(p0[g])} for g in rng.permutation(h)] for row, h in zip(full, held, strict=True)], kind)

    def pairs(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                assert r["lo"] < r["hi"]
                out[r["lo"], r["hi"]] += r["value"]
        return out

    def batch(zeros):
        return pa.RecordBatch.from_arrays([pa.array(["en"] * 30), found, pa.array([zeros] * 30, pa.list_(pa.int64()))], names=["lang", "found", "zeros"])

    expected = Counter({(i, j): int(np.abs(full[:, i] - full[:, j]).sum()) for i in range(n) for j in range(i + 1, n)})
    assert pairs(divergence._compare(iter([batch(p0.tolist())]))) == expected
    values = [Counter(full[[i for i, h in enumerate(held) if g in h], g].tolist()) for g in range(n)]
    light = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * n), pa.array(range(n), pa.int32()), pa.array([30] * n, pa.int64()), pa.array([[{"p": p, "n": k} for p, k in c.items()] for c in values], pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))), pa.array([p0.tolist()] * n, pa.list_(pa.int64()))],
        names=["lang", "gid", "light", "found", "zeros"],
    )
    total = pairs(divergence._compare(iter([batch(None)])))
    total.update(pairs(divergence._alone(iter([light]))))
    assert {k: v for k, v in total.items() if v} == dict(expected)


def test_divergence_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(tuple, queries.op13_source_divergence(spark, SMALL).collect())) == divergences(docs, 30, 50)
