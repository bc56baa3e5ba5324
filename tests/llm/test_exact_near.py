import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logtide.llm import exact_dedup, near_dedup, queries
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


def frame(spark, texts, **extra):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = {0: None, 1: "", 2: " \t\n", 3: "a  b", 4: "a\tb", 5: "a b", 6: "A b", 7: "x" * 100_000, 8: "x" * 100_000, 9: "a b ", 10: "é b", 11: "é b"}


def check_exact(rows, texts):
    want = brute.exact_groups(texts)
    assert len(rows) == len(texts)
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_odd_texts(spark):
    df = frame(spark, ODD, h="clash", norm=1, keep_id=2, sha="x")
    check_exact(exact_dedup.exact_groups(df).collect(), ODD)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 6, 7, 9, 10, 11]


def test_exact_collisions(spark):
    """Hashes that collide are told apart by bytes."""
    check_exact(exact_dedup.exact_groups(frame(spark, ODD), hashed=lambda t: F.lit(b"one")).collect(), ODD)
    check_exact(exact_dedup.exact_groups(frame(spark, ODD), hashed=lambda t: F.substring(t, 1, 1).cast("binary")).collect(), ODD)


def test_exact_hot_group_and_empty(spark):
    texts = {i: "copy" if i % 3 else f"text {i}" for i in range(900)}
    check_exact(exact_dedup.exact_groups(frame(spark, texts)).collect(), texts)
    assert exact_dedup.exact_groups(frame(spark, ODD).where("false")).count() == 0


def test_exact_repeated_rows(spark):
    df = frame(spark, {1: "a", 2: "b"})
    rows = exact_dedup.exact_groups(df.union(df)).collect()
    assert len(rows) == 4 and all(r.group_size == 2 and r.kept for r in rows)


def test_dedup_of_repeated_ids(spark):
    """Of rows with equal id and text one stays; rows of one id with other texts are judged by their texts; null ids are the largest."""
    rows = [(1, "a"), (1, "a"), (1, "a "), (2, "b"), (2, "b"), (2, "a"), (1, "c"), (None, "b"), (None, "d"), (None, "d"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("_row", F.lit(2))
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 9, r.text) for r in kept.collect()) == [(1, "a"), (1, "a "), (1, "c"), (2, "b"), (9, "d")]
    near = near_dedup.near_dedup(df)
    assert near.columns == df.columns
    assert sorted((r.doc_id or 9, r.text.strip()) for r in near.collect()) == [(1, "a"), (1, "c"), (2, "b"), (9, "d")]


def copies(n, seed=1):
    """Texts and edited copies of them of all degrees, with a hot group and a passage that many share."""
    rng = random.Random(seed)

    def words(k):
        return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(k)]

    passage, hot = words(40), words(120)
    texts = {}
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.4:
            base, edits = list(hot), rng.randint(0, 9)
        elif kind < 0.6:
            base, edits = words(rng.randint(5, 60)) + passage, 0
        elif kind < 0.8 and texts:
            base, edits = (texts[rng.randrange(len(texts))] or "").split() or words(9), rng.randint(0, 6)
        else:
            base, edits = words(rng.randint(1, 200)), 0
        base = list(base)
        for _ in range(edits):
            base[rng.randrange(len(base))] = words(1)[0]
        texts[len(texts)] = " ".join(base)
    return texts | {n: None, n + 1: "", n + 2: "one", n + 3: "ONE", n + 4: "one two three four", n + 5: " \n", n + 6: "word " * 30_000}


def check_near(rows, texts):
    want, sizes = brute.near_components(texts)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for k in texts:
        assert (got[k].component_id, got[k].n_shingles, got[k].kept) == (want[k], sizes[k], want[k] == k), k


def test_near_against_all_pairs(spark):
    texts = copies(400)
    check_near(near_dedup.near_groups(frame(spark, texts, bands="x", size=3, hub=1, rep=2)).collect(), texts)


def test_near_blocks_split(spark, monkeypatch):
    """Groups of many blocks give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    texts = copies(250, 2)
    check_near(near_dedup.near_groups(frame(spark, texts)).collect(), texts)


def test_near_buckets_of_unlike_sizes(spark, monkeypatch):
    """Members that share a bucket without being linked to its hub are compared by levels of size, and blocks are bounded by shingles too."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 600)
    # One band of one register: nearly all texts of the passage meet in a bucket.
    monkeypatch.setattr(near_dedup, "BANDS", 40)
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    monkeypatch.setattr(near_dedup, "REGISTERS", 40)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(120):
        own = [f"{rng.choice('abcdef')}{rng.randrange(10_000)}" for _ in range(rng.choice([5, 20, 60, 63, 66, 200]))]
        texts[i] = " ".join(passage + own)
        if i % 4 == 0:
            texts[1000 + i] = " ".join(passage + own[:-1] + ["end"])
    check_near(near_dedup.near_groups(frame(spark, texts)).collect(), texts)


def test_near_sizes_at_the_threshold():
    """Sizes that can be linked are at most one level apart."""
    import math

    level = lambda n: math.floor(math.log(n) / math.log(near_dedup.LEVEL))
    assert all(level(t) - level(-(-75 * t // 100)) <= 1 for t in range(1, 200_000))


def test_near_ids_of_any_type(spark):
    """Ids may be texts, null or repeated: a group has the id of its first row, nulls being last."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    named = spark.createDataFrame([("x", a), ("y", b), ("w", a + " "), ("z", None)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(named).collect()} == {("w", "w", True), ("x", "w", False), ("y", "y", True), ("z", "z", True)}
    rows = [(5, a), (5, b), (5, b), (None, a), (None, "alone"), (3, b), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.lit(1))).collect()), key=str)
    assert got == sorted([(5, 5, True, 3), (5, 3, False, 1), (5, 3, False, 1), (None, 5, False, 3), (None, None, True, 1), (3, 3, True, 1), (None, None, True, 0)], key=str)


def test_near_empty_and_filter(spark):
    texts = {0: "a b c d e f g", 1: "a b c d e f g", 2: None, 3: None}
    df = frame(spark, texts, lang="en")
    assert near_dedup.near_groups(df.where("false")).count() == 0
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_superminhash_by_definition():
    """The stepwise signature is that of each item's whole permutation; its agreement estimates the likeness."""
    import numpy as np

    rng = np.random.default_rng(0)
    items = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    m = 16
    want = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for x in items:
        order = list(range(m))
        for j in range(m):
            one = np.array([x])
            k = j + int(near_dedup._mixed(one, 2 * j + 2)[0] % np.uint64(m - j))
            order[j], order[k] = order[k], order[j]
            value = int(near_dedup._mixed(one, 2 * j + 1)[0]) >> 16 | j << 48
            want[order[j]] = min(int(want[order[j]]), value)
    assert (near_dedup.superminhash(items, m) == want).all()
    a, b = items[:30], items[10:]
    errors = []
    for seed in range(200):
        mix = np.uint64(seed * 7919 + 1)
        errors.append((near_dedup.superminhash(np.unique(a * mix), 128) == near_dedup.superminhash(np.unique(b * mix), 128)).mean() - 20 / 40)
    assert abs(sum(errors) / len(errors)) < 0.02


@pytest.mark.parametrize("name", ["op4_near_dedup"])
def test_near_query(spark, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    check_near(queries.QUERIES[name](spark, SMALL).collect(), texts)
