import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import language, mixing, queries, sharding
from logtide.llm.common import written
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_hilbert(spark, axes, bits):
    """Each index occurs once, and neighbours on the curve are neighbours in the grid."""
    cells = spark.range(1 << axes * bits).select(*[F.expr(f"(id >> {bits * i}) & {(1 << bits) - 1}").alias(f"x{i}") for i in range(axes)])
    rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(axes)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << axes * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(axes)) == 1 for a, b in zip(rows, rows[1:]))


def check_shards(rows, texts, shards=8):
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert not rows or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 100])
def test_shards(spark, n):
    texts = {i: [None, "", "é", "same", "x" * i][i % 5] for i in range(n)}
    df = documents(spark, [(i, t, None if i % 4 == 0 else "hot") for i, t in texts.items()]).withColumn("curve", F.lit(1)).withColumn("place", F.lit(1))
    check_shards(sharding.shard_documents(df).collect(), texts)


def shards_met(spark, docs, sf):
    """By dimension: of 8 shards, how many a filter by one value (an eighth of the range for numbers) meets on average."""
    rows = sharding.shard_documents(docs).drop("size").join(docs.select("doc_id", "lang", "source", F.octet_length("text").alias("size")), "doc_id").toPandas()
    out = {c: rows.groupby(c).shard.nunique().mean() for c in ("lang", "source")}
    for c in ("size", "doc_id"):
        ends = rows[c].quantile([i / 8 for i in range(9)]).values
        out[c] = sum(rows[(rows[c] >= a) & (rows[c] <= b)].shard.nunique() for a, b in zip(ends, ends[1:])) / 8
    copies = rows.groupby("text_crc32").shard.agg(["nunique", "size"])
    return out, int((copies["nunique"] > 1).sum()), int((copies["size"] > 1).sum())


def test_shards_prune(spark):
    """Filters by language, source and id meet a part of the shards, and equal texts lie together but for shards' ends."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    met, cut, groups = shards_met(spark, docs, SMALL)
    print("all:", met, "groups cut:", cut, "of", groups)
    assert met["lang"] <= 6 and met["source"] <= 5.5 and met["doc_id"] < 7.5 and cut <= 7 < groups
    met, cut, groups = shards_met(spark, docs.dropDuplicates(["text"]), SMALL)
    print("without copies:", met)
    assert met["lang"] <= 4.5 and met["source"] <= 4.5 and met["doc_id"] < 7 and met["size"] < 8 and groups == 0


def test_cells_are_ranks(spark):
    """A value's cell is the share of rows with smaller values."""
    rows = documents(spark, [(i, "x", "abc"[0 if i < 50 else 1 if i < 75 else 2]) for i in range(100)])
    assert {r.source: (r.n, r.cell) for r in sharding.name_cells(rows, "source", 100).collect()} == {"a": (50, 0), "b": (25, 32), "c": (25, 48)}
    bounds = [float(i) for i in range(1, 64)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (None, -5.0, 1.0, 1.5, 30.0, 62.5, 63.0, 99.0)], "v double").select(sharding.quantile_cell(F.col("v"), bounds)).collect()]
    assert got == [0, 0, 0, 1, 29, 62, 62, 63]


def test_shards_of_any_ids(spark, tmp_path):
    """Ids may be texts or null and may repeat; columns that clash with ours stay, but for the folders' name."""
    named = spark.createDataFrame([(f"id{i}", "same" if i % 2 else f"t{i}", None) for i in range(20)], "doc_id string, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    rows = sharding.shard_documents(named, 4).collect()
    assert Counter(r.shard for r in rows) == Counter({s: 5 for s in range(4)}) and len({r.doc_id for r in rows}) == 20
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same")}) == 2
    df = documents(spark, [(i, "x" * i, f"s{i % 16}") for i in range(2048)]).withColumn("shard", F.lit("old")).withColumn("_where_x", F.lit(1)).withColumn("slot", F.lit(2))
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2048 and set(out.columns) == set(df.columns) and {r.shard for r in out.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert out.agg(F.sum("slot"), F.sum("_where_x")).first() == (4096, 2048)
    long = documents(spark, [(0, "long " * 400_000, "s"), (1, None, None)])
    assert sorted(r["size"] for r in sharding.shard_documents(long).collect()) == [1, 2_000_001]


def plain_hilbert(cells, bits):
    """Skilling's transpose, on numbers."""
    x, n = list(cells), len(cells)
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & bit:
                x[0] ^= bit - 1
            else:
                t = (x[0] ^ x[i]) & (bit - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & bit:
            t ^= bit - 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def plain_shards(rows, shards):
    """{doc_id: (shard, slot)} by the definitions, row by row."""
    total, bits = len(rows), sharding.BITS
    texts = {i: t or "" for i, t, *_ in rows}
    names = [{i: "" if r[k] is None else "=" + r[k] for i, *r in rows} for k in (1, 2)]

    def name_cell(values):
        counts = Counter(values.values())
        before, out = 0, {}
        for v in sorted(counts, key=str.encode):
            out[v] = before * (1 << bits) // total
            before += counts[v]
        return out

    def number_cell(values):
        ranked = sorted(values)
        bounds = [ranked[max(0, math.ceil(k * total / (1 << bits)) - 1)] for k in range(1, 1 << bits)]
        return lambda v: sum(b < v for b in bounds)

    sizes = {i: len(t.encode()) + 1 for i, t in texts.items()}
    of_name, of_size, of_id = [name_cell(n) for n in names], number_cell(sizes.values()), number_cell(texts)
    copies = defaultdict(list)
    for i, t in texts.items():
        copies[t].append(i)
    keys = []
    for i, t in texts.items():
        first = min(((float(j), names[0][j].encode(), names[1][j].encode(), j) for j in copies[t]))[-1]
        cells = [of_name[0][names[0][first]], of_name[1][names[1][first]], of_size(sizes[i]) >> sharding.SIT_OUT, of_id(first) >> sharding.SIT_OUT]
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        keys.append((len(copies[t]) == 1, plain_hilbert(cells, bits), h - (1 << 64) * (h >> 63), i))
    out, slots = {}, Counter()
    for place, (*_, i) in enumerate(sorted(keys)):
        shard = place * shards // total
        out[i] = (shard, slots[shard])
        slots[shard] += 1
    return out


@pytest.mark.parametrize("n", [1, 37, 700])
def test_shards_equal_plain_placement(spark, n):
    """Every row's shard and slot; most texts are empty."""
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["", "", None, "", "copy", "x" * rng.randint(1, 900), f"é{i}"]), rng.choice(["de", "en", "fr", None, "é"]), rng.choice([None, *"abcdefg"])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for shards in (8, 3):
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(df, shards).collect()} == plain_shards(rows, shards)


def test_shards_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    check_shards(queries.QUERIES["op9_hilbert_shards"](spark, SMALL).collect(), texts)


def water_filled(sizes, passes=3):
    """Targets by the definition: share by weight, cut at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while rest > 1e-9 and open_:
        total, left = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= passes * sizes[s]:
                rest += target[s] - passes * sizes[s]
                target[s] = float(passes * sizes[s])
                open_.discard(s)
    return target


def check_mix(rows, docs):
    assert len(rows) == len(docs)
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    target, taken, largest = water_filled(sizes), Counter(), max(size.values(), default=0)
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and r.taken <= 3 * r["size"]
        assert abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest + 1
    assert sum(taken.values()) <= sum(size.values())


CASES = {
    "empty": [],
    "one": [(0, "a b c", "s")],
    "no words": [(0, None, "s"), (1, "", None), (2, "  ", "t")],
    "caps": [(i, "w " * 3, "big") for i in range(200)] + [(900, "x y", "a"), (901, "x", "b"), (902, None, None), (903, "z z z", None)],
    "hot": [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 11}") for i in range(600)],
}


@pytest.mark.parametrize("case", CASES)
def test_mix(spark, case):
    df = documents(spark, CASES[case]).withColumn("size", F.lit("clash")).withColumn("idx", F.lit(1)).withColumn("times", F.lit(1))
    rows = mixing.mix(df).collect()
    check_mix(rows, CASES[case])
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.times for r in rows if r.times})


def queue_by_definition(spark, docs, passes=3):
    """Times that each document is taken: queues in the shuffled order, finish times, one merge, cut at the budget."""
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i, _, _ in docs], "doc_id long").select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _ in docs}
    order = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: sum(size[i] for i, _, x in docs if x == s) for s in order}
    entries = []
    for idx, s in enumerate(order):
        queue, weight, sofar = sorted((hashes[i], i) for i, _, x in docs if x == s), mixing.WEIGHTS[idx % 3], 0
        for place, (_, i) in enumerate(queue):
            sofar += size[i]
            entries += [((p * whole[s] + sofar) / weight, idx, place, p, i) for p in range(passes)]
    taken, budget, sofar = Counter(), sum(size.values()), 0
    for *_, i in sorted(entries):
        sofar += size[i]
        if sofar <= budget:
            taken[i] += 1
    return taken


@pytest.mark.parametrize("case", CASES)
def test_mix_is_the_queue(spark, case):
    """Finish times, ties and the cut, document by document."""
    got = Counter({r.doc_id: r.times for r in mixing.mix(documents(spark, CASES[case])).collect() if r.times})
    assert got == +queue_by_definition(spark, CASES[case])


def test_mix_of_many_sources(spark):
    """Sources as many as documents, hot or not, long texts and null ids."""
    rows = [(i, "w " * (1 + i % 5), f"host{i}") for i in range(300)] + [(1000 + i, "w " * 7, "hot") for i in range(300)] + [(9999, "long " * 100_000, None)]
    check_mix(mixing.mix(documents(spark, rows)).collect(), rows)
    nulls = mixing.mix(documents(spark, [(None, "a b", "s"), (None, "c", "s"), (1, "d", None)])).collect()
    assert len(nulls) == 3 and sum(r.taken for r in nulls) <= 4


def test_mix_reruns_agree(spark):
    df = documents(spark, CASES["hot"])
    first = sorted(map(tuple, mixing.mix(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("k", [2, 5])
def test_mix_of_repeated_rows(spark, k):
    """Each row is taken as often as the mix says, and the mix keeps to its budget; rows of one id stay apart."""
    rows = [(i % 20 if i % 20 else None, "w " * (1 + i % 20), "s" if i % 3 else "t") for i in range(20)] * k + [(7, "other words", "s"), (7, "x", "t")]
    df = documents(spark, rows)
    times = Counter()
    for r in mixing.mix(df).collect():
        times[r.doc_id, r["size"]] += r.times
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = Counter((r.doc_id, len(brute.WORD.findall(r.text))) for r in mixed.collect())
    assert got == +times and sum(n * size for (_, size), n in got.items()) <= sum(len(brute.WORD.findall(t)) for _, t, _ in rows)


def test_shards_of_repeated_rows(spark, tmp_path):
    rows = [(1, "a", "s")] * 9 + [(1, "b", "s"), (None, "c", "t"), (None, "c", None)]
    df = documents(spark, rows)
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    assert Counter(r.shard for r in out) == Counter({s: 3 for s in range(4)})


def test_pipeline_of_repeated_rows(spark):
    """A table whose rows all occur twice gives what it gives once, up to the mix."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 300")
    stages = dict(corpus_pipeline.STAGES)
    out = []
    for last in (docs, docs.union(docs)):
        for name in ("exact", "near", "mixing"):
            last = written(stages[name](spark, last, SMALL), "test-stage")
        out.append(Counter(r.doc_id for r in last.select("doc_id").collect()))
    assert out[0] == out[1]


def test_mix_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(queries.QUERIES["op10_fair_mix"](spark, SMALL).collect(), docs)


def left(spark):
    """Tables of the shared folder."""
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))


def test_pipeline(spark):
    """Stage by stage against brute force, each on what the one before it kept."""
    import hashlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "mixing", "encoding"]
    kept = {"start": docs}
    last = docs
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, last, SMALL)
        assert out.columns == docs.columns
        last = kept[name] = written(out, "test-stage")
    texts = {name: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for name, df in kept.items()}
    model = language.train(docs)
    assert set(texts["language"]) == {k for k, t in texts["start"].items() if brute.language(model.dictionaries, t, model.narrow, language.BLOCK)[2]}
    assert 0.97 * len(texts["start"]) <= len(texts["language"]) < len(texts["start"])
    groups = brute.exact_groups(texts["language"])
    assert set(texts["exact"]) == {k for k, (keep, _) in groups.items() if keep == k}
    near, _ = brute.near_components(texts["exact"])
    assert set(texts["near"]) == {k for k, c in near.items() if k == c}
    mixed = [r.doc_id for r in kept["mixing"].collect()]
    assert set(mixed) <= set(texts["near"]) and max(Counter(mixed).values()) <= 3
    before = left(spark)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len(left(spark) - before) == 1
    assert Counter(r.doc_id for r in rows) == Counter(mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(texts["start"][r.doc_id].encode()).hexdigest() for r in rows)
