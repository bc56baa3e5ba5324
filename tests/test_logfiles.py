"""Log files in ranges of bytes, against reading them whole."""

import gzip
import random

import pytest

from logtide.operators.parse import LogFormat
from logtide.sources import logfiles

FORMATS = [LogFormat(), LogFormat("j", ("*.sjis",), encoding="cp932"), LogFormat("w", ("*.be",), encoding="utf-16-be"), LogFormat("i", ("*.jis",), encoding="iso2022_jp"), LogFormat("l", ("*.latin",), encoding="latin-1")]


def whole(files):
    """Rows by decoding each file at once."""
    out = []
    for order, (path, shown, number) in enumerate(files):
        with (gzip.open if path.lower().endswith(".gz") else open)(path, "rb") as file:
            text, used = logfiles.decoded(file.read(), FORMATS[number].encoding)
        out += [(order, shown, number, used, i, line) for i, line in enumerate(text.splitlines(), 1)]
    return out


def found(spark, files):
    return sorted(map(tuple, logfiles.lines(spark, files, FORMATS).select("file_order", "file", "format", "encoding", "lineno", "line").collect()))


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes, so that they end within lines and characters."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "211")
    spark.conf.set(names[1], "0")
    spark.conf.set(names[2], "1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_ranges_equal_whole_files(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    parts = ["2025-01-01 error", "é", "日本語", " ", "x" * 30, "\t", "a;b", ""]

    def text(ends, n):
        return "".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(ends) for _ in range(n)) + rng.choice(["", "last", "last\n"])

    one, many = ["\n", "\n", "\r\n"], ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\n\n"]
    made = {
        "a.log": text(one, 40).encode(),
        "b.log": text(many, 40).encode(),
        "bom.log": b"\xef\xbb\xbf" + text(one, 20).encode(),
        "c.log": text(one, 40).replace("é", "").encode("cp932"),
        "d.log": text(one, 20).encode() + b"\xff\xfe bad \x81\n tail",
        "e.log": b"\xff\xfe" + text(one, 40).encode("utf-16-le"),
        "f.log": b"\xfe\xff" + text(many, 40).encode("utf-16-be"),
        # The bytes of a line end across two characters.
        "g.log": b"\xff\xfe" + ("a\u0a58\u0100b\n" * 5).encode("utf-16-le"),
        "h.log.1": text(one, 30).encode(),
        "i.log.gz": gzip.compress(text(one, 30).encode()),
        "j.log.GZ": gzip.compress(text(one, 30).encode()),
        "k.sjis": text(one, 30).replace("é", "").encode("cp932"),
        "l.be": text(many, 30).encode("utf-16-be"),
        "m.jis": text(one, 30).replace("é", "").encode("iso2022_jp"),
        "n.latin": text(one, 30).replace("日本語", "\x85").encode("latin-1"),
        "empty.log": b"",
        "ends.log": b"\n\n",
        "none.log": b"no end",
        "break.log": b"a\nb\x0b",
        "_under.log": text(many, 10).encode(),
        "odd [x] {y} %20 é #1.log": text(one, 10).encode(),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    files = logfiles.listed([str(tmp_path)], FORMATS)
    assert len(files) == len(made)
    assert found(spark, files) == whole(files)
    assert logfiles.lines(spark, [], FORMATS).count() == 0


def test_large_file_is_many_tasks(spark, tmp_path):
    """A file is read by as many tasks as it has ranges, whose lines leave them numbered."""
    (tmp_path / "big.log").write_text("".join(f"2025-01-01 00:00:00 INFO [a] line {i}\n" for i in range(200_000)))
    files = logfiles.listed([str(tmp_path)], FORMATS)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        raw = logfiles._records(spark, [(0, files[0][0], "big.log", 0, "auto")], None)
        assert raw.select("range").distinct().count() == 8
        rows = logfiles.lines(spark, files, FORMATS)
        assert rows.where("line = concat('2025-01-01 00:00:00 INFO [a] line ', lineno - 1)").count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_other_file_systems(spark, tmp_path):
    """Inputs with a scheme are listed and read by the cluster's file systems, by the rules of local ones."""
    (tmp_path / "logs" / "b").mkdir(parents=True)
    (tmp_path / "logs" / ".hidden").mkdir()
    for name in ("logs/z.log", "logs/b/a.log", "logs/a b.log", "logs/x.bak", "logs/.y.log", "logs/.hidden/c.log"):
        (tmp_path / name).write_text(f"{name}\nsecond\n")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    top = "viewfs://logs/in/logs"
    files = logfiles.listed([top, f"{top}/x.bak", f"{top}/z.log"], FORMATS, spark)
    local = logfiles.listed([str(tmp_path / "logs"), str(tmp_path / "logs" / "x.bak")], FORMATS)
    assert [f[1:] for f in files] == [f[1:] for f in local] and [f[1] for f in files] == ["a b.log", "b/a.log", "z.log", "x.bak"]
    assert found(spark, files) == whole(local)
    with pytest.raises(FileNotFoundError):
        logfiles.listed([f"{top}/none"], FORMATS, spark)
    with pytest.raises(ValueError):
        logfiles.listed([top], FORMATS)
