"""Raw log files as lines: listing, bytes, gzip, character sets.

Files are in any file system that Spark reads.  Spark cuts them into ranges of bytes and finds
the line ends across their borders; gzip files are streamed.  A first pass keeps each line's
bytes and counts those that are no UTF-8 or CP932, which settles the character set of files that
name none; then lines are decoded, and numbered from the counts of the ranges before theirs.
So no task holds more than some lines, however large a file is.
"""

from __future__ import annotations

import codecs
import gzip
import re
import string
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.operators.ordering import running_sum, written
from logtide.operators.parse import LogFormat
from logtide.operators.shipping import ship

SCHEMA = "file_order int, file string, format int, encoding string, lineno long, line string"
#: Lines in an Arrow batch.
BATCH_LINES = 20_000
#: Ranges of files up to which their table is broadcast.
BROADCAST_RANGES = 100_000
#: A path with a scheme is listed by the cluster's file system.
_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")


def listed(inputs: Sequence[str], formats: Sequence[LogFormat], spark: SparkSession | None = None) -> list[tuple[str, str, int]]:
    """(path, shown name, format) of files in the order in which they were named.

    Folders are walked in order; hidden parts and names that no format takes are left out.  A
    file that is named itself is read by the first format if none takes it.  Inputs with a
    scheme (``hdfs://…``) are listed by ``spark``'s file systems, by the same rules.
    """
    found: dict[str, tuple[str, str, int]] = {}

    def form(name: str) -> int | None:
        return next((i for i, f in enumerate(formats) if f.takes(name)), None)

    for given in inputs:
        folder, files = _listed_by(spark, given) if _URI.match(given) else _listed_here(given)
        for path, shown in files:
            name = shown.rpartition("/")[2]
            number = form(name) if folder else form(name) or 0
            if number is not None and not (folder and any(part.startswith(".") for part in shown.split("/"))):
                found.setdefault(path, (path, shown, number))
    return list(found.values())


def _listed_here(given: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether it is a folder, and (path, name from there) of its files in order."""
    at = Path(given)
    if at.is_file():
        return False, [(str(at.resolve()), at.name)]
    if not at.is_dir():
        raise FileNotFoundError(f"no such log: {given}")
    return True, [(str(path.resolve()), path.relative_to(at).as_posix()) for path in sorted(p for p in at.rglob("*") if p.is_file())]


def _listed_by(spark: SparkSession | None, given: str) -> tuple[bool, list[tuple[str, str]]]:
    if spark is None:
        raise ValueError(f"a Spark session is needed to list {given}")
    at = spark._jvm.org.apache.hadoop.fs.Path(given)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(at):
        raise FileNotFoundError(f"no such log: {given}")
    # As the file system writes it, with its authority.
    top = system.getFileStatus(at).getPath()
    if system.getFileStatus(at).isFile():
        return False, [(top.toString(), at.getName())]
    files, walk = [], system.listFiles(at, True)
    while walk.hasNext():
        path = walk.next().getPath()
        files.append((path.toString(), top.toUri().relativize(path.toUri()).getPath()))
    return True, sorted(files, key=lambda f: f[1].split("/"))


def decoded(data: bytes, encoding: str) -> tuple[str, str]:
    """Text and the character set used; ``auto``: UTF-16 by its mark, then UTF-8, then CP932, then UTF-8 with replacement."""
    if encoding != "auto":
        return data.decode(encoding, "replace"), encoding
    if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return data.decode("utf-16", "replace"), "utf-16"
    for codec, name in (("utf-8-sig", "utf-8"), ("cp932", "cp932")):
        try:
            return data.decode(codec), name
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace"), "utf-8 (replaced)"


def lines(spark: SparkSession, files: Sequence[tuple[str, str, int]], formats: Sequence[LogFormat]) -> DataFrame:
    """All lines of the listed files, numbered from 1 as Python splits them.

    Ranges of files are read by as many tasks as they fill.  Only these are read whole, by a
    task each: files whose names Spark's readers pass over (``_x.log``), or with gzip's ending in
    capitals; of character sets that aren't ASCII's up to 0x7F; and UTF-16 with the bytes of a
    line end across two characters.  In a gzip file whose last line ends in a line break of another
    kind than ``\\n``, that break ends in an empty line.
    """
    if not files:
        return spark.createDataFrame([], SCHEMA)
    ship(spark)
    about = [(order, path, shown, number, formats[number].encoding) for order, (path, shown, number) in enumerate(files)]
    whole = {a[0] for a in about if _is_passed_over(a[1]) or not (a[4] == "auto" or _is_like_ascii(a[4]) or _utf16(a[4]))}
    wide = {a[0]: _utf16(a[4]) for a in about if a[0] not in whole and _utf16(a[4])}
    found: list[DataFrame] = []
    bytewise = [a for a in about if a[0] not in whole and a[0] not in wide]
    if bytewise:
        raw = _records(spark, bytewise, None)
        sets = _character_sets(raw, {a[0]: a[4] for a in bytewise})
        wide |= {order: used for order, (used, _) in sets.items() if used in _WIDE}
        found.append(_numbered(_decoded_lines(spark, raw, [a for a in bytewise if a[0] not in wide], sets)))
    for used in sorted(set(wide.values())):
        own = [a for a in about if wide.get(a[0]) == used]
        raw = _records(spark, own, used)
        # A line end at an odd place isn't one; records are cut by even numbers of bytes unless there is such.
        odd = {r.file_order for r in raw.where(F.octet_length("bytes") % 2 == 1).select("file_order").distinct().collect()}
        whole |= odd
        own = [a for a in own if a[0] not in odd]
        if own:
            found.append(_numbered(_decoded_lines(spark, raw, own, {a[0]: (used, "utf-16" if a[4] == "auto" else a[4]) for a in own})))
    if whole:
        found.append(_whole_files(spark, [a for a in about if a[0] in whole]))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: Character sets of two bytes whose line ends are found by their bytes: Python's name, and Java's.
_WIDE = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def _is_passed_over(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.startswith(("_", ".")) or name.lower().endswith(".gz") and not name.endswith(".gz")


def _is_like_ascii(encoding: str) -> bool:
    """Whether ASCII's characters are their own bytes in it, and no line's bytes say how the next is read."""
    name = codecs.lookup(encoding).name
    if name.startswith(("iso2022", "utf-7", "hz")):
        return False
    # All 128 at once, since some sets only tell by what follows.
    every = string.printable + "\x00"
    return every.encode(encoding, "replace") == every.encode("ascii") or name == "utf-8-sig"


def _utf16(encoding: str) -> str | None:
    name = codecs.lookup(encoding).name if encoding != "auto" else ""
    return name if name in _WIDE else None


def _records(spark: SparkSession, about: list[tuple], wide: str | None) -> DataFrame:
    """(file_order, size, range, at, bytes) of the files' lines without their ends, a written table; ``at`` ascends within a range."""
    reader = spark.read.option("lineSep", "\n")
    if wide:
        reader = reader.option("encoding", _WIDE[wide])
    paths = [path if _URI.match(path) else f"file://{path}" for _, path, *_ in about]
    text = reader.text([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    # As Spark names them: escaped, and with as many slashes as its file system writes.
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    names = [(order, path_of(p).toUri().toString()) for (order, *_), p in zip(about, paths, strict=True)]
    orders = spark.createDataFrame([(o, _bare(n)) for o, n in names], "file_order int, _name string")
    m = "_metadata"
    own = text.select(F.regexp_replace(F.col(f"{m}.file_path"), r"^(\w+):/+", "$1:/").alias("_name"), F.col(f"{m}.file_size").alias("size"), F.col(f"{m}.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))
    # The files were listed by the driver: a row each.
    return written(own.join(F.broadcast(orders), "_name").drop("_name"), "log-records")


def _bare(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def _character_sets(raw: DataFrame, named: dict[int, str]) -> dict[int, tuple[str, str]]:
    """(Python's character set, name that is shown) by file; from a mark, or from how many lines are no UTF-8, and no CP932."""
    out = {order: (encoding, encoding) for order, encoding in named.items() if encoding != "auto"}
    open_ = raw.where(F.col("file_order").isin([o for o in named if o not in out])) if len(out) < len(named) else raw.where("false")
    # Two numbers a file: the driver has listed the files.
    counts = open_.groupBy("file_order").agg(F.min_by(F.substring("bytes", 1, 2), F.struct("range", "at")).alias("mark"), F.count_if(~F.is_valid_utf8(F.col("bytes").cast("string"))).alias("odd"))
    doubtful = []
    for row in counts.collect():
        mark = bytes(row.mark)
        if mark in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            out[row.file_order] = ("utf-16-le" if mark == codecs.BOM_UTF16_LE else "utf-16-be", "utf-16")
        elif row.odd:
            doubtful.append(row.file_order)
        else:
            out[row.file_order] = ("utf-8-sig", "utf-8")
    if doubtful:

        def failing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = []
                for order, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        data.decode("cp932")
                    except UnicodeDecodeError:
                        bad.append(order)
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int32())], names=["file_order"])

        lines_of = open_.where(F.col("file_order").isin(doubtful)).select("file_order", "bytes")
        neither = {r.file_order for r in lines_of.mapInArrow(failing, "file_order int").distinct().collect()}
        out |= {order: ("utf-8", "utf-8 (replaced)") if order in neither else ("cp932", "cp932") for order in doubtful}
    # Files without a line.
    return {order: ("utf-8", "utf-8") for order in named} | out


def _decoded_lines(spark: SparkSession, raw: DataFrame, about: list[tuple], sets: dict[int, tuple[str, str]]) -> DataFrame:
    """SCHEMA's columns but lineno, with ``_record`` (place of the line's record in its file, from 0) and ``_sub`` (place of the line in its record)."""
    one = _WIDE.get(next((sets[a[0]][0] for a in about), ""), None)
    end = 2 if one else 1
    rows = [(order, shown, number, *sets[order], path.endswith(".gz")) for order, path, shown, number, _ in about]
    names = spark.createDataFrame(rows, "file_order int, file string, format int, _set string, encoding string, _packed boolean")
    raw = raw.where(F.col("file_order").isin([r[0] for r in rows])) if rows else raw.where("false")
    ranges = raw.groupBy("file_order", "range").agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.count("*").alias("_n"), F.sum(F.octet_length("bytes") + end).alias("_bytes"), F.max("size").alias("_size"))
    of_file = Window.partitionBy("file_order")
    before = F.sum("_n").over(of_file.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file_order", "range", "_first", "_last", F.coalesce(before, F.lit(0)).alias("_before"), (F.max("range").over(of_file) == F.col("range")).alias("_final"), (F.sum("_bytes").over(of_file) > F.col("_size")).alias("_open"))
    ranges = written(ranges.join(F.broadcast(names), "file_order"), "log-ranges")
    # A row for each range of a file.
    joined = raw.join(F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges.hint("merge"), ["file_order", "range"])
    # Whether it is the first of its file, and the last of one that ends without a line end.
    record = (F.col("_before") + F.col("at") - F.col("_first")).alias("_record")
    last = (F.col("_final") & (F.col("at") == F.col("_last")) & F.col("_open") & ~F.col("_packed")).alias("_is_last")
    sent = joined.select("file_order", "file", "format", "encoding", record, "_set", last, "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_LINES):
                part = batch.slice(at, BATCH_LINES)
                of, text, sub = [], [], []
                for i, (number, name, is_last, data) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4, 8)), strict=True)):
                    found = _split(data, name, number == 0, is_last)
                    of += [i] * len(found)
                    text += found
                    sub += range(len(found))
                taken = part.select(["file_order", "file", "format", "encoding", "_record"]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(sub, pa.int32()), pa.array(text, pa.string())], names=[*taken.schema.names, "_sub", "line"])

    return sent.mapInArrow(run, "file_order int, file string, format int, encoding string, _record long, _sub int, line string")


def _split(data: bytes, encoding: str, is_first: bool, is_last: bool) -> list[str]:
    """Lines of a record, which holds no \\n but may hold line breaks of other kinds; a mark at the file's beginning goes."""
    if encoding in _WIDE:
        text = data.decode(encoding, "replace")
        text = text[1:] if is_first and text[:1] == "\ufeff" else text
    else:
        text = data.decode("utf-8" if encoding == "utf-8-sig" and not is_first else encoding, "replace")
    return (text if is_last else text + "\n").splitlines()


def _numbered(decoded_lines: DataFrame) -> DataFrame:
    """Lines with lineno.  A record is a line, but where others than \\n break it; files with such breaks are counted line by line."""
    table = written(decoded_lines, "log-lines")
    columns = ["file_order", "file", "format", "encoding", "lineno", "line"]
    # Of the listed files, those.
    broken = [r.file_order for r in table.where("_sub > 0").select("file_order").distinct().collect()]
    plain = table.where(~F.col("file_order").isin(broken)) if broken else table
    plain = plain.withColumn("lineno", F.col("_record") + 1).select(columns)
    if not broken:
        return plain
    counted = running_sum(table.where(F.col("file_order").isin(broken)).withColumn("_one", F.lit(1).cast("long")), ["file_order", "_record", "_sub"], "_one", "log-broken", ["file_order"])
    return plain.unionByName(counted.withColumn("lineno", F.col("running")).select(columns))


def _whole_files(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """Lines of files that are read whole: a file is one task; its lines leave it in batches."""
    about = {_bare(path if _URI.match(path) else f"file:{path}"): (order, shown, number, encoding) for order, path, shown, number, encoding in files}
    read = _contents(spark, [path for _, path, *_ in files])
    # Each file to a task of its own, as far as there are tasks.
    dealt = read.repartition(min(len(about), 10_000), "path") if len(about) > 1 else read

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order, shown, number, encoding = about[_bare(path if _URI.match(path) else f"file:{path}")]
                text, used = decoded(gzip.decompress(content) if path.lower().endswith(".gz") else content, encoding)
                all_lines = text.splitlines()
                for at in range(0, len(all_lines), BATCH_LINES):
                    part = all_lines[at : at + BATCH_LINES]
                    n = len(part)
                    columns = [
                        pa.array([order] * n, pa.int32()),
                        pa.array([shown] * n, pa.string()),
                        pa.array([number] * n, pa.int32()),
                        pa.array([used] * n, pa.string()),
                        pa.array(range(at + 1, at + n + 1), pa.int64()),
                        pa.array(part, pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["file_order", "file", "format", "encoding", "lineno", "line"])

    return dealt.mapInArrow(split, SCHEMA)


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of files.  Spark's reader takes names that begin with _ for its own; tasks open those themselves, from the folders that were listed."""
    schema = "path string, content binary"
    hidden = [p for p in paths if Path(p).name.startswith(("_", ".")) and not _URI.match(p)]
    shown = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths if p not in set(hidden)]
    read = spark.read.format("binaryFile").load([p if _URI.match(p) else f"file://{p}" for p in shown]).select("path", "content") if shown else spark.createDataFrame([], schema)
    if not hidden:
        return read

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([Path(path).read_bytes()], pa.binary())], names=["path", "content"])

    return read.unionByName(spark.createDataFrame([(p,) for p in hidden], "path string").mapInArrow(opened, schema))


def with_empty(files: DataFrame, listed_files: Sequence[tuple[str, str, int]]) -> DataFrame:
    """File statistics with a row for each listed file, also for those without a line."""
    every = files.sparkSession.createDataFrame([(order, shown, number) for order, (_, shown, number) in enumerate(listed_files)], "file_order int, file string, format int")
    counts = ["total_lines", "records", "continuation_lines", "unparsed_lines", "bad_timestamps"]
    return every.join(files.drop("file", "format"), "file_order", "left").fillna(0, counts).fillna("", ["encoding"]).fillna(0.0, ["clock_offset_seconds"]).orderBy(F.col("file_order"))
