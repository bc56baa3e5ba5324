"""Lines to records: head lines by regular expressions, timestamps, and the lines that continue a record."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.regex import TimeFormat, java_regex
from logtide.functions.text import file_alias
from logtide.functions.times import zone_name
from logtide.operators.ordering import running, written
from logtide.operators.records import LEVEL_ALIASES, normal_level, severity_of

#: Continuation lines that a record keeps; more are counted.
MOST_EXTRA = 300

# Forms of head lines and of timestamps.
_STAMP = r"\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
PATTERNS = (
    rf"^(?P<ts>{_STAMP})\s+(?P<level>[A-Za-z]+)\s+\[(?P<component>[^\]]*)\]\s?(?P<message>.*)$",
    rf"^(?P<ts>{_STAMP})\s+(?P<level>[A-Za-z]+)\s+(?P<message>.*)$",
)
_PARTS = r"^(\d{4})[-/](\d{2})[-/](\d{2})[ T](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}))?\s*(Z|[+-]\d{2}:?\d{2})?$"


@dataclass(frozen=True)
class LogFormat:
    """How files of some names are read.  Patterns name ts, level and message, and may name component."""

    name: str = "default"
    files: tuple[str, ...] = ("*.log", "*.log.*", "*.txt")
    patterns: tuple[str, ...] = PATTERNS
    ts_format: str | None = None
    timezone: str = "+09:00"
    encoding: str = "auto"
    clock_offset_seconds: float = 0.0
    #: Spellings of levels and what they mean, over the usual ones.
    level_aliases: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if not self.patterns:
            raise ValueError(f"format {self.name!r} has no patterns")
        object.__setattr__(self, "timezone", zone_name(self.timezone))
        if self.ts_format and "%" in self.ts_format:
            TimeFormat(self.ts_format)
        for p in self.patterns:
            java_regex(p)
            if missing := {"ts", "level", "message"} - set(re.compile(p).groupindex):
                raise ValueError(f"a pattern of format {self.name!r} lacks {sorted(missing)}")

    def takes(self, name: str) -> bool:
        return any(fnmatchcase(name.lower(), glob.lower()) for glob in self.files)


def _stripped(text: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def _is_blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def head(line: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """Struct of ts, level, component and message of a head line by the first pattern that fits; null for other lines."""
    found = None
    for pattern in patterns:
        groups = re.compile(pattern).groupindex
        java = java_regex(pattern)

        def part(name: str, groups=groups, java=java) -> Column:
            return F.regexp_extract(line, java, groups[name]) if name in groups else F.lit("")

        fields = F.struct(part("ts").alias("ts"), part("level").alias("level"), F.regexp_replace(_stripped(part("component")), r"(?U)^\s+", "").alias("component"), _stripped(part("message")).alias("message"))
        hit = line.rlike(java)
        found = F.when(hit, fields) if found is None else found.when(hit, fields)
    return found


def timestamp(stamp: Column, zone: str, out_zone: str, offset_seconds: float = 0.0, form: str | None = None) -> Column:
    """A naive timestamp in ``out_zone``, clock corrected; null where the text is none.

    A zone in the text goes before ``zone``.  Fractions are cut to microseconds.  ``form``, in
    place of the ISO-like forms: a format of ``strptime``'s directives, or a Spark datetime
    pattern where it has no per cent sign.
    """
    text = F.trim(stamp)
    if form and "%" in form:
        own = TimeFormat(form)
        naive, source = own.naive(text), own.zone(text, zone)
    elif form:
        naive, source = F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz"), F.lit(zone)
    else:

        def part(i: int) -> Column:
            return F.regexp_extract(text, _PARTS, i)

        fraction = F.rpad(F.substring(part(5), 1, 6), 6, "0")
        joined = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit("."), fraction)
        naive = F.when(text.rlike(_PARTS), joined.try_cast("timestamp_ntz"))
        named = part(6)
        source = F.when(named == "", zone).when(named == "Z", "UTC").when(F.length(named) == 5, F.concat(F.substring(named, 1, 3), F.lit(":"), F.substring(named, 4, 2))).otherwise(named)
    moved = F.convert_timezone(source, F.lit(out_zone), naive)
    return moved + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(offset_seconds).cast("decimal(18,6)")) if offset_seconds else moved


def attached(lines: DataFrame, most: int = MOST_EXTRA) -> DataFrame:
    """One row per head line with ``extra`` (its continuation lines, at most ``most``) and ``extra_dropped``.

    ``lines``: file, lineno, line, is_head and columns of heads.  The last head is carried
    forward as a running maximum over parts, so that a file of any size spreads over tasks;
    only lines that are kept are gathered, and each task passes on at most ``most`` of a head
    before the shuffle.  Blank lines are skipped; lines before any head
    belong to none.
    """
    own = lines.withColumn("_head", F.when(F.col("is_head"), F.col("lineno")))
    # Written by running(): the lines are used twice below.
    carried = running(own, ["file", "lineno"], "_head", "lines", ["file"], F.max).drop("part", "at", "_head")
    heads = carried.where("is_head").drop("running", "line", "is_head")
    follow = carried.where(~F.col("is_head") & F.col("running").isNotNull() & ~_is_blank(F.col("line")))
    follow = follow.select(F.col("file").alias("_file"), F.col("running").alias("_lineno"), F.col("lineno").alias("_at"), "line")
    first = Window.partitionBy("_file", "_lineno").orderBy("_at")
    kept = follow.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    gathered = kept.groupBy("_file", "_lineno").agg(F.array_sort(F.collect_list(F.struct("_at", _stripped(F.col("line")).alias("line")))).alias("_kept"))
    counts = follow.groupBy("_file", "_lineno").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("_dropped"))
    own_lines = (F.col("file") == F.col("_file")) & (F.col("lineno") == F.col("_lineno"))
    joined = heads.join(gathered.join(counts, ["_file", "_lineno"]), own_lines, "left")
    extra = F.coalesce(F.transform("_kept", lambda s: s["line"]), F.array().cast("array<string>"))
    return joined.withColumn("extra", extra).withColumn("extra_dropped", F.coalesce("_dropped", F.lit(0))).drop("_file", "_lineno", "_kept", "_dropped")


def parsed(lines: DataFrame, formats: list[LogFormat], out_zone: str = "+09:00", offsets: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, files) from lines (file_order, file, format, encoding, lineno, line).

    Records: file, file_order, alias, lineno, ts, level, severity, component, message, extra,
    extra_dropped.  Files: counts of lines, records, continuation and unparsed lines and bad
    timestamps, first and last ts, the clock's offset in seconds, and how often each unknown
    level occurs.  ``offsets``: seconds by alias, before those of formats.
    """
    offsets = offsets or {}
    heads = F.lit(None).cast("struct<ts:string,level:string,component:string,message:string>")
    ts = F.lit(None).cast("timestamp_ntz")
    lines = lines.withColumn("alias", file_alias(F.element_at(F.split("file", "/"), -1)))
    for i, form in enumerate(formats):
        heads = F.when(F.col("format") == i, head(F.col("line"), form.patterns)).otherwise(heads)
    found = lines.withColumn("_h", heads)
    for i, form in enumerate(formats):
        own = timestamp(F.col("_h.ts"), form.timezone, out_zone, form.clock_offset_seconds, form.ts_format)
        for alias, seconds in offsets.items():
            own = F.when(F.col("alias") == alias, timestamp(F.col("_h.ts"), form.timezone, out_zone, seconds, form.ts_format)).otherwise(own)
        ts = F.when(F.col("format") == i, own).otherwise(ts)
    level = F.lit(None).cast("string")
    for i, form in enumerate(formats):
        level = F.when(F.col("format") == i, normal_level(F.col("_h.level"), LEVEL_ALIASES | dict(form.level_aliases))).otherwise(level)
    # A head line whose time can't be read is no head, and no later pattern is tried.
    found = found.withColumn("ts", ts).withColumn("is_head", F.col("_h").isNotNull() & F.col("ts").isNotNull()).withColumn("bad_timestamp", F.col("_h").isNotNull() & F.col("ts").isNull())
    found = found.withColumn("level", F.when(F.col("is_head"), F.coalesce(level, F.lit("INFO")))).withColumn("raw_level", F.when(F.col("is_head") & level.isNull(), F.col("_h.level")))
    found = found.withColumn("component", F.col("_h.component")).withColumn("message", F.col("_h.message")).withColumn("severity", severity_of(F.col("level"))).drop("_h")
    found = written(found, "parsed-lines")
    records = attached(found.select("file", "file_order", "alias", "lineno", "line", "is_head", "ts", "level", "severity", "component", "message"))
    first_head = found.where("is_head").groupBy("file").agg(F.min("lineno").alias("_first"))
    # One row a file: Spark sends it to all tasks while it is small, and splits hot files if it isn't.
    placed = found.join(first_head, "file", "left")
    follows = ~F.col("is_head") & ~_is_blank(F.col("line"))
    before_any = F.col("_first").isNull() | (F.col("lineno") < F.col("_first"))
    files = placed.groupBy("file_order", "file", "alias", "format", "encoding").agg(
        F.count("*").alias("total_lines"),
        F.count(F.when(F.col("is_head"), 1)).alias("records"),
        F.count(F.when(follows & ~before_any, 1)).alias("continuation_lines"),
        F.count(F.when(follows & before_any, 1)).alias("unparsed_lines"),
        F.count(F.when(F.col("bad_timestamp"), 1)).alias("bad_timestamps"),
        F.min(F.when(F.col("is_head"), F.col("ts"))).alias("first_ts"),
        F.max(F.when(F.col("is_head"), F.col("ts"))).alias("last_ts"),
    )
    # Counted before they are gathered, so that a task sends a level of a file once.
    levels = found.where("raw_level IS NOT NULL").groupBy("file", "raw_level").agg(F.count("*").alias("_n"))
    levels = levels.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw_level", "_n")))).alias("unknown_levels"))
    offset = F.lit(0.0)
    for i, form in enumerate(formats):
        offset = F.when(F.col("format") == i, form.clock_offset_seconds).otherwise(offset)
    for alias, seconds in offsets.items():
        offset = F.when(F.col("alias") == alias, float(seconds)).otherwise(offset)
    return records, files.withColumn("clock_offset_seconds", offset).join(levels, "file", "left")
