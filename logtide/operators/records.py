"""Log records: levels, stack traces, triggers and windows of time.

A table of records has ts (naive), file, lineno, level, severity, component, message and
template; records parsed from files also have extra (lines that continue the first).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.times import ntz

# Levels by severity, and other spellings of them.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LEVEL_ALIASES = {
    "WARNING": "WARN",
    "WRN": "WARN",
    "W": "WARN",
    "ERR": "ERROR",
    "E": "ERROR",
    "SEVERE": "ERROR",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
    "FTL": "FATAL",
    "INF": "INFO",
    "I": "INFO",
    "NOTICE": "INFO",
    "DBG": "DEBUG",
    "D": "DEBUG",
    "FINE": "DEBUG",
    "FINER": "TRACE",
    "FINEST": "TRACE",
    "TRC": "TRACE",
}
WARN, ERROR = LEVELS.index("WARN"), LEVELS.index("ERROR")

# How lines of stack traces begin (Java, .NET, Python).
STACK_LINE = (
    r"(?U)^(?:\s+at\s+\S|\s*Caused by:|Traceback \(most recent call last\)|\s+File \"|\s*\.\.\. \d+ more|\s*---> |[\w.$]+(?:Exception|Error)\b)"
)
#: Continuation lines that are searched for a stack trace.
STACK_LINES_READ = 20


def normal_level(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """The level of a spelling, or null."""
    table = {level: level for level in LEVELS} | (LEVEL_ALIASES if aliases is None else aliases)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = known[F.upper(raw)]
    return F.when(found.isin(*LEVELS), found)


def severity_of(level: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1).cast("int")


def has_stack(extra: Column) -> Column:
    return F.coalesce(F.exists(F.slice(extra, 1, STACK_LINES_READ), lambda line: line.rlike(STACK_LINE)), F.lit(False))


def is_trigger(records: DataFrame) -> Column:
    """Errors, and records with a stack trace."""
    severe = F.col("severity") >= ERROR
    return severe | has_stack(F.col("extra")) if "extra" in records.columns else severe


def in_window(records: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Records from ``start`` to ``end``, both included."""
    return records.where(F.col("ts").between(ntz(start), ntz(end)))


def level_histogram(records: DataFrame, raw: str = "raw_level") -> DataFrame:
    """Spellings per file that are no known level."""
    return records.where(normal_level(F.col(raw)).isNull()).groupBy("file", raw).agg(F.count("*").alias("n"))
