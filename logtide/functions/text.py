"""Text functions on columns: masking, token estimates, clipping, names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked in a message before templates are mined, in this order.
# Java's \d, \w and \s are made to mean what they do for Unicode text by the (?U) flag.
MASKS = (
    (r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+", "URL"),
    (r"(?<![A-Za-z0-9_])[A-Za-z]:\\[^\s\"'<>]*", "PATH"),
    (r"\\\\[^\s\"'<>]+", "PATH"),
    (r"(?<![\w.])/(?:[\w.-]+/)+[\w.-]*", "PATH"),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?(?![\d.])", "IP"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"\bJ-\d+\b", "JOBID"),
    (r"\b0x[0-9a-fA-F]+\b", "HEX"),
    (r"(?<![A-Za-z0-9_<])[A-Za-z]:(?=\s|$)", "DRIVE"),
    (r"(?<![A-Za-z0-9_<])[-+]?\d+(?:\.\d+)?(?![A-Za-z0-9_])", "NUM"),
)

#: The masks whose expressions have no lookaround, which other engines can run as well.
SIMPLE_MASKS = tuple(m for m in MASKS if "(?<" not in m[0] and "(?=" not in m[0] and "(?!" not in m[0])

#: A character without which none of MASKS matches; looking for it costs a small part of trying them all.
MASKABLE = r"[\d:/\\-]"

_PLACEHOLDER = re.compile(r"<[^<>\s]*>")


def masked(message: Column, masks: Iterable[tuple[str, str]] = MASKS) -> Column:
    """The message with variable parts replaced by ``<NAME>``, mask by mask."""
    masks, out = list(masks), message
    for pattern, name in masks:
        out = F.regexp_replace(out, "(?U)" + pattern, f"<{name}>")
    return F.when(message.rlike("(?U)" + MASKABLE), out).otherwise(message) if set(masks) <= set(MASKS) else out


def estimated_tokens(text: Column) -> Column:
    """ceil(ASCII characters / 3.5 + other characters)."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_chars.cast("double") / F.lit(3.5) + (F.length(text) - ascii_chars)).cast("long")


def clipped(text: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis being the last of a cut text; tabs become two spaces."""
    spaced = F.replace(text, F.lit("\t"), F.lit("  "))
    return F.when(F.length(spaced) <= most, spaced).otherwise(F.concat(F.substring(spaced, 1, max(0, most - 1)), F.lit("…")))


def file_alias(name: Column) -> Column:
    """A log file's short name: without .gz, a rotation number and .log or .txt; the name itself if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"\.\d+$", ""), r"(?i)\.(log|txt)$", "")
    return F.when(base == "", name).otherwise(base)


def line_id(file: Column, lineno: Column) -> Column:
    return F.concat_ws(":", file, lineno.cast("string"))


def pattern_regex(template: str) -> str:
    """A rule's template as an expression for the whole text: ``<…>`` stands for anything, a run of spaces for white space."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts += [_literal(template[at : m.start()]), ".*?"]
        at = m.end()
    parts.append(_literal(template[at:]))
    return r"(?s)^\s*" + "".join(parts) + r"\s*$"


def _literal(text: str) -> str:
    return r"\s+".join(re.escape(part) for part in re.split(" +", text))


def longest_literal(template: Column) -> Column:
    """The longest fixed piece of a template without punctuation at its ends; the first of equals."""
    pieces = F.transform(F.split(template, r"<[^<>\s]*>"), lambda p: F.regexp_replace(p, r"^[ :=,()\[\]'\"]+|[ :=,()\[\]'\"]+$", ""))
    return F.aggregate(pieces, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
