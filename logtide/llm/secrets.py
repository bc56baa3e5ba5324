"""Secret scans by a trigram inverted index.

From each rule's regular expression follows a Boolean query: the rule can match a text only
if, for one of its alternatives, the text holds all the alternative's trigrams.  The index
holds every trigram of every text (letters folded to lower case) with its postings, packed
as bits of 64 neighbouring rows, and is kept in a folder of its own: rows are added to it, and
rules that come later are asked of it, without reading the texts that it has.  Postings are
intersected and only candidates are verified by the expression.  A rule with an alternative
without trigrams scans all texts.

Long texts are cut into overlapping pieces first, so that nothing of a row for each character
is ever held for a whole text.

All of it is DataFrame functions.  Null texts count as empty.  Ids may be null or repeat, and
may be of any type: such rows are told apart by their place in the order of id and text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import numbered, text_or_empty, written

#: A character class of up to so many members is spelt out in trigram queries.
SMALL_CLASS = 6
#: Alternatives beyond which a rule's query isn't spelt out any further.
MOST_ALTERNATIVES = 64
#: Characters of a piece of a long text; trigrams are listed a piece at a time.
PIECE = 4096
#: Candidates (an id and a few numbers) up to which they are broadcast to the texts; more are joined by shuffle.
BROADCAST_CANDIDATES = 500_000
#: Numbers of an array that are summed up in one go.
SUM_CHUNK = 512


@dataclass(frozen=True)
class Rule:
    """``group`` of a match of ``pattern`` must have ``least`` characters; the span is the whole match.

    Patterns are in the part of the syntax that Java and Python share.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    # What follows adds spans to those of the three above.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

_GAP = None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, in lower case, one of which every match holds in full; None if there is no such query."""
    rows = [_trigrams(x) for x in _literals(re._parser.parse(pattern))]
    return None if not rows or not all(rows) else rows


def _trigrams(sequence: tuple) -> frozenset[str]:
    runs, run = [], ""
    for c in (*sequence, _GAP):
        if c is _GAP:
            runs.append(run.lower())
            run = ""
        else:
            run += c
    return frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))


def _literals(nodes) -> list[tuple]:
    """Alternatives for the characters of a match; a gap stands for what isn't known."""
    out: list[tuple] = [()]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            own = [(chr(arg),)]
        elif name == "IN":
            own = _class(arg)
        elif name == "SUBPATTERN":
            own = _literals(arg[-1])
        elif name == "BRANCH":
            own = [x for branch in arg[1] for x in _literals(branch)]
        elif name == "AT":
            own = [()]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[:2] == (0, 1):
            own = [(), *_literals(arg[2])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            own = [(*x, _GAP) for x in _literals(arg[2])]
        else:
            own = [(_GAP,)]
        if len(out) * len(own) > MOST_ALTERNATIVES:
            own = [(_GAP,)]
        out = [a + b for a, b in product(out, own)]
    return out


def _class(members) -> list[tuple]:
    if all(str(op) == "LITERAL" for op, _ in members) and len(members) <= SMALL_CLASS:
        return [(chr(c),) for _, c in members]
    return [(_GAP,)]


def pieces(text: Column) -> Column:
    """The text in pieces of up to PIECE characters, each with the two characters that follow it, so that no trigram is lost."""
    cut = F.lit(f"(?s)(.{{1,{PIECE}}})(?=(.{{0,2}}))")
    long = F.zip_with(F.regexp_extract_all(text, cut, F.lit(1)), F.regexp_extract_all(text, cut, F.lit(2)), lambda own, next_: F.concat(own, next_))
    return F.when(F.length(text) > PIECE, long).otherwise(F.array(text))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in lower case.

    A match that looks ahead is empty, so that the next one begins one character further, or
    half of one beyond 16 bits: none begins with such a half.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1)))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, block, bits) of all trigrams: bit b of ``bits`` is the row of key 64 * block + b.

    Keys must be integers, unique and without nulls.  Tasks merge the rows of a block before
    the one shuffle, so a trigram that is in every text is one row for 64 texts, and no trigram
    is more than a 64th of all rows.
    """
    row = F.col(f"`{key}`").cast("long")
    cut = docs.select(row.alias("_row"), F.explode(pieces(text_or_empty(text))).alias("_piece"))
    held = cut.select(F.explode(trigrams(F.col("_piece"))).alias("trigram"), F.shiftright("_row", 6).alias("block"), F.col("_row").bitwiseAND(63).cast("int").alias("_at"))
    return held.groupBy("trigram", "block").agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("bits"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The inverted index of all trigrams of ``docs``, a written table.

    ``path``: a folder that keeps it, for ``open_index`` and ``add_rows``; else it is a table
    of the session's shared folder.
    """
    # Files are sorted, so that a query reads few of their pages.
    packed = postings(docs, key, text).sortWithinPartitions("trigram", "block")
    if path is None:
        return written(packed, "secret-index")
    packed.write.parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trigram string, block long, bits long").parquet(path)


def add_rows(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``path`` with further rows; their keys may fall into blocks that it has."""
    postings(docs, key, text).sortWithinPartitions("trigram", "block").write.mode("append").parquet(path)
    return open_index(docs.sparkSession, path)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, rules): the texts that rules must be verified on, with the rules' places in ascending order; full scans aren't in it."""
    terms = [(t, at, n) for at, rule in enumerate(rules) for n, alternative in enumerate(trigram_query(rule.pattern) or []) for t in sorted(alternative)]
    spark = index.sparkSession
    # The terms come from the rules alone.
    asked = spark.createDataFrame(terms, "trigram string, rule int, alternative int")
    sizes = asked.groupBy("rule", "alternative").agg(F.count("*").alias("all"))
    # Rows that were added later may be in a block that was there.
    own = index.where(F.col("trigram").isin(*sorted({t for t, _, _ in terms}))).groupBy("trigram", "block").agg(F.bit_or("bits").alias("bits"))
    met = own.join(F.broadcast(asked), "trigram")
    # Each trigram has one row a block now, so postings meet where there are as many rows as terms.
    alike = met.groupBy("block", "rule", "alternative").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).join(F.broadcast(sizes), ["rule", "alternative"]).where("n = all AND bits <> 0")
    of_rule = alike.groupBy("block", "rule").agg(F.bit_or("bits").alias("bits"))
    rows = of_rule.select("block", "rule", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_at")).where(F.expr("getbit(bits, _at) = 1"))
    # A row has as many rules at most as were asked.
    return rows.select((F.col("block") * 64 + F.col("_at")).alias("row"), "rule").groupBy("row").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running_sums(steps: Column, chunk: int = SUM_CHUNK) -> Column:
    """The sums of an array's first 1, 2, … numbers.

    Appending to an array copies it, so sums run within chunks and from chunk to chunk, and
    no array that grows is longer than a chunk or the number of chunks.
    """
    zero = F.array(F.lit(0))

    def run(numbers: Column, start: Column) -> Column:
        """``start`` and the sums that follow it."""
        return F.aggregate(numbers, start, lambda sums, v: F.array_append(sums, F.element_at(sums, -1) + v))

    def chunked(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / chunk).cast("int")), lambda k: F.slice(a, k * chunk + 1, F.lit(chunk)))

    def summed(chunks: Column) -> Column:
        starts = run(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)), zero)
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, start: F.slice(run(c, F.array(start)), F.lit(2), F.lit(chunk))))

    return _let(steps, lambda a: _let(chunked(a), summed))


def matches(text: Column, rule: Rule, at: int) -> Column:
    """Spans (start, kind, end) of the rule's matches in code points; matches that are too short are dropped, not retried."""
    tight = _tight(rule)
    pattern = F.lit(tight)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # Matches aren't empty, so the text is a part before each match and one after the last.
    parsed = F.struct(F.transform(F.split(text, tight, -1), F.length).alias("gaps"), F.transform(whole, F.length).alias("sizes"), F.transform(checked, F.length).alias("checked"))

    def placed(p: Column) -> Column:
        # A match begins after the parts up to it and the matches before it.
        steps = F.transform(p["sizes"], lambda _, i: F.get(p["gaps"], i) + F.when(i > 0, F.get(p["sizes"], i - 1)).otherwise(0))

        def spans(starts: Column) -> Column:
            every = F.transform(starts, lambda start, i: F.struct(start.alias("start"), F.lit(at).alias("kind"), (start + F.get(p["sizes"], i)).alias("end"), (F.get(p["checked"], i) >= rule.least).alias("fits")))
            return F.filter(every, lambda s: s["fits"])

        return _let(running_sums(steps), spans)

    spans = _let(parsed, placed)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def spans_text(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of start, kind, end; kinds are places in ``rules``).

    ``index``: what ``build_index`` gave for these rows and this key; else it is built.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    source, row = (docs, key) if index is not None else numbered(docs, key, text)
    rows = source.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{row}`").cast("long").alias("_row"), text_or_empty(text).alias("text"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if any(queries):
        index = build_index(source, row, text) if index is None else index
        wanted = written(candidates(index, rules), "secret-candidates")
        few = wanted.count() <= BROADCAST_CANDIDATES
        rows = rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), F.col("_row") == F.col("row"), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    found = []
    for at, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        asked_for = F.coalesce(F.array_contains("rules", at), F.lit(False)) if query else F.col("text").rlike(_tight(rule))
        found.append(F.when(asked_for, matches(F.col("text"), rule, at)).otherwise(none))
    # Written, since each later use of the column would match all expressions again.
    return written(rows.select("doc_id", F.concat(*found).alias("found")), "secret-found")


def _tight(rule: Rule) -> str:
    """The rule's expression; for a repeated class, only runs of the least length: matches are whole runs either way, and the short ones are no longer listed to be dropped."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least},}}" if m and rule.group == 0 else rule.pattern


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of base rules, and all spans, from what ``scan`` gives."""
    kinds = [r.kind for r in rules]
    base = [at for at, r in enumerate(rules) if r.base]
    own = F.filter("found", lambda s: s["kind"] < len(base))

    def of(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(at).alias(f"n_{kinds[at]}") for at in base]
    return found.select("doc_id", *counts, F.sha2(spans_text(own, kinds).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("found"), kinds).alias("spans"))
