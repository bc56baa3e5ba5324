"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find.

Base entities (email, ip, card, phone) are seeds.  The words and signs around a seed are
lexical patterns of several forms: the two words before it, the word on either side, one word
before, one word behind, and the last label (a word with a colon or an equals sign) among the
words before.  Other tokens with a digit or an @ are candidates, with patterns of the same
forms.  Patterns and the distinct values they surround form a graph, which is scored in rounds
until nothing moves:

* A pattern is as sure of a kind as its values are on average.  Seeds of the kind count 1,
  seeds of other kinds 0, and a candidate what its contexts *without that pattern* make of it.
* A context is as sure as the surest of its patterns, which often know the same values and
  so count once.  A candidate is believed unless all its contexts err.

No pattern hears its own vote, nor that of its neighbours, so a context half of whose values
are unknown stays half sure, however many rounds there are.

How far the patterns of a form may be trusted with a kind is learned from seeds that are held
back, one at a time: of the seeds that a form's other seeds would give that kind, the share
that is of it.  In random prose, words stand before cards as often as before addresses, and no
form is trusted; where labels mean something, theirs is.  Candidates in patterns that are sure,
of a form that is trusted, are added as spans.

Null texts count as empty.  Spans are in code points, ends exclusive; spans of several kinds
may overlap, added ones overlap no base one.  Values that repeat count once in a pattern.
Ids may be null or repeat, and may be of any type: spans stay with their own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import attached, map_rows, numbered, written
from logtide.llm.secrets import spans_text

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern must surround to count, and how sure a pattern and an added span must be.
LEAST_SEEDS = 3
SURE = 0.8
#: Words before a span among which its label is looked for, and characters that are looked at.
LABEL_WORDS, LABEL_REACH = 4, 160
#: Scoring ends when no pattern moves by as much, or after so many rounds: scores only grow, by less each round.
SETTLED = 0.01
MOST_ROUNDS = 10

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails from its first digit fails from all others, so matches begin at runs' beginnings.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGES = ".,;:!?\"'()[]{}<>%#&*$=|~"
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """No character before '@' is an '@', so each match is found from its '@'; its start is as far left as the last match lets it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at += 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base entities, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _words_before(text: str, end: int) -> list[str]:
    """The last two words (runs of letters and digits) or signs before a place; ^ where there is none."""
    out = []
    while len(out) < 2:
        while end and text[end - 1].isspace():
            end -= 1
        start = end - 1
        if end and text[start].isalnum():
            while start and text[start - 1].isalnum():
                start -= 1
        out.append(text[start:end] if end else "^")
        end = max(0, start)
    return out[::-1]


def _word_after(text: str, start: int) -> str:
    n = len(text)
    while start < n and text[start].isspace():
        start += 1
    end = start + 1
    if start < n and text[start].isalnum():
        while end < n and text[end].isalnum():
            end += 1
    return text[start:end] or "$"


_LABEL = re.compile(r"([^\W_]{1,40})[^\S\n]*[:=]")
_WORD = re.compile(r"[^\W_]+")


def _label(text: str, start: int) -> str | None:
    """The last word before a place that has a colon or an equals sign behind it, on the same line and with few words behind it."""
    before = text[max(0, start - LABEL_REACH) : start].rpartition("\n")[2]
    found = None
    for found in _LABEL.finditer(before):  # noqa: B007
        pass
    return found[1] if found and sum(1 for _ in _WORD.finditer(before, found.end())) <= LABEL_WORDS else None


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span, each with the number of its form first; digits are all alike."""
    far, near, after = (_DIGITS.sub("0", w.lower()) for w in (*_words_before(text, start), _word_after(text, end)))
    found = [f"0 {far} {near} _", f"1 {near} _ {after}", f"2 {near} _", f"3 _ {after}"]
    if label := _label(text, start):
        found.append(f"4 {_DIGITS.sub('0', label.lower())} : _")
    return found


def value_key(value: str) -> str:
    """What stands for a value of any length."""
    return xxhash.xxh3_128_hexdigest(value.lower().encode("utf-8", "surrogatepass"))


def _like(value: str) -> list[int]:
    """Kinds that a candidate may be of."""
    digits = len(_DIGITS.findall(value))
    kinds = [0] if "@" in value else []
    kinds += [1] if digits and value.count(".") + value.count(":") >= 2 else []
    return kinds + ([2] if digits >= 12 else []) + ([3] if 6 <= digits <= 15 else [])


def _mentions(rows: Iterator[dict]) -> Iterator[tuple]:
    """A row for each text, without a span, and one for each base entity and candidate in it."""
    for row in rows:
        text, of = row["text"], (row["doc_id"], row["row"])
        yield *of, None, None, None, None, None, None
        base = base_spans(text)
        for a, k, b in base:
            yield *of, a, b, k, value_key(text[a:b]), patterns(text, a, b), [k]
        taken = sorted((a, b) for a, _, b in base)
        at = 0
        for m in _CANDIDATE.finditer(text):
            token = m[0]
            start = m.start() + len(token) - len(token.lstrip(_EDGES))
            end = m.end() - len(token) + len(token.rstrip(_EDGES))
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            # Spans of kinds may nest, so later ones are looked at as well while they begin before the token's end.
            if end <= start or any(a < end and b > start for a, b in _until(taken, at, end)):
                continue
            if like := _like(value := text[start:end]):
                yield *of, start, end, None, value_key(value), patterns(text, start, end), like


def _until(spans: list[tuple[int, int]], at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


_MENTIONS = "row long, start int, end int, kind int, value string, patterns array<string>, like array<int>"


def pattern_scores(contexts: DataFrame, least: int = LEAST_SEEDS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(pattern, kind, n_values, n_known, n_kind, sure): the certainty of patterns, and their distinct values, seeds, and seeds of the kind; a written table.

    ``contexts``: one row per distinct value and list of patterns around it (value, patterns,
    seed_kind; null: a candidate).  Patterns with fewer than ``least`` seeds of a kind never
    count for it, so they go first.
    """
    edges = contexts.select("value", "seed_kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed_kind").alias("seed_kind"))
    seeds = edges.groupBy("pattern", "seed_kind").agg(F.count("*").alias("n"))
    seeds = seeds.groupBy("pattern").agg(F.sum("n").alias("n_values"), F.coalesce(F.sum(F.when(F.col("seed_kind").isNotNull(), F.col("n"))), F.lit(0)).alias("n_known"), F.collect_list(F.when((F.col("n") >= least) & F.col("seed_kind").isNotNull(), F.struct(F.col("seed_kind").alias("kind"), "n"))).alias("kinds"))
    # One row per pattern; the kinds are at most as many as KINDS.
    seeds = written(seeds.where(F.size("kinds") > 0), "pii-seeded").select("pattern", "n_values", "n_known", F.explode("kinds").alias("k"))
    counted = ("pattern", "n_values", "n_known", "kind", "n_seeds")
    scores = written(seeds.select("pattern", "n_values", "n_known", "k.kind", F.col("k.n").alias("n_seeds"), (F.col("k.n") / F.col("n_values")).alias("score")), "pii-scores")

    # Only a candidate with a second context can move a score.
    unknown = contexts.where("seed_kind IS NULL").select("value", F.array_distinct("patterns").alias("around"))
    several = unknown.groupBy("value").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1")
    unknown = attached(unknown, written(several, "pii-several"), "value", "n_contexts")
    held = unknown.select("*", F.explode("around").alias("pattern"))
    rows_of = held.groupBy("pattern").agg(F.count("*").alias("n_rows"))
    held = written(attached(held, written(rows_of.join(scores.select("pattern").distinct(), "pattern"), "pii-patterns"), "pattern", "n_rows"), "pii-held")
    if held.isEmpty():
        return scores.select(*counted, F.col("score").alias("sure"))
    sizes = held.groupBy("pattern").agg(F.first("n_rows").alias("n_rows"))
    for _ in range(rounds):
        now = scores.groupBy("pattern").agg(F.collect_list(F.struct("kind", "score")).alias("now")).join(sizes, "pattern")
        heard = attached(held.drop("n_rows"), written(now, "pii-now"), "pattern", "n_rows").withColumn("s", F.explode("now"))
        of_context = heard.groupBy("value", "around", "s.kind").agg(F.max("s.score").alias("score"), F.collect_set("pattern").alias("patterns"))
        doubts = of_context.select(F.concat_ws(" ", "kind", "value").alias("vote"), "kind", "patterns", F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))).alias("doubt"))
        own = written(doubts.select("vote", "kind", "doubt", F.explode("patterns").alias("pattern")).groupBy("vote", "kind", "pattern").agg(F.sum("doubt").alias("doubt")), "pii-own")
        every = written(doubts.groupBy("vote").agg(F.sum("doubt").alias("all"), F.sum(F.size("patterns")).alias("n_rows")), "pii-votes")
        gained = attached(own, every, "vote", "n_rows").groupBy("pattern", "kind").agg(F.sum(1 - F.exp(F.col("all") - F.col("doubt"))).alias("gain"))
        next_ = scores.join(gained, ["pattern", "kind"], "left")
        moved = written(next_.select(*counted, ((F.col("n_seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("n_values")).alias("score"), F.col("score").alias("was")), "pii-scores")
        most = moved.agg(F.max(F.abs(F.col("was") - F.col("score")))).first()[0]
        scores = moved.drop("was")
        if (most or 0.0) < SETTLED:
            break
    return scores.select(*counted, F.col("score").alias("sure"))


def trusted(scores: DataFrame, least: int = LEAST_SEEDS, sure: float = SURE) -> DataFrame:
    """(form, kind, trust): how far patterns of a form are right about a kind, by seeds held back one at a time; a few rows.

    Without one of its seeds of the kind, a pattern has one seed and one value less; without a
    seed of another kind, one value less.  Where it is still sure, the one that was held back
    is found rightly, or wrongly.
    """
    own, all_, of = F.col("n_seeds"), F.col("n_values"), F.col("n_known")
    right = F.when((own - 1 >= least) & (own - 1 >= sure * (all_ - 1)), own).otherwise(0)
    wrong = F.when(own >= sure * (all_ - 1), of - own).otherwise(0)
    sums = scores.groupBy(F.substring("pattern", 1, 1).alias("form"), "kind").agg(F.sum(right).alias("right"), F.sum(wrong).alias("wrong"))
    return sums.select("form", "kind", ((F.col("right") + 1) / (F.col("right") + F.col("wrong") + 2)).alias("trust"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, found (arrays of start, kind, end; kinds are places in KINDS)."""
    source, row = numbered(docs, key, text)
    id_type = docs.schema[key].dataType.simpleString()
    sent = source.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{row}`").cast("long").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = written(map_rows(sent, _mentions, f"doc_id {id_type}, {_MENTIONS}"), "pii-mentions")
    flat = rows.where("value IS NOT NULL")
    # A value is a seed in a context if it is one anywhere in it.
    contexts = flat.groupBy("value", "patterns").agg(F.max("kind").alias("seed_kind"), F.count("*").alias("n"))
    contexts = written(contexts, "pii-contexts")
    scores = pattern_scores(contexts)
    # One row per form and kind at most.
    trust = written(trusted(scores, sure=sure).where(F.col("trust") >= sure), "pii-trust")
    known = scores.where(F.col("sure") >= sure).withColumn("form", F.substring("pattern", 1, 1)).join(F.broadcast(trust), ["form", "kind"])
    of_pattern = known.groupBy("pattern").agg(F.collect_list(F.struct("kind", F.least("sure", "trust").alias("sure"))).alias("kinds"))
    mentions = contexts.select("n", F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("pattern").agg(F.sum("n").alias("n_mentions"))
    known = written(of_pattern.join(mentions, "pattern"), "pii-known")
    sought = flat.where("kind IS NULL").select("row", "start", "end", "like", F.explode("patterns").alias("pattern"))
    sought = attached(sought, known, "pattern", "n_mentions").withColumn("k", F.explode("kinds")).where(F.array_contains("like", F.col("k.kind")))
    best = sought.groupBy("row", "start", "end").agg(F.min_by("k.kind", F.struct(-F.col("k.sure"), F.col("k.kind"))).alias("kind"))
    base = rows.where("start IS NULL OR kind IS NOT NULL").select("doc_id", "row", "start", "kind", "end", F.lit(True).alias("base"))
    spans = base.unionByName(best.withColumn("base", F.lit(False)).withColumn("doc_id", F.lit(None).cast(id_type)).select(base.columns))
    # A text's own row has its id; rows of spans that were added have none.
    span = F.struct("start", "kind", "end")
    held = F.col("start").isNotNull()
    out = spans.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.when(held & F.col("base"), span)).alias("base"), F.collect_list(F.when(held, span)).alias("found"))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("found").alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans, from what ``find`` gives."""

    def of(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base"), list(KINDS)).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("found"), list(KINDS)).alias("spans"))
