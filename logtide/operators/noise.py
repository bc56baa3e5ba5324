"""Known noise: rules that demote templates, and the reasons to suspend them for an incident."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.text import pattern_regex
from logtide.operators.baseline import APPEAR, NEW, SURGE, Settings
from logtide.operators.ordering import written


@dataclass(frozen=True)
class Rule:
    template: str
    reason: str
    versions: tuple[str, ...] = ("*",)
    added: str = ""

    def applies_to(self, version: str | None) -> bool:
        """Without a version, every rule applies."""
        return version is None or any(fnmatchcase(version, v) for v in self.versions)


def rules_of(raw: object) -> list[Rule]:
    """Rules from the content of a dictionary file: each needs a template and a reason."""
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise ValueError("the dictionary must be a list")
    out = []
    for i, item in enumerate(raw, 1):
        if not isinstance(item, dict) or not item.get("template"):
            raise ValueError(f"entry {i} has no template")
        if not str(item.get("reason") or "").strip():
            raise ValueError(f"entry {i} ({item['template']!r}) has no reason")
        versions = item.get("versions") or ["*"]
        versions = versions if isinstance(versions, list) else [versions]
        out.append(Rule(str(item["template"]), str(item["reason"]).strip(), tuple(map(str, versions)), str(item.get("added") or "")))
    return out


#: Rules up to which they are folded into one expression; more are looked up by a word of each.
FEW_RULES = 64
#: Texts up to which what was found of them is broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 100_000


def first_match(text: Column, rules: list[Rule], value: str = "reason") -> Column:
    """``value`` of the first rule that the text matches, or null: one expression, for a few rules."""
    found = None
    for rule in rules:
        hit, out = text.rlike(pattern_regex(rule.template)), F.lit(getattr(rule, value))
        found = F.when(hit, out) if found is None else found.when(hit, out)
    return F.lit(None).cast("string") if found is None else found


def anchors(templates: list[str]) -> list[str | None]:
    """For each template, a word that stands by itself in all texts that it matches: of its fixed words, the one that fewest templates have, then the longest; None if it has none."""
    words = [{w for w in t.split(" ") if w and not re.search(r"\s|<[^<>\s]*>", w)} for t in templates]
    shared = Counter(w for own in words for w in own)
    return [min(own, key=lambda w: (shared[w], -len(w), w), default=None) for own in words]


def with_match(df: DataFrame, rules: list[Rule], text: str, out: str, value: str = "reason") -> DataFrame:
    """``df`` with ``out``: ``value`` of the first rule that ``text`` matches, or null.

    Many rules are looked up: a text's words are joined to the rules' anchors, and only rules
    that are met are tried.  Those without an anchor are tried on all texts.
    """
    if len(rules) <= FEW_RULES:
        return df.withColumn(out, first_match(F.col(text), rules, value))
    found = anchors([r.template for r in rules])
    rows = [(place, pattern_regex(r.template), getattr(r, value), anchor) for place, (r, anchor) in enumerate(zip(rules, found, strict=True))]
    # The rules came from the driver.
    table = df.sparkSession.createDataFrame(rows, "_place int, _regex string, _value string, _anchor string")
    texts = written(df.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct(), "rule-texts")
    words = texts.select("_text", F.explode(F.array_distinct(F.split("_text", r"\s+"))).alias("_anchor"))
    met = words.join(F.broadcast(table), "_anchor").where(F.regexp_like("_text", F.col("_regex"))).select("_text", F.struct("_place", "_value").alias("_hit"))
    if free := [r for r in rows if r[3] is None]:
        every = F.from_json(F.lit(json.dumps([{"_place": p, "_regex": x, "_value": v} for p, x, v, _ in free])), "array<struct<_place:int,_regex:string,_value:string>>")
        first = F.get(F.filter(every, lambda r: F.regexp_like(F.col("_text"), r["_regex"])), F.lit(0))
        met = met.unionByName(texts.select("_text", first.alias("_r")).where("_r IS NOT NULL").select("_text", F.struct("_r._place", "_r._value").alias("_hit")))
    firsts = written(met.groupBy("_text").agg(F.min("_hit").alias("_hit")).select("_text", F.col("_hit._value").alias("_match")), "rule-matches")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_TEXTS else firsts.hint("merge")
    joined = df.join(firsts, F.col(text) == F.col("_text"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("_match").alias(out))


def with_noise(templates: DataFrame, rules: list[Rule], version: str | None = None, text: str = "text") -> DataFrame:
    """``templates`` with noise_reason."""
    return with_match(templates, [r for r in rules if r.applies_to(version)], text, "noise_reason")


def suspended(templates: DataFrame, found: DataFrame, points: DataFrame, settings: Settings = Settings(), key: str = "template") -> DataFrame:
    """``templates`` with suspended: SURGE, NEW or APPEAR where a noisy template is unlike itself this time, and is_noise."""
    compared = found.where((F.col("kind") == SURGE) | (F.col("kind") == NEW) & (F.col("observed") >= settings.suspend_new_min_count)).select(key, F.col("kind").alias("_compared"))
    came = points.where(F.col("kind") == APPEAR).select(key, F.lit(APPEAR).alias("_came"))
    joined = templates.join(compared, key, "left").join(came, key, "left")
    why = F.when(F.col("noise_reason").isNotNull(), F.coalesce("_compared", "_came"))
    return joined.withColumn("suspended", why).withColumn("is_noise", F.col("noise_reason").isNotNull() & F.col("suspended").isNull()).drop("_compared", "_came")
