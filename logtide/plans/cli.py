"""Command lines: digest, the query tools, and the noise workflow."""

from __future__ import annotations

import argparse
import configparser
import hashlib
import json
import sys
from dataclasses import replace
from datetime import date, datetime
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from logtide.functions.times import ArgumentError, normal_periods, time_bound
from logtide.operators import baseline, drain, noise, parse
from logtide.plans import digest, knowledge, render, store
from logtide.plans.tools import Tools, limits_of
from logtide.sources import logfiles


def session() -> SparkSession:
    return SparkSession.builder.appName("logtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def formats_of(path: str | None) -> list[parse.LogFormat]:
    """Formats of a YAML file: a list ``formats``, over ``defaults``, and ``level_aliases`` of all of them."""
    if not path:
        return [parse.LogFormat()]
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    defaults = raw.get("defaults") or {}
    aliases = tuple((str(k).upper(), str(v).upper()) for k, v in (raw.get("level_aliases") or {}).items())
    out = []
    for item in raw.get("formats") or []:
        known = {"name", "ts_format", "timezone", "encoding", "clock_offset_seconds"}
        values = {k: v for k, v in (defaults | item).items() if k in known}
        values |= {k: tuple(item[k]) for k in ("files", "patterns") if item.get(k)}
        if item.get("pattern") and "patterns" not in values:
            values["patterns"] = (item["pattern"],)
        values["level_aliases"] = aliases
        out.append(parse.LogFormat(**values))
    if not out:
        raise ArgumentError(f"no formats in {path}")
    return out


def mining_of(path: str | None) -> drain.Settings:
    """Settings and masks of a Drain INI file; what this miner can't do is an error."""
    if not path:
        return drain.Settings()
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_string(Path(path).read_text(encoding="utf-8"))
    own = dict(ini["DRAIN"]) if ini.has_section("DRAIN") else {}
    masking = dict(ini["MASKING"]) if ini.has_section("MASKING") else {}
    # The tree routes by number of tokens and first token.
    fixed = {"depth": ("4",), "parametrize_numeric_tokens": ("true", "yes", "on", "1"), "extra_delimiters": ("[]",), "mask_prefix": ("<",), "mask_suffix": (">",)}
    for name, value in (own | masking).items():
        if name in fixed and value.lower() not in fixed[name]:
            raise ArgumentError(f"{name} in {path} can only be {fixed[name][0]}")
        if name not in fixed and name not in ("sim_th", "max_children", "max_clusters", "masking"):
            raise ArgumentError(f"unknown setting in {path}: {name}")
    usual = drain.Settings()
    masks = tuple((m["regex_pattern"], m["mask_with"]) for m in json.loads(masking["masking"])) if "masking" in masking else usual.masks
    return drain.Settings(float(own.get("sim_th", usual.similarity)), int(own.get("max_children", usual.most_children)), int(own.get("max_clusters", usual.most_clusters)), masks=masks)


def hashes_of(paths: list[str | None]) -> dict:
    """Path and SHA-256 of configuration files by name."""
    return {Path(p).name: {"path": p, "sha256": hashlib.sha256(Path(p).read_bytes()).hexdigest()} for p in paths if p}


def _yaml(path: str | None):
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) if path else None


def offsets_of(values: list[str]) -> dict[str, float]:
    out = {}
    for value in values:
        alias, equals, seconds = value.partition("=")
        try:
            out[alias] = float(seconds)
        except ValueError:
            equals = ""
        if not equals:
            raise ArgumentError(f"not ALIAS=SECONDS: {value!r}")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logtide")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("digest")
    for name in ("--ticket", "--incident-time", "--out"):
        d.add_argument(name, required=True)
    d.add_argument("--logs", nargs="+", required=True)
    for name in ("--symptom", "--product", "--product-version", "--os", "--baseline-reason", "--formats", "--settings", "--known-noise", "--drain"):
        d.add_argument(name)
    d.add_argument("--tz", default="+09:00")
    d.add_argument("--strict-mining", action="store_true", help="look at each record anew, in order")
    d.add_argument("--if-changed", action="store_true", help="do nothing if the store was made of the same files and settings")
    d.add_argument("--clock-offset", action="append", default=[])
    d.add_argument("--baseline", action="append", default=[])
    for name, kind, usual in (("--window-minutes", float, 30.0), ("--before-minutes", float, None), ("--after-minutes", float, None), ("--context-lines", int, 5), ("--max-block-records", int, 60), ("--max-blocks", int, 30), ("--first-errors", int, 3), ("--max-tokens", int, 5000)):
        d.add_argument(name, type=kind, default=usual)

    def tool(name: str) -> argparse.ArgumentParser:
        t = sub.add_parser(name)
        t.add_argument("--dir", required=True)
        t.add_argument("--limits")
        return t

    tool("get-digest")
    tool("schema")
    s = tool("search")
    s.add_argument("texts", nargs="*")
    for name in ("--regex", "--message-only", "--exclude-noise"):
        s.add_argument(name, action="store_true")
    s.add_argument("--desc", dest="descending", action="store_true")
    s.add_argument("--level")
    for name in ("--files", "--components", "--templates"):
        s.add_argument(name, nargs="+", default=[])
    s.add_argument("--limit", type=int)
    c = tool("context")
    c.add_argument("line")
    for name in ("--before", "--after", "--extra"):
        c.add_argument(name, type=int)
    c.add_argument("--merged", action="store_true")
    t = tool("lines")
    t.add_argument("template")
    t.add_argument("--limit", type=int)
    t.add_argument("--sample", choices=("first", "last", "spread"), default="first")
    n = tool("count")
    n.add_argument("templates", nargs="+")
    n.add_argument("--bucket")
    for ranged in (s, t, n):
        ranged.add_argument("--from", dest="low")
        ranged.add_argument("--to", dest="high")
    q = tool("sql")
    q.add_argument("text")
    q.add_argument("--most", type=int)
    q.add_argument("--seconds", type=float)

    k = tool("noise-candidates")
    k.add_argument("--source", required=True)
    k.add_argument("--normal", action="append", default=[])
    k.add_argument("--versions", nargs="+")
    k.add_argument("--min-count", type=int, default=knowledge.LEAST_COUNT)
    k.add_argument("--min-hours", type=int, default=knowledge.LEAST_HOURS)
    k.add_argument("--out")
    m = sub.add_parser("noise-merge")
    m.add_argument("--candidates", required=True)
    m.add_argument("--allow-undecided", action="store_true")
    v = sub.add_parser("noise-validate")
    for x in (k, m, v):
        x.add_argument("--dict", required=True)
    for x in (k, m):
        x.add_argument("--rejected", required=True)
    return p


_TOOLS = {"get-digest": "digest", "schema": "schema", "search": "search", "context": "context", "lines": "lines", "count": "count", "sql": "sql"}


def run(arguments: list[str], spark: SparkSession | None = None) -> str:
    a = parser().parse_args(arguments)
    if a.command == "noise-validate":
        bad = knowledge.problems(knowledge.read_list(a.dict)[1])
        if bad:
            raise ArgumentError("\n".join(bad))
        return "no problems\n"
    if a.command == "noise-merge":
        (head, known), (head2, rejected) = knowledge.read_list(a.dict), knowledge.read_list(a.rejected)
        known, rejected, bad = knowledge.merge(_yaml(a.candidates) or {}, known, rejected, date.today(), a.allow_undecided)
        if bad:
            raise ArgumentError("\n".join(bad))
        knowledge.write_yaml(a.dict, known, head)
        knowledge.write_yaml(a.rejected, rejected, head2)
        return f"{len(known)} rules, {len(rejected)} rejections\n"
    spark = spark or session()
    if a.command == "digest":
        return _digest(spark, a)
    if a.command == "noise-candidates":
        tables = store.opened(spark, str(Path(a.dir) / "store"))
        about = store.manifest(str(Path(a.dir) / "store"))["about"]
        versions = a.versions or knowledge.usual_versions(about.get("product_version"))
        if not versions:
            raise ArgumentError("name the versions")
        periods = normal_periods(a.normal) or digest.normal_days(about.get("baseline") or {})
        found = knowledge.propose(tables["logs"], tables["templates"], periods, versions, a.source, knowledge.read_list(a.dict)[1], knowledge.read_list(a.rejected)[1], a.min_count, a.min_hours)
        path = a.out or str(Path(a.dir) / "noise_candidates.yaml")
        knowledge.write_yaml(path, found, ["# Candidates for known noise: fill in decision (register or reject),", "# reason and code (register) or reject_reason (reject), then merge."])
        return f"{len(found['candidates'])} candidates, {len(found['skipped'])} skipped: {path}\n"
    chosen = {k: v for k, v in vars(a).items() if k not in ("command", "dir", "limits")}
    return Tools(spark, a.dir, limits_of(_yaml(a.limits))).call(_TOOLS[a.command], **chosen)


def _digest(spark: SparkSession, a: argparse.Namespace) -> str:
    at = time_bound(a.incident_time, datetime.now(), False)
    minutes = {k: a.window_minutes if v is None else v for k, v in (("before", a.before_minutes), ("after", a.after_minutes))}
    incident = digest.Incident(a.ticket, at, minutes["before"], minutes["after"], a.product, a.product_version, a.os, a.symptom, a.tz)
    off = a.baseline == ["none"]
    formats = formats_of(a.formats)
    # The same files, and all that was asked for but where to and how.
    asked = {k: v for k, v in sorted(vars(a).items()) if k not in ("command", "out", "if_changed")}
    configs = [p for p in (a.formats, a.settings, a.known_noise, a.drain) if p]
    made_of = store.stamp([path for path, *_ in logfiles.listed(a.logs, formats, spark)] + configs, asked, spark)
    if a.if_changed and store.is_fresh(str(Path(a.out) / "store"), made_of):
        return f"{a.out}: unchanged\n"
    found = digest.analyse(spark, a.logs, incident, formats, noise.rules_of(_yaml(a.known_noise)), baseline.Settings.of(_yaml(a.settings)), [] if off else a.baseline, a.baseline_reason, not off, offsets_of(a.clock_offset), a.context_lines, a.max_block_records, a.max_blocks, replace(mining_of(a.drain), strict=a.strict_mining))
    limits = render.Limits(first_errors=a.first_errors)
    texts = render.write(found, a.out, a.max_tokens, limits, config=hashes_of([a.formats, a.settings, a.known_noise, a.drain]), stamp=made_of)
    return "".join(f"{Path(a.out) / name}\n" for name in texts) + json.dumps(found.counts) + "\n" + "".join(f"warning: {w}\n" for w in found.warnings)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
        return 0
    except (ArgumentError, store.StoreError, FileNotFoundError, ValueError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
