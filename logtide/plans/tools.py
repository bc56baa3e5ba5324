"""The bounded query tools over a store: digest, search, context, lines of a template, counts by time, SQL and schema.

A tool returns text.  Every tool caps what it collects, whatever it is asked for.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logtide.functions.times import ArgumentError, bucket_width, time_bound
from logtide.operators import search
from logtide.plans import sql_guard, store
from logtide.plans.render import clip, first_rows

# What a call may return at most, and what it returns unasked.
LIMITS = {
    "chars": 300,
    "digest_chars": 20_000,
    "search_lines": 200,
    "overflow_lines": 20,
    "overflow_templates": 10,
    "context_lines": 10,
    "most_context_lines": 50,
    "context_extra": 3,
    "most_context_extra": 10,
    "target_extra": 60,
    "template_lines": 20,
    "buckets": 120,
    "count_templates": 8,
    "sql_rows": 200,
    "sql_seconds": 30,
    "cell_chars": 300,
}
#: Where a limits file has them: section and item.
LIMIT_ITEMS = {
    "common": {"msg_chars": "chars"},
    "get_digest": {"max_chars": "digest_chars"},
    "search_logs": {"max_lines": "search_lines", "overflow_lines": "overflow_lines", "overflow_templates": "overflow_templates"},
    "get_context": {
        # One usual number holds for both sides here.
        "default_before": "context_lines",
        "default_after": "context_lines",
        "max_before": "most_context_lines",
        "max_after": "most_context_lines",
        "target_extra_lines": "target_extra",
        "default_extra_lines": "context_extra",
        "max_extra_lines": "most_context_extra",
    },
    "template_lines": {"max_lines": "template_lines"},
    "count_by_time": {"max_buckets": "buckets", "max_templates": "count_templates"},
    "run_sql": {"max_rows": "sql_rows", "timeout_seconds": "sql_seconds", "cell_chars": "cell_chars"},
}
#: Items of a limits file that are about a store of one process.
LIMITS_OF_STORE = ("memory_limit", "threads")


def limits_of(raw: dict | None) -> dict:
    """Limits from the content of a limits file over the usual ones; unknown items are errors."""
    out, given = dict(LIMITS), {}
    for section, items in (raw or {}).items():
        known = LIMIT_ITEMS.get(section)
        if known is None or not isinstance(items, dict):
            raise ArgumentError(f"unknown limits: {section}")
        for item, value in items.items():
            if section == "common" and item in LIMITS_OF_STORE:
                continue
            if item not in known or isinstance(value, bool) or not isinstance(value, int | float) or value <= 0:
                raise ArgumentError(f"not a limit: {section}.{item}: {value!r}")
            name = known[item]
            if given.setdefault(name, value) != value:
                raise ArgumentError(f"{section}.{item} must be the same before and after a line")
    return out | given


COLUMNS = {
    "seq": "place in the merged order of all files",
    "line_id": "file:line",
    "lineno": "line of the file, from 1",
    "ts": "time in the display zone, clock corrected",
    "severity": "0 TRACE to 5 FATAL",
    "noise": "whether the template is known noise",
    "message": "the first line without time, level and component",
    "extra": "the lines that follow, or null",
    "extra_lines": "how many lines follow, also those not kept",
    "window_count": "records in the incident's window",
    "noise_reason": "why it is noise, or null",
}


def capped(asked: int | None, usual: int, most: int) -> int:
    return max(0, min(usual if asked is None else asked, most))


def _when(ts: datetime | None, millis: bool = True) -> str:
    return "-" if ts is None else ts.strftime("%m-%d %H:%M:%S") + (f".{ts.microsecond // 1000:03d}" if millis else "")


@dataclass
class Tools:
    spark: SparkSession
    folder: str
    limits: dict = field(default_factory=lambda: dict(LIMITS))

    def __post_init__(self):
        self.tables = store.opened(self.spark, str(Path(self.folder) / "store"))
        self.incident = self.tables["incident"].first()
        self.files = [(r.file, r.alias) for r in self.tables["files"].select("file", "alias").orderBy("file").collect()]

    def _range(self, low: str | None, high: str | None) -> tuple[datetime | None, datetime | None]:
        at = self.incident.incident_time
        bounds = time_bound(low, at, False) if low else None, time_bound(high, at, True) if high else None
        if all(bounds) and bounds[0] >= bounds[1]:
            raise ArgumentError(f"{low} isn't before {high}")
        return bounds

    def _line(self, r, mark: str | None = None, extra: int = 0) -> list[str]:
        chars = self.limits["chars"]
        mark = (" ~ " if r.noise else "   ") if mark is None else mark
        component = f"[{r.component}] " if r.component else ""
        head = f"{mark}{_when(r.ts)} {r.template_id} {r.level:<5} {r.alias} {component}{clip(r.message, chars)}  @{r.line_id}"
        shown = (r.extra or "").split("\n")[:extra] if r.extra_lines else []
        rest = r.extra_lines - len(shown)
        return [head + (f"  (+{rest} lines)" if rest and not shown else ""), *["      " + clip(x, chars) for x in shown], *([f"      … {rest} more lines"] if rest and shown else [])]

    def digest(self) -> str:
        found = sorted(Path(self.folder).glob("digest_*.md"))
        if not found:
            raise ArgumentError(f"no digest in {self.folder}")
        text, most = found[0].read_text(encoding="utf-8"), self.limits["digest_chars"]
        return text if len(text) <= most else f"{text[:most].rstrip()}\n\n… {len(text) - most} more characters in {found[0]}\n"

    def search(self, texts: Sequence[str] = (), regex=False, message_only=False, level=None, low=None, high=None, files=(), components=(), templates=(), exclude_noise=False, descending=False, limit=None) -> str:
        bounds = self._range(low, high)
        query = search.Query(tuple(texts), regex, message_only, level, *bounds, tuple(search.resolved_file(f, self.files) for f in files), tuple(components), tuple(search.template_ids(templates)), exclude_noise)
        found = search.matching(self.tables["logs"], query)
        most = max(1, capped(limit, self.limits["search_lines"], self.limits["search_lines"]))
        rows, more = first_rows(found.orderBy(*[F.desc(c) if descending else F.asc(c) for c in ("ts", "seq")]), most)
        total = found.count() if more else len(rows)
        out = [f"{total:,} records"]
        if more:
            rows = rows[: min(most, self.limits["overflow_lines"])]
            out.append(f"over {most}; the {'last' if descending else 'first'} {len(rows)} are shown")
        for r in rows:
            out += self._line(r)
        if more:
            n = self.limits["overflow_templates"]
            names = self.tables["templates"].select("template_id", "template")
            out += ["", "by template:"]
            top, others = first_rows(search.breakdown(found, names, n + 1), n)
            out += [f"  {t.template_id}  {t.n:,}  {_when(t.first_ts, False)} – {_when(t.last_ts, False)}  {clip(t.template or '', 100)}" for t in top]
            out += ["  …"] if others else []
        return "\n".join(out) + "\n"

    def context(self, line: str, before: int | None = None, after: int | None = None, merged: bool = False, extra: int | None = None) -> str:
        usual, most = self.limits["context_lines"], self.limits["most_context_lines"]
        before, after = capped(before, usual, most), capped(after, usual, most)
        extra = capped(extra, self.limits["context_extra"], self.limits["most_context_extra"])
        name, lineno = search.line_reference(line)
        file = search.resolved_file(name, self.files)
        logs = self.tables["logs"]
        target = search.record_at(logs, file, lineno).first()
        if target is None:
            raise ArgumentError(f"no record at or before {file}:{lineno}")
        around = search.neighbours(logs, target.seq, before, after) if merged else search.neighbours(logs, target.lineno, before, after, "lineno", file)
        out = [f"around {file}:{lineno}, {'all files' if merged else 'the same file'}"]
        if target.lineno != lineno:
            out.append(f"line {lineno} continues the record at {file}:{target.lineno}")
        for r in around.orderBy("offset").collect():
            out += self._line(r, ">> ", self.limits["target_extra"]) if r.offset == 0 else self._line(r, None, extra)
        return "\n".join(out) + "\n"

    def lines(self, template: str, limit: int | None = None, low=None, high=None, sample: str = "first") -> str:
        most = max(1, capped(limit, self.limits["template_lines"], self.limits["template_lines"]))
        (name,) = search.template_ids([template])[:1] or [""]
        about = self.tables["templates"].where(F.col("template_id") == name).first()
        if about is None:
            raise ArgumentError(f"no template {template!r}")
        bounds = self._range(low, high)
        found = search.matching(self.tables["logs"], search.Query(templates=(name,), low=bounds[0], high=bounds[1]))
        total = found.count()
        if sample == "spread" and total > most:
            rows = search.spread_sample(found, ["ts", "seq"], most, total).orderBy("rn").collect()
        elif sample == "last":
            rows = search.page(found, ["ts", "seq"], most, descending=True).collect()[::-1]
        else:
            rows = search.page(found, ["ts", "seq"], most).collect()
        out = [f"{name} {about.level}: {about.total_count:,} records, {about.window_count:,} in the window", clip(about.template, 500)]
        out += [f"known noise: {about.noise_reason}"] if about.noise_reason else []
        out.append(f"{len(rows)} of {total:,} ({sample})")
        for r in rows:
            out += self._line(r)
        return "\n".join(out) + "\n"

    def count(self, templates: Sequence[str], bucket: str | None = None, low=None, high=None) -> str:
        names = search.template_ids(templates)
        if not names or len(names) > self.limits["count_templates"]:
            raise ArgumentError(f"name 1 to {self.limits['count_templates']} templates")
        known = {t.template_id: t for t in self.tables["templates"].where(F.col("template_id").isin(*names)).collect()}
        if missing := [n for n in names if n not in known]:
            raise ArgumentError(f"no templates {', '.join(missing)}")
        logs = self.tables["logs"]
        start, end = self._range(low, high)
        if start is None or end is None:
            first, last = logs.agg(F.min("ts"), F.max("ts")).first()
            start, end = start or first, end or last + timedelta(microseconds=1)
        b = search.buckets(start, end, self.limits["buckets"], bucket_width(bucket) if bucket else None)
        counts = search.count_by_time(logs, names, start, end, b)
        cells = {(r.bucket, r.template_id): r for r in counts.collect()}
        out = [f"{', '.join(names)} by {b.width}", *[f"  {n} {known[n].level}  {clip(known[n].template, 100)}" for n in names], "", "\t".join(["from", *names])]
        for run in search.zero_runs(counts).orderBy("first_bucket").collect():
            at = cells[run.first_bucket, names[0]].start
            if run.last_bucket > run.first_bucket:
                out.append(f"{at:%m-%d %H:%M:%S} – {cells[run.last_bucket, names[0]].start:%m-%d %H:%M:%S}\t" + "\t".join("0" for _ in names) + f"\t({run.last_bucket - run.first_bucket + 1} buckets)")
            else:
                out.append(f"{at:%m-%d %H:%M:%S}\t" + "\t".join(str(cells[run.first_bucket, n].n) for n in names))
        # The total also counts what lies in buckets beyond the last.
        bound = search.matching(logs, search.Query(templates=tuple(names), low=start, high=end))
        totals = {r.template_id: r["count"] for r in bound.groupBy("template_id").count().collect()}
        return "\n".join([*out, "\t".join(["total", *[str(totals.get(n, 0)) for n in names]])]) + "\n"

    def sql(self, text: str, most: int | None = None, seconds: float | None = None) -> str:
        most = max(1, capped(most, self.limits["sql_rows"], self.limits["sql_rows"]))
        columns, rows, more = sql_guard.run(self.spark, self.tables, text, most, min(seconds or self.limits["sql_seconds"], self.limits["sql_seconds"]))

        def cell(v) -> str:
            if v is None:
                return "NULL"
            return v.isoformat(sep=" ", timespec="milliseconds") if isinstance(v, datetime) else clip(str(v).replace("\n", "⏎"), self.limits["cell_chars"])

        return "\n".join([f"{len(rows)} rows" + (f", cut at {most}" if more else ""), "", "\t".join(columns), *["\t".join(map(cell, r)) for r in rows]]) + "\n"

    def schema(self) -> str:
        out = [f"times are in {self.incident.timezone}, without zone"]
        for name, df in self.tables.items():
            out += ["", f"{name} ({df.count():,} rows)", *[f"  {c} {t}" + (f" – {COLUMNS[c]}" if c in COLUMNS else "") for c, t in df.dtypes]]
        return "\n".join([*out, "", f"incident {self.incident.ticket} at {self.incident.incident_time}, window {self.incident.window_start} – {self.incident.window_end}"]) + "\n"

    def call(self, tool: str, **arguments) -> str:
        """Run a tool and note the call; a note that can't be written is left out."""
        began, status, text = time.time(), "ok", ""
        try:
            text = getattr(self, tool)(**arguments)
            return text
        except ArgumentError:
            status = "refused"
            raise
        finally:
            note = {"tool": tool, "arguments": {k: v for k, v in arguments.items() if v not in (None, (), [], False)}, "status": status, "chars": len(text), "seconds": round(time.time() - began, 3)}
            try:
                with open(Path(self.folder) / "calls.jsonl", "a", encoding="utf-8") as file:
                    file.write(json.dumps(note, ensure_ascii=False, default=str) + "\n")
            except OSError:
                pass
