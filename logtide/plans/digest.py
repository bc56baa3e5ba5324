"""From raw log files to what a digest shows: one chain of tables, of which only bounded parts reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.times import Period, compared_periods
from logtide.operators import baseline, blocks, drain, noise, parse, records, templates
from logtide.operators.ordering import ranked, written
from logtide.sources import logfiles

#: Share of a file's lines that may be unread without a warning.
UNREAD_SHARE = 0.05


@dataclass(frozen=True)
class Incident:
    ticket: str
    time: datetime
    before_minutes: float = 30
    after_minutes: float = 30
    product: str | None = None
    version: str | None = None
    os: str | None = None
    symptom: str | None = None
    zone: str = "+09:00"

    @property
    def start(self) -> datetime:
        return self.time - timedelta(minutes=self.before_minutes)

    @property
    def end(self) -> datetime:
        return self.time + timedelta(minutes=self.after_minutes)


@dataclass
class Analysis:
    """The tables of a run, and the few values that were decided on the way."""

    incident: Incident
    records: DataFrame
    files: DataFrame
    templates: DataFrame
    days: DataFrame
    points: DataFrame
    expected: DataFrame
    comparisons: DataFrame
    stream: DataFrame
    blocks_all: DataFrame
    blocks: DataFrame
    selection: baseline.Selection
    first_change: object
    counts: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def analyse(
    spark: SparkSession,
    inputs: Sequence[str],
    incident: Incident,
    formats: Sequence[parse.LogFormat] = (parse.LogFormat(),),
    rules: Sequence[noise.Rule] = (),
    settings: baseline.Settings = baseline.Settings(),
    baselines: Sequence[str] = (),
    reason: str | None = None,
    compare: bool = True,
    offsets: dict[str, float] | None = None,
    context: int = 5,
    most_in_block: int = 60,
    most_blocks: int = 30,
    mining: drain.Settings = drain.Settings(),
) -> Analysis:
    start, end = incident.start, incident.end
    listed = logfiles.listed(inputs, formats, spark)
    parsed, stats = parse.parsed(logfiles.lines(spark, listed, formats), list(formats), incident.zone, offsets)
    files = written(logfiles.with_empty(stats, listed), "files")

    ordered = ranked(parsed, ["ts", "file_order", "lineno"], "records", "seq")
    mined = written(drain.mine(ordered, ["seq"], settings=mining).withColumnRenamed("template", "text").withColumnRenamed("template_key", "template"), "mined")
    totals = templates.window_totals(mined, start, end)
    ids = templates.numbered(mined, ["seq"])
    names = mined.select("template", "text").distinct()
    table = noise.with_noise(totals.join(ids, "template").join(names, "template"), list(rules), incident.version)
    # One row per template from here on.
    table = written(table, "templates")

    first, last = baseline.span(mined)
    days = written(baseline.daily_profile(mined, incident.time, settings), "days")
    points = written(baseline.change_points(mined, days, settings), "points")
    changed = baseline.first_change(points, incident.time)
    days = baseline.with_candidates(days, changed, incident.time)
    if not compare:
        selection = baseline.Selection("none", [], "no comparison was asked for")
    elif baselines:
        selection = baseline.manual_periods(compared_periods(list(baselines), start, end), reason, first, last, start, end)
    else:
        selection = baseline.select_periods(days, first, incident.time, start, end, settings)
    expected = baseline.expected_counts(mined, selection.periods, start, end)
    found = baseline.comparisons(table, expected, settings) if selection.periods else baseline.comparisons(table, expected, settings).where("false")
    found = written(found, "comparisons")
    table = written(noise.suspended(table, found, points, settings), "templates")

    kept = mined.join(F.broadcast(table.select("template", "template_id", "is_noise")), "template") if table.count() <= 100_000 else mined.join(table.select("template", "template_id", "is_noise"), "template")
    kept = kept.withColumn("is_trigger", records.is_trigger(kept)).withColumn("has_stack", records.has_stack(F.col("extra")))
    stream = ranked(records.in_window(kept, start, end).where("NOT is_noise"), ["seq"], "stream", "position")
    n_stream = stream.count()
    triggers = stream.where("is_trigger")
    every = written(blocks.capped(triggers, context, context, most_in_block, n_stream), "blocks")
    chosen = blocks.selected(every, triggers, most_blocks)

    out = Analysis(incident, kept, files, table, days, points, expected, found, stream, every, chosen, selection, changed)
    sums = kept.agg(F.count("*").alias("all"), F.count(F.when(F.col("ts").between(F.lit(start), F.lit(end)), 1)).alias("window")).first()
    out.counts = {"records": sums["all"], "window": sums["window"], "stream": n_stream, "templates": table.count(), "blocks": every.count(), "blocks_kept": chosen.count()}
    out.warnings = [*_quality(files, incident, out.counts), *selection.warnings]
    if rules and not incident.version:
        out.warnings.append("no product version: all noise rules apply")
    if unused := sorted(set(offsets or {}) - {r.alias for r in files.select("alias").distinct().collect()}):
        out.warnings.append(f"clock offsets of no file: {', '.join(unused)}")
    return out


def _quality(files: DataFrame, incident: Incident, counts: dict) -> list[str]:
    """What is wrong with the input; files are one row each."""
    out = []
    for f in files.orderBy("file_order").collect():
        if not f.records:
            out.append(f"{f.file}: no line fits a pattern")
            continue
        unread = f.unparsed_lines + f.bad_timestamps
        if f.total_lines and unread / f.total_lines > UNREAD_SHARE:
            out.append(f"{f.file}: {unread} lines can't be read ({unread / f.total_lines:.0%})")
        if f.unknown_levels:
            out.append(f"{f.file}: unknown levels were read as INFO: {', '.join(f'{level} ({n})' for level, n in sorted(f.unknown_levels.items()))}")
        if f.encoding not in ("utf-8", "ascii"):
            out.append(f"{f.file}: read as {f.encoding}")
        if f.last_ts < incident.start or f.first_ts > incident.end:
            out.append(f"{f.file}: its time span doesn't meet the window")
    if not counts["window"]:
        out.append("there is no record in the window; check the time, the zone and the clocks")
    return out


def store_tables(a: Analysis) -> dict[str, DataFrame]:
    """The tables of the search store.  A suspended template is no noise there."""
    from logtide.plans.store import logs_table

    spark, i = a.records.sparkSession, a.incident
    t = a.templates.select("template_id", "level", F.col("severity").cast("byte").alias("severity"), "total_count", "first_ts", "last_ts", "window_count", "window_first", "window_last", F.when(F.col("is_noise"), F.col("noise_reason")).alias("noise_reason"), F.col("text").alias("template"))
    incident = spark.createDataFrame(
        [(i.ticket, i.product, i.version, i.os, i.symptom, i.time, i.start, i.end, i.zone)],
        "ticket string, product string, product_version string, os string, symptom string, incident_time timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz, timezone string",
    )
    files = a.files.select("file", "alias", "format", "encoding", "records", (F.col("unparsed_lines") + F.col("bad_timestamps")).alias("unparsed_lines"), "first_ts", "last_ts", "clock_offset_seconds")
    return {"logs": logs_table(a.records, t), "templates": t.coalesce(1).sortWithinPartitions("template_id"), "incident": incident, "files": files}


def baseline_summary(a: Analysis) -> dict:
    """What the hand-over says of the baseline: periods, and one entry a day."""
    return {
        "selection": a.selection.how,
        "reason": a.selection.reason,
        "periods": [{"start": str(p.start), "end": str(p.end)} for p in a.selection.periods],
        "first_change": str(a.first_change) if a.first_change else None,
        "change_points": a.points.count(),
        "comparisons": {r.kind: r.n for r in baseline.verdict_counts(a.comparisons).collect()},
        "days": [{"date": str(d.day)} | {k: d[k] for k in ("records", "errors", "full", "incident_day", "business", "error_spike", "after_change", "normal_candidate")} for d in a.days.orderBy("day").collect()],
    }


def normal_days(summary: dict) -> list[Period]:
    """Every day that is a candidate, as a period."""
    out = []
    for d in summary.get("days") or []:
        if d["normal_candidate"]:
            day = datetime.fromisoformat(d["date"])
            out.append(Period(day, day + timedelta(days=1), d["date"]))
    return out
