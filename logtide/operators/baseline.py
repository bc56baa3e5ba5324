"""The normal state to compare an incident with: days, change points, expected counts and verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from datetime import date, datetime, timedelta
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.times import FEW_PERIODS, micros, micros_of, ntz, Period, place_among, same_hours
from logtide.operators.records import ERROR

VANISHED, NEW, SURGE, DROP, APPEAR = "VANISHED", "NEW", "SURGE", "DROP", "APPEAR"
#: Verdicts in the order in which they are shown.
VERDICTS = (VANISHED, NEW, SURGE, DROP)


@dataclass(frozen=True)
class Settings:
    """Thresholds.  Fixed values: the defaults, which decide the verdicts."""

    business_day_ratio: float = 0.5
    full_day_margin_minutes: float = 60
    min_history_days: int = 3
    appear_persist_ratio: float = 0.5
    vanish_presence_ratio: float = 0.8
    error_spike_ratio: float = 3.0
    error_spike_min: int = 10
    vanished_min_expected: float = 5
    surge_min_count: int = 10
    surge_ratio: float = 5.0
    drop_min_expected: float = 20
    drop_ratio: float = 0.2
    suspend_new_min_count: int = 5
    fallback_min_minutes: float = 30

    #: Where a configuration file has the settings; those that aren't named are at the top.
    SECTIONS = {
        "change_points": ("min_history_days", "appear_persist_ratio", "vanish_presence_ratio"),
        "selection": ("error_spike_ratio", "error_spike_min"),
        "compare": ("vanished_min_expected", "surge_min_count", "surge_ratio", "drop_min_expected", "drop_ratio"),
        "noise": ("suspend_new_min_count",),
    }

    @classmethod
    def of(cls, raw: object) -> Settings:
        """Settings from the content of a configuration file; unknown items are errors."""
        if raw is None:
            return cls()
        if not isinstance(raw, dict):
            raise ValueError("settings must be a mapping")
        flat = {}
        sectioned = {name for names in cls.SECTIONS.values() for name in names}
        top = {f.name for f in fields(cls)} - sectioned
        for key, value in raw.items():
            if key in cls.SECTIONS:
                if not isinstance(value, dict):
                    raise ValueError(f"{key} must be a mapping")
                if unknown := sorted(set(value) - set(cls.SECTIONS[key])):
                    raise ValueError(f"unknown items in {key}: {', '.join(unknown)}")
                flat |= value
            elif key in top:
                flat[key] = value
            else:
                raise ValueError(f"unknown item: {key!r}")
        return replace(cls(), **flat)


Settings.__annotations__.pop("SECTIONS", None)


def span(records: DataFrame) -> tuple[datetime | None, datetime | None]:
    return tuple(records.agg(F.min("ts"), F.max("ts")).first())


def calendar(first: datetime, last: datetime, incident: datetime, records: DataFrame) -> DataFrame:
    """Every day from the first record to the last one or the incident."""
    end = max(last.date(), incident.date())
    return records.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first.date()), F.lit(end))).alias("day"))


def day_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("records"), F.count(F.when(F.col("severity") >= ERROR, 1)).alias("errors"))


def daily_profile(records: DataFrame, incident: datetime, settings: Settings = Settings()) -> DataFrame:
    """One row per day: records, errors, full, incident_day, business, error_spike, observed.

    A day is full if the records' span covers it but for a margin.  Full days with records
    before the incident are measured by their medians.  Windows see one row per day.
    """
    first, last = span(records)
    if first is None:
        return records.sparkSession.createDataFrame([], "day date, records long, errors long, full boolean, incident_day boolean, business boolean, error_spike boolean, observed boolean")
    margin = timedelta(minutes=settings.full_day_margin_minutes)
    midnight = F.col("day").cast("timestamp_ntz")
    days = calendar(first, last, incident, records).join(day_counts(records), "day", "left").fillna(0, ["records", "errors"])
    days = days.withColumn("full", (midnight >= ntz(first - margin)) & (midnight <= ntz(last + margin - timedelta(days=1))))
    days = days.withColumn("incident_day", F.col("day") == F.lit(incident.date()))
    measured = F.col("full") & (F.col("records") > 0) & (F.col("day") < F.lit(incident.date()))
    everything = Window.partitionBy()
    days = days.withColumn("_median", F.median(F.when(measured, F.col("records"))).over(everything))
    days = days.withColumn("business", measured & (F.col("records") >= settings.business_day_ratio * F.col("_median")))
    days = days.withColumn("_errors", F.median(F.when(F.col("business"), F.col("errors"))).over(everything))
    spike = (F.col("errors") >= settings.error_spike_min) & (F.col("errors") > settings.error_spike_ratio * F.greatest("_errors", F.lit(1.0)))
    days = days.withColumn("error_spike", F.coalesce(measured & spike, F.lit(False))).withColumn("business", F.coalesce("business", F.lit(False)))
    observed = (F.col("records") > 0) & (F.col("full") | F.col("incident_day"))
    return days.drop("_median", "_errors").withColumn("observed", observed)


def change_points(records: DataFrame, days: DataFrame, settings: Settings = Settings(), key: str = "template") -> DataFrame:
    """Templates that begin or cease to appear: key, kind, day, before_present, before_days, after_present, after_days.

    ``days`` (one row per day) is numbered and joined to the counts of each template and day.
    """
    numbered = days.where("observed").select("day", "incident_day", (F.row_number().over(Window.orderBy("day")) - 1).alias("i"))
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("_inc", F.max(F.when(F.col("incident_day"), F.col("i"))).over(Window.partitionBy()))
    present = records.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("_n"))
    seen = present.join(numbered, "day").groupBy(key).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("present"), F.max("n").alias("n"), F.max("_inc").alias("_inc"))
    least = settings.min_history_days
    gone_at = F.col("last") + 1
    missing_others = F.col("n") - gone_at - F.when(F.col("_inc") >= gone_at, 1).otherwise(0)
    appears = (F.col("n") > least) & (F.col("first") >= least) & (F.col("present") >= settings.appear_persist_ratio * (F.col("n") - F.col("first")))
    vanishes = (F.col("n") > least) & (gone_at >= least) & (missing_others > 0) & (F.col("present") >= settings.vanish_presence_ratio * gone_at)
    kind = F.when(appears, APPEAR).when(vanishes, VANISHED)
    found = seen.withColumn("kind", kind).where("kind IS NOT NULL")
    came = F.col("kind") == APPEAR
    found = found.select(
        key,
        "kind",
        F.when(came, F.col("first")).otherwise(gone_at).alias("i"),
        F.when(came, 0).otherwise(F.col("present")).cast("long").alias("before_present"),
        F.when(came, F.col("first")).otherwise(gone_at).cast("long").alias("before_days"),
        F.when(came, F.col("present")).otherwise(0).cast("long").alias("after_present"),
        F.when(came, F.col("n") - F.col("first")).otherwise(F.col("n") - gone_at).cast("long").alias("after_days"),
    )
    return found.join(numbered.select("i", "day"), "i").drop("i")


def first_change(points: DataFrame, incident: datetime) -> date | None:
    return points.where(F.col("day") < F.lit(incident.date())).agg(F.min("day")).first()[0]


def with_candidates(days: DataFrame, changed: date | None, incident: datetime) -> DataFrame:
    """``days`` with after_change and normal_candidate: full days with records, before the incident and the first change, without a spike."""
    counted = (F.col("day") < F.lit(incident.date())) & F.col("full") & (F.col("records") > 0)
    after = counted & (F.col("day") >= F.lit(changed)) if changed else F.lit(False)
    return days.withColumn("after_change", after).withColumn("normal_candidate", counted & ~after & ~F.col("error_spike"))


def expected_counts(records: DataFrame, periods: list[Period], start: datetime, end: datetime, key: str = "template") -> DataFrame:
    """(key, expected): mean count of a template in the periods (ends included), scaled to the window's length.

    A few periods are a conditional count each, in one pass over the records they cover.  Many
    are cut where one begins or ends: a record is counted in the piece it is in, and a piece has
    the weight of all periods that cover it.
    """
    length = (end - start).total_seconds() / 60
    if len(periods) > FEW_PERIODS:
        return _expected_by_pieces(records, periods, length, key)
    covers, counts = F.lit(False), []
    for i, p in enumerate(periods):
        inside = F.col("ts").between(ntz(p.start), ntz(p.end))
        covers = covers | inside
        scale = length / p.minutes / len(periods) if p.minutes > 0 else 0.0
        counts.append((F.count(F.when(inside, 1)) * F.lit(scale)).alias(f"_p{i}"))
    if not periods:
        return records.select(key, F.lit(0.0).alias("expected")).where("false")
    summed = records.where(covers).groupBy(key).agg(*counts)
    return summed.select(key, sum((F.col(f"_p{i}") for i in range(1, len(periods))), F.col("_p0")).alias("expected"))


def _expected_by_pieces(records: DataFrame, periods: list[Period], length: float, key: str) -> DataFrame:
    moves: dict[int, list[tuple[float, int]]] = {}
    for p in periods:
        scale = length / p.minutes / len(periods) if p.minutes > 0 else 0.0
        moves.setdefault(micros(p.start), []).append((scale, 1))
        moves.setdefault(micros(p.end) + 1, []).append((-scale, -1))
    bounds, weights, weight, covering = sorted(moves), [], Fraction(0), 0
    for at in bounds:
        for scale, one in moves[at]:
            weight, covering = weight + Fraction(scale), covering + one
        # No period over it: no weight, and its records don't count as seen.
        weights.append(str(float(weight)) if covering else "")
    table = F.split(F.lit(",".join(weights)), ",")
    placed = records.where(F.col("ts").between(ntz(min(p.start for p in periods)), ntz(max(p.end for p in periods))))
    placed = placed.select(key, (place_among(micros_of(F.col("ts")), bounds) - 1).cast("int").alias("_piece"))
    counts = placed.where(F.get(table, F.col("_piece")) != "").groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    # A key has as many rows at most as there are pieces; they are summed in order, so that reruns agree.
    own = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_piece", (F.col("_n") * F.get(table, F.col("_piece")).cast("double")).alias("v")))).alias("_own"))
    return own.select(key, F.aggregate("_own", F.lit(0.0), lambda total, s: total + s["v"]).alias("expected"))


def verdict(expected: Column, observed: Column, settings: Settings = Settings()) -> Column:
    """The first rule that fits; null if none does."""
    return (
        F.when((expected == 0) & (observed > 0), NEW)
        .when((observed == 0) & (expected >= settings.vanished_min_expected), VANISHED)
        .when((observed >= settings.surge_min_count) & (observed >= settings.surge_ratio * F.greatest(expected, F.lit(1.0))), SURGE)
        .when((expected >= settings.drop_min_expected) & (observed <= settings.drop_ratio * expected), DROP)
    )


def comparisons(templates: DataFrame, expected: DataFrame, settings: Settings = Settings(), key: str = "template") -> DataFrame:
    """(key, kind, expected, observed) of the templates that got a verdict; ``templates`` has window_count of every template."""
    both = templates.select(key, F.col("window_count").alias("observed")).join(expected, key, "left").fillna(0.0, ["expected"])
    return both.withColumn("kind", verdict(F.col("expected"), F.col("observed"), settings)).where("kind IS NOT NULL").select(key, "kind", "expected", "observed")


def verdict_counts(found: DataFrame) -> DataFrame:
    """(kind, n) of every verdict, also of those that none got."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in VERDICTS], "kind string")
    return kinds.join(found.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])


@dataclass
class Selection:
    """The periods to compare with, how they were chosen, and what to tell the user."""

    how: str
    periods: list[Period]
    reason: str
    warnings: list[str] = field(default_factory=list)


def select_periods(days: DataFrame, first: datetime | None, incident: datetime, start: datetime, end: datetime, settings: Settings = Settings()) -> Selection:
    """The nearest business day before the incident that is a candidate, else any business day, else the incident day before the window.

    Days are one row each, so they are decided on the driver.
    """
    business = days.where(F.col("business") & (F.col("day") < F.lit(incident.date()))).select("day", "normal_candidate").orderBy("day").collect()
    if clean := [d.day for d in business if d.normal_candidate]:
        return Selection("auto", [same_hours(clean[-1], incident.date(), start, end)], "nearest business day before any change point, without a spike of errors")
    if business:
        return Selection("auto", [same_hours(business[-1].day, incident.date(), start, end)], "nearest business day; it may not be normal", ["no normal day among the logs; ask for earlier ones"])
    if first is not None:
        from_ = max(first, datetime.combine(incident.date(), datetime.min.time()))
        if (start - from_).total_seconds() / 60 >= settings.fallback_min_minutes:
            return Selection("fallback", [Period(from_, start, "before the window")], "no earlier day; the incident's day before the window", ["no logs from before the incident's day"])
    return Selection("none", [], "no period to compare with", ["no comparison with a normal period"])


def manual_periods(periods: list[Period], reason: str | None, first: datetime | None, last: datetime | None, start: datetime, end: datetime) -> Selection:
    """Periods that the caller named, with warnings where they hold no logs, overlap the window or have no reason."""
    warnings = [] if reason else ["a baseline without a reason"]
    for p in periods:
        if first is None or p.end < first or p.start > last:
            warnings.append(f"no logs in the period {p.label}")
        elif p.start < end and start < p.end:
            warnings.append(f"the period {p.label} overlaps the window")
    return Selection("manual", periods, reason or "not stated", warnings)
