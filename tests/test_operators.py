"""Operators on small tables: the cases that the scenario doesn't have."""

import gzip
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.functions import text as texts
from logtide.functions import times
from logtide.operators import baseline, blocks, drain, intervals, noise, ordering, parse, records, search, templates
from logtide.sources import logfiles
from logtide.streaming import counts as streaming

DAY = datetime(2026, 9, 1)


# ---- files and parsing ----

MINI = """=== header ===
2026-09-30 10:00:00.5 WARNING [pool] waiting  \t
2026/09/30T01:00:01,123456789Z ERROR [job] failed
java.lang.IllegalStateException: x
\tat a.b.C(C.java:1)

2026-09-30 10:00:02 VERBOSE [x] odd level
2026-13-40 10:00:03 INFO [x] bad time
2026-09-30 10:00:04+0000 INFO no component
"""


def parsed(spark, folder, formats=(parse.LogFormat(),), **options):
    listed = logfiles.listed([str(folder)], formats)
    found, stats = parse.parsed(logfiles.lines(spark, listed, formats), list(formats), **options)
    return found.orderBy("file_order", "lineno").collect(), {f.file: f for f in logfiles.with_empty(stats, listed).collect()}


def test_parse_mini(spark, tmp_path):
    (tmp_path / "mini.log").write_text(MINI)
    rows, stats = parsed(spark, tmp_path)
    assert [(r.lineno, r.level, r.component, r.message) for r in rows] == [(2, "WARN", "pool", "waiting"), (3, "ERROR", "job", "failed"), (7, "INFO", "x", "odd level"), (9, "INFO", "", "no component")]
    assert [r.ts for r in rows] == [datetime(2026, 9, 30, 10, 0, 0, 500000), datetime(2026, 9, 30, 10, 0, 1, 123456), datetime(2026, 9, 30, 10, 0, 2), datetime(2026, 9, 30, 19, 0, 4)]
    assert rows[1].extra == ["java.lang.IllegalStateException: x", "\tat a.b.C(C.java:1)"] and rows[2].extra == ["2026-13-40 10:00:03 INFO [x] bad time"]
    s = stats["mini.log"]
    assert (s.total_lines, s.records, s.continuation_lines, s.unparsed_lines, s.bad_timestamps, s.unknown_levels) == (9, 4, 3, 1, 1, {"VERBOSE": 1})


def test_files(spark, tmp_path):
    line = "2026-09-30 10:00:00 INFO [a] ok\n"
    (tmp_path / "a.log").write_text("")
    (tmp_path / "_b.log").write_text(line)
    (tmp_path / ".c.log").write_text(line)
    (tmp_path / "d.log.1.gz").write_bytes(gzip.compress(line.encode()))
    (tmp_path / "e.txt").write_bytes(line.encode("utf-16"))
    (tmp_path / "f.log").write_bytes(b"\xef\xbb\xbf" + line.encode())
    (tmp_path / "g.log").write_bytes(line.encode() + b"\xff\xff\x81")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h x.LOG").write_text(line)
    (tmp_path / "i.bak").write_text(line)
    rows, stats = parsed(spark, tmp_path)
    assert sorted(stats) == ["_b.log", "a.log", "d.log.1.gz", "e.txt", "f.log", "g.log", "sub/h x.LOG"]
    assert {f: s.records for f, s in stats.items()} == {f: int(f != "a.log") for f in stats}
    assert [stats[f].encoding for f in ("e.txt", "f.log", "g.log", "a.log")] == ["utf-16", "utf-8", "utf-8 (replaced)", ""]
    assert {r.alias for r in rows} == {"_b", "d", "e", "f", "g", "h x"}
    assert [x[1] for x in logfiles.listed([str(tmp_path / "i.bak"), str(tmp_path / "i.bak")], [parse.LogFormat()])] == ["i.bak"]
    with pytest.raises(FileNotFoundError):
        logfiles.listed([str(tmp_path / "none")], [parse.LogFormat()])


def test_formats_and_offsets(spark, tmp_path):
    own = parse.LogFormat("own", ("app*.log",), (r"^(?P<level>\w+)\|(?P<ts>[^|]+)\|(?P<message>.*)$",), "dd.MM.yyyy HH:mm:ss", "UTC", clock_offset_seconds=1.5)
    (tmp_path / "app1.log").write_text("ERR|30.09.2026 01:00:00|one\n")
    (tmp_path / "other.log").write_text("2026-09-30 10:00:00 INFO two\n")
    rows, _ = parsed(spark, tmp_path, (own, parse.LogFormat()), offsets={"other": -60})
    assert [(r.level, r.ts, r.message) for r in rows] == [("ERROR", datetime(2026, 9, 30, 10, 0, 1, 500000), "one"), ("INFO", datetime(2026, 9, 30, 9, 59), "two")]
    with pytest.raises(ValueError):
        parse.LogFormat(patterns=("(?P<ts>.*)",))


def test_many_continuations(spark):
    lines = spark.range(1, 3001).select(F.lit("f").alias("file"), F.col("id").alias("lineno"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"), F.col("id").isin(2, 1000, 2999).alias("is_head"))
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = parse.attached(lines).orderBy("lineno").collect()
        assert [(r.lineno, len(r.extra), r.extra_dropped) for r in rows] == [(2, 300, 697), (1000, 300, 1698), (2999, 1, 0)]
        assert rows[0].extra[:2] == ["line 3", "line 4"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stack_lines(spark):
    lines = ["\tat x.Y", "Caused by: z", "Traceback (most recent call last)", '  File "x"', "  ... 3 more", "---> inner", "a.b.FooException: x", "ValueError", "plain", "atlas", "Errors found"]
    got = spark.createDataFrame([(i, [x]) for i, x in enumerate(lines)], "i int, extra array<string>").select("i", records.has_stack(F.col("extra")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [True] * 8 + [False] * 3
    late = spark.createDataFrame([(["x"] * 20 + ["\tat x.Y"],), (None,)], "extra array<string>").select(records.has_stack(F.col("extra")).alias("s")).collect()
    assert [r.s for r in late] == [False, False]


# ---- order ----


def test_running(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.running for r in ordering.running_sum(df, ["g", "id"], "v", "test", ["g"]).collect()}
    assert got == {i: sum(j % 7 for j in range(i % 3, i + 1, 3)) for i in range(1000)}
    assert sorted(r.place for r in ordering.ranked(df, ["v", "id"], "test").collect()) == list(range(1000))
    assert ordering.ranked(df.where("false"), ["id"], "test").count() == 0


# ---- templates ----


def mined(spark, messages):
    df = spark.createDataFrame(list(enumerate(messages)), "i long, message string")
    return {r.message: r.template for r in drain.mine(df, ["i"]).collect()}


def test_drain(spark):
    got = mined(spark, ["Job J-1 done in 5 ms", "Job J-22 done in 7 ms", "user anna logged in", "user bob logged in", "user bob logged out now", "  ", "C:\\tmp\\a.txt missing", "http://x/y failed"])
    assert got["Job J-1 done in 5 ms"] == "Job <JOBID> done in <NUM> ms"
    assert got["user anna logged in"] == got["user bob logged in"] == "user <*> logged in"
    assert got["user bob logged out now"] == "user bob logged out now"
    assert got["  "] == "<EMPTY>" and got["C:\\tmp\\a.txt missing"] == "<PATH> missing" and got["http://x/y failed"] == "<URL> failed"


def test_drain_children(spark):
    """First tokens beyond a node's children share one leaf, and so can share a template."""
    got = mined(spark, [f"word{chr(97 + i // 26)}{chr(97 + i % 26)} same tail here".replace("word", "w") for i in range(120)])
    assert len({t for t in got.values() if "<*>" not in t}) == 99 and len(set(got.values())) == 100


def test_masks(spark):
    cases = {"at 10.2.3.4:80 and 0xFF": "at <IP> and <HEX>", "id 123e4567-e89b-12d3-a456-426614174000": "id <UUID>", "D: full": "<DRIVE> full", "/var/log/x.log": "<PATH>", "\\\\srv\\share": "<PATH>", "a1 -5.5 7x": "a1 <NUM> 7x"}
    rows = spark.createDataFrame([(k,) for k in cases], "m string").select("m", texts.masked(F.col("m")).alias("t")).collect()
    assert {r.m: r.t for r in rows} == cases


def test_numbering(spark):
    df = spark.createDataFrame([(i, f"t{i % 120:03d}") for i in range(240)], "i long, template string")
    rows = {r.template: r.template_id for r in templates.numbered(df, ["i"]).collect()}
    assert rows["t000"] == "T001" and rows["t119"] == "T120"
    assert {r.template_id for r in templates.numbered(df.where("i < 3"), ["i"]).collect()} == {"T01", "T02", "T03"}


# ---- baseline ----


def test_change_points(spark):
    """Steady, vanishing, appearing, one-off and too-early templates over ten days, the last the incident's."""
    present = {"steady": range(10), "gone": range(6), "came": range(5, 10), "once": [4], "early": range(1, 10), "today": [9], "missing today": range(9)}
    rows = [(DAY + timedelta(days=d, hours=h), 2, k) for k, days in present.items() for d in days for h in (0, 23)]
    rows += [(DAY + timedelta(days=d, hours=h), 2, "steady") for d in range(10) for h in (0, 23)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, severity int, template string")
    days = baseline.daily_profile(df, DAY + timedelta(days=9, hours=12))
    got = {r.template: (r.kind, r.day, r.before_present, r.before_days, r.after_present, r.after_days) for r in baseline.change_points(df, days).collect()}
    assert got == {
        "gone": ("VANISHED", date(2026, 9, 7), 6, 6, 0, 4),
        "came": ("APPEAR", date(2026, 9, 6), 0, 5, 5, 5),
        "today": ("APPEAR", date(2026, 9, 10), 0, 9, 1, 1),
    }


def test_settings():
    s = baseline.Settings.of({"business_day_ratio": 0.7, "compare": {"surge_ratio": 9}})
    assert (s.business_day_ratio, s.surge_ratio, s.drop_ratio) == (0.7, 9, 0.2) and baseline.Settings.of(None) == baseline.Settings()
    for bad in ([], {"nothing": 1}, {"compare": {"x": 1}}, {"compare": 3}, {"surge_ratio": 1}):
        with pytest.raises(ValueError):
            baseline.Settings.of(bad)


def test_verdicts(spark):
    cases = [(0.0, 1, "NEW"), (5.0, 0, "VANISHED"), (4.9, 0, None), (2.0, 10, "SURGE"), (0.5, 10, "SURGE"), (2.1, 10, None), (20.0, 4, "DROP"), (20.0, 5, None), (0.0, 0, None)]
    rows = spark.createDataFrame([(e, n) for e, n, _ in cases], "e double, n long").select(baseline.verdict(F.col("e"), F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == [v for *_, v in cases]


def test_selection(spark):
    at, start, end = DAY + timedelta(days=3, hours=12), DAY + timedelta(days=3, hours=11), DAY + timedelta(days=3, hours=13)

    def days(rows):
        return spark.createDataFrame([(date(2026, 9, d), b, c) for d, b, c in rows], "day date, business boolean, normal_candidate boolean")

    def chosen(rows, first=DAY):
        return baseline.select_periods(days(rows), first, at, start, end)

    assert chosen([(1, True, True), (2, True, True), (3, True, False)]).periods == [times.Period(DAY + timedelta(days=1, hours=11), DAY + timedelta(days=1, hours=13), "2026-09-02")]
    found = chosen([(1, True, False), (2, False, True)])
    assert found.periods[0].start == DAY + timedelta(hours=11) and found.warnings
    assert chosen([]).how == "fallback" and chosen([], start - timedelta(minutes=29)).how == "none" and chosen([], None).how == "none"


# ---- noise ----


def test_noise(spark):
    rules = noise.rules_of([{"template": "LDAP  <*> (x)", "reason": "r", "versions": "5.*"}, {"template": "<*>", "reason": "all", "versions": ["6.*"]}])
    df = spark.createDataFrame([("LDAP a\tb (x)",), ("LDAP   b (x)  ",), ("LDAP b",)], "text string")
    assert [r.noise_reason for r in noise.with_noise(df, rules, "5.2").collect()] == ["r", "r", None]
    assert [r.noise_reason for r in noise.with_noise(df, rules).collect()] == ["r", "r", "all"]
    for bad in ({}, [{}], [{"template": "x"}]):
        with pytest.raises(ValueError):
            noise.rules_of(bad)
    assert noise.rules_of(None) == []


def test_many_rules(spark, monkeypatch):
    """Rules that are looked up say what rules in one expression say, in the order of the list."""
    import random

    assert noise.anchors(["a bb <*>", "a cc <*>x", "<*> <*>", "x\ty", "a"]) == ["bb", "cc", None, None, "a"]
    rng = random.Random(8)
    words = ["up", "down", "<*>", "x<*>", "(a", "b)", "1.5", "<*>%"]
    rules = [noise.Rule(" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))), f"r{i}") for i in range(90)]
    rules = [r for r in rules if sum("<*>" in w for w in r.template.split(" ")) < 2] + [noise.Rule("<*>p", "no word of its own")]
    rows = [(" ".join(rng.choice(["up", "down", "xy", "(a", "b)", "1.5", "9%", "z"]) for _ in range(rng.randint(0, 4))),) for _ in range(400)] + [(None,), ("up\tdown",), ("  up  ",)]
    df = spark.createDataFrame(rows, "text string").withColumn("_text", F.lit(1)).withColumn("noise_reason", F.lit("old"))
    want = sorted(map(tuple, noise.with_noise(df, rules).collect()), key=str)
    monkeypatch.setattr(noise, "FEW_RULES", 0)
    for most in (100_000, 0):
        monkeypatch.setattr(noise, "BROADCAST_TEXTS", most)
        assert sorted(map(tuple, noise.with_noise(df.drop("_text"), rules).withColumn("_t", F.lit(1)).select("text", "_t", "noise_reason").collect()), key=str) == want
    assert len({r[2] for r in want}) > 10
    many = noise.with_noise(df.drop("_text"), [noise.Rule(f"word{i} <*>", "r") for i in range(5_000)])
    assert len(many._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_many_periods(spark, monkeypatch):
    """Periods that are looked up, and those in pieces, say what one condition each says."""
    import random
    from datetime import timedelta



    rng = random.Random(9)
    day = datetime(2025, 3, 1)
    for n in (1, 2, 7, 40):
        periods = []
        for _ in range(n):
            start = day + timedelta(minutes=rng.randrange(600))
            periods.append(times.Period(start, start + timedelta(minutes=rng.choice([0, 1, 5, 60]))))
        rows = [(i % 3, day + timedelta(seconds=30 * i)) for i in range(1_400)]
        df = spark.createDataFrame(rows, "template int, ts timestamp_ntz")
        out = []
        for few in (64, 0):
            monkeypatch.setattr(times, "FEW_PERIODS", few)
            monkeypatch.setattr(baseline, "FEW_PERIODS", few)
            inside = sorted(r.ts for r in df.where(times.within_any(F.col("ts"), periods)).collect())
            expected = sorted((r.template, round(r.expected, 9)) for r in baseline.expected_counts(df, periods, day, day + timedelta(hours=2)).collect())
            out.append((inside, expected))
        assert out[0] == out[1]


def test_suspended(spark):
    t = spark.createDataFrame([(k, "r" if k != "clean" else None) for k in ("surge", "new", "few", "came", "quiet", "clean")], "template string, noise_reason string")
    found = spark.createDataFrame([("surge", "SURGE", 20), ("new", "NEW", 5), ("few", "NEW", 4), ("clean", "SURGE", 20), ("came", "DROP", 0)], "template string, kind string, observed long")
    points = spark.createDataFrame([("came", "APPEAR"), ("surge", "APPEAR"), ("quiet", "VANISHED")], "template string, kind string")
    got = {r.template: (r.suspended, r.is_noise) for r in noise.suspended(t, found, points).collect()}
    assert got == {"surge": ("SURGE", False), "new": ("NEW", False), "few": (None, True), "came": ("APPEAR", False), "quiet": (None, True), "clean": (None, False)}


# ---- blocks ----


def test_blocks(spark):
    def made(positions, before, after, cap, length):
        df = spark.createDataFrame([(p,) for p in positions], "position long")
        return sorted((r.lo, r.hi, r.triggers) for r in blocks.capped(df, before, after, cap, length).collect())

    assert [x[:2] for x in made([6, 9, 30], 2, 2, 100, 31)] == [(4, 11), (28, 30)]
    runs = made(range(40), 2, 2, 5, 40)
    assert all(hi - lo < 5 for lo, hi, _ in runs) and [t for *_, ts in runs for t in ts] == list(range(40))
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))
    assert [x[:2] for x in made([5], 10, 10, 3, 50)] == [(0, 15)] and made([], 2, 2, 9, 0) == []


def test_blocks_against_walk(spark):
    import random

    rng = random.Random(4)
    positions = sorted(rng.sample(range(1500), 500))
    expected, lo, hi, n = [], 0, -1, 0
    for p in positions:
        reach = min(1499, p + 3)
        if n and (p <= hi or reach - lo < 9 and p - 3 <= hi + 1):
            n, hi = n + 1, reach if reach - lo < 9 else hi
            continue
        if n:
            expected.append((lo, hi, n))
        lo, hi, n = max(0, p - 3, hi + 1 if n else 0), reach, 1
    expected.append((lo, hi, n))
    df = spark.createDataFrame([(p,) for p in rng.sample(positions, 500)], "position long")
    assert sorted((r.lo, r.hi, len(r.triggers)) for r in blocks.capped(df, 3, 3, 9, 1500).collect()) == expected


def walked(positions, before, after, cap, length):
    """Blocks by one walk over all triggers."""
    out, lo, hi = [], 0, -1
    for p in positions:
        reach = min(length - 1, p + after)
        if out and (p <= hi or reach - lo < cap and p - before <= hi + 1):
            hi = reach if reach - lo < cap else hi
            out[-1] = (lo, hi, [*out[-1][2], p])
            continue
        lo, hi = max(0, p - before, hi + 1 if out else 0), reach
        out.append((lo, hi, [p]))
    return out


def test_blocks_of_any_settings():
    """A walk from where positions are free, and where it leads to, for all settings."""
    import random

    rng = random.Random(5)
    for _ in range(3_000):
        length = rng.randint(1, 60)
        positions = sorted(rng.sample(range(length), rng.randint(0, length)))
        before, after, cap = rng.randint(0, 5), rng.randint(0, 5), rng.randint(1, 30)
        walk = blocks.Walk(positions, before, after, cap, length)
        expected = walked(positions, before, after, cap, length)
        assert list(walk.blocks(0, length)) == expected
        until = rng.randint(0, length)
        for free, found in zip(range(length), walk.exits(range(length), until), strict=True):
            own = list(walk.blocks(free, until))
            assert found == (own[-1][1] + 1 if own else free)


def test_blocks_of_one_run_in_ranges(spark, monkeypatch):
    """A run of triggers that all touch spreads over ranges."""
    import random

    monkeypatch.setattr(blocks, "CHUNK_POSITIONS", 32)
    rng = random.Random(6)
    for cap, share in ((5, 1.0), (9, 0.7), (40, 0.9), (7, 0.05)):
        positions = [p for p in range(1_000) if rng.random() < share and not 400 < p < 470]
        df = spark.createDataFrame([(p,) for p in positions], "position long")
        found = sorted((r.lo, r.hi, r.triggers) for r in blocks.capped(df, 2, 3, cap, 1_000).collect())
        assert found == walked(positions, 2, 3, cap, 1_000)


def test_block_selection(spark):
    b = spark.createDataFrame([(0, 5, [1, 2]), (10, 15, [11]), (20, 25, [21, 22])], "lo long, hi long, triggers array<long>")
    t = spark.createDataFrame([(1, "a"), (2, "b"), (11, "a"), (21, "b"), (22, "c")], "position long, template string")
    assert [(r.block, r.lo) for r in blocks.selected(b, t, 9).orderBy("lo").collect()] == [("E01", 0), ("E02", 20)]
    assert blocks.selected(b, t, 1).count() == 1


# ---- times and search ----


def test_time_arguments():
    at = datetime(2026, 9, 30, 10, 40)
    cases = {
        "2026-09-30 10:42:05.907": (datetime(2026, 9, 30, 10, 42, 5, 907000), timedelta(milliseconds=1)),
        "2026-09-30 10:42": (datetime(2026, 9, 30, 10, 42), timedelta(minutes=1)),
        "2026/09/30": (datetime(2026, 9, 30), timedelta(days=1)),
        "9-30 10:42:05": (datetime(2026, 9, 30, 10, 42, 5), timedelta(seconds=1)),
        "10:42": (datetime(2026, 9, 30, 10, 42), timedelta(minutes=1)),
    }
    for text, (low, unit) in cases.items():
        assert times.time_bound(text, at, False) == low and times.time_bound(text, at, True) == low + unit
    for bad in ("soon", "10", "25:00", "2026-13-01"):
        with pytest.raises(ValueError):
            times.time_bound(bad, at, False)


def test_widths():
    assert times.bucket_width("30s") == timedelta(seconds=30) and times.bucket_width("2 hours") == timedelta(hours=2)
    assert times.fitting_width(timedelta(hours=1), 120) == timedelta(seconds=30)
    assert times.fitting_width(timedelta(days=1), 120, timedelta(minutes=1)) == timedelta(minutes=15)
    assert times.floored(DAY + timedelta(hours=5, minutes=7), timedelta(minutes=5)) == DAY + timedelta(hours=5, minutes=5)
    assert times.floored(DAY + timedelta(hours=5), timedelta(days=7)) == DAY
    for bad in ("0s", "x", "5"):
        with pytest.raises(ValueError):
            times.bucket_width(bad)
    with pytest.raises(ValueError):
        times.fitting_width(timedelta(days=5000), 120)


def test_periods():
    start, end = datetime(2026, 9, 30, 10, 10), datetime(2026, 9, 30, 11, 10)
    day, span = times.compared_periods(["2026-09-23", "2026-09-30 08:00/2026-09-30 10:00"], start, end)
    assert (day.start, day.end, span.minutes) == (datetime(2026, 9, 23, 10, 10), datetime(2026, 9, 23, 11, 10), 120)
    merged = times.merged_periods([times.Period(DAY + timedelta(hours=a), DAY + timedelta(hours=b)) for a, b in ((5, 9), (0, 3), (3, 4), (20, 30))], DAY + timedelta(hours=1), DAY + timedelta(hours=24))
    assert [(p.start.hour, p.hours) for p in merged] == [(1, 3), (5, 4), (20, 4)]
    for bad in ("x", "2026-09-30 10:00/2026-09-30 08:00"):
        with pytest.raises(ValueError):
            times.compared_periods([bad], start, end)
        with pytest.raises(ValueError):
            times.normal_periods([bad])


def test_row_before_and_runs_over_parts(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("at_"), F.lit(1).cast("long").alias("one"))
    table, _ = ordering.range_ordered(df, ["at_"], "rows")
    assert table.select("part").distinct().count() > 1
    assert all(r.before == (r.at_ - 1 if r.at_ else None) for r in ordering.preceded(table, "at_", "before").collect())
    assert all(r.running == r.at_ + 1 for r in ordering.carried(table, "one").collect())


def test_lines_asked_for(spark):
    heads = spark.createDataFrame([("a", n) for n in range(3, 300, 3)] + [("b", 5)], "file string, lineno long")
    asked = spark.createDataFrame([("a", 1), ("a", 3), ("a", 299), ("a", 299), ("b", 4), ("b", 9), ("c", 1)], "file string, lineno long")
    got = {(r.file, r.lineno): r.head_lineno for r in search.records_at(heads, asked).collect()}
    assert got == {("a", 1): None, ("a", 3): 3, ("a", 299): 297, ("b", 4): None, ("b", 9): 5, ("c", 1): None}
    assert search.records_at(heads, asked).count() == 6 and search.records_at(heads.limit(0), asked.limit(0)).count() == 0


def test_endless_continuation(spark):
    lines = spark.range(1, 2001).select(F.lit("a").alias("file"), F.col("id").alias("lineno"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("line"), F.col("id").isin(2, 1990).alias("is_head"))
    got = {r.lineno: (r.extra, r.extra_dropped) for r in parse.attached(lines, most=4).collect()}
    assert got == {2: ([f"x{i}" for i in range(3, 7)], 1983), 1990: ([f"x{i}" for i in range(1991, 1995)], 6)}


def test_intervals(spark):
    rows = [("a", 0, 2), ("a", 2, 3), ("a", 2, 3), ("a", 5, 9), ("a", 6, 7), ("b", 1, 4), (None, 1, 2), (None, 2, 5)]
    df = spark.createDataFrame(rows, "who string, start long, end long")
    got = sorted(((r.who, r.start, r.end) for r in intervals.merged(df, "who").collect()), key=str)
    assert got == sorted([("a", 0, 3), ("a", 5, 9), ("b", 1, 4), (None, 1, 5)], key=str)


@pytest.mark.parametrize("total", [1, 5, 20, 21, 59])
def test_spread(spark, total):
    df = spark.range(total).select("id", F.col("id").alias("ts"))
    for n in (1, 3, 20):
        got = sorted(r.rn for r in search.spread_sample(df, ["ts"], n).collect())
        assert got == (list(range(total)) if total <= n else sorted({i * total // n for i in range(n)}))


def test_counts_add_up(spark):
    df = spark.range(500).select((F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * F.col("id") % 601).cast("int"))).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("template_id"))
    b = search.buckets(DAY, DAY + timedelta(hours=11), 120)
    found = search.count_by_time(df, ["a", "b"], DAY, DAY + timedelta(hours=11), b)
    assert found.count() == 2 * b.count and found.agg(F.sum("n")).first()[0] == 500
    runs = search.zero_runs(found).orderBy("first_bucket").collect()
    assert sum(r.total for r in runs) == 500 and sum(r.last_bucket - r.first_bucket + 1 for r in runs) == b.count


def test_resolved_file():
    files = [("a/x.log", "x"), ("b/x.log", "x"), ("y.log", "y")]
    assert search.resolved_file("a/x.log", files) == "a/x.log" and search.resolved_file("y", files) == "y.log"
    for bad in ("x.log", "x", "z"):
        with pytest.raises(ValueError):
            search.resolved_file(bad, files)
    assert search.template_ids(["t07, T12", "t07"]) == ["T07", "T12"]


def test_stream_counts(spark, tmp_path):
    df = spark.range(60).select((F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), (F.col("id") % 2).cast("string").alias("template_id"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streaming.counts(source, "10 minutes", "5 minutes").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("counted").collect()
    # Windows end before the latest record less the delay: five of six.
    assert len(rows) == 10 and sum(r.n for r in rows) == 50


# ---- mining, against a miner that reads one record after the other ----


def mined_by_definition(forms, similarity=0.4, most_children=100, most_clusters=2048):
    """Template of each record: token lists are compared with every cluster of their leaf, one by one."""
    heads, leaves, where = {}, {}, []
    for form in forms:
        tokens = form.split()
        known = heads.setdefault(len(tokens), [])
        head = tokens[0]
        if any(c in "0123456789" for c in head):
            head = "<*>"
        elif head not in known:
            if len(known) < most_children - 1:
                known.append(head)
            else:
                head = "<*>"
        # In the order in which they opened; what was joined longest ago closes.
        clusters = leaves.setdefault((len(tokens), head), {})
        shares = [(sum(a == b != "<*>" for a, b in zip(c, tokens)) / len(tokens), c.count("<*>"), -i) for i, (c, _) in clusters.items()]
        best = max(shares, default=None)
        if best and best[0] >= similarity:
            c, _ = clusters[-best[2]]
            c[:] = [a if a == b else "<*>" for a, b in zip(c, tokens)]
            clusters[-best[2]] = c, len(where)
        else:
            c = list(tokens)
            if len(clusters) >= most_clusters:
                del clusters[min(clusters, key=lambda i: clusters[i][1])]
            clusters[len(where)] = c, len(where)
        where.append(c)
    return [" ".join(c) for c in where]


def random_messages(n, seed=3):
    import random

    rng = random.Random(seed)
    verbs, things = ["open", "close", "read", "lost", "sent"], [f"thing{c}" for c in "abcdefgh"]
    return [" ".join([rng.choice(["ERROR", "WARN", f"w{rng.randrange(4)}x", "job"]), *(rng.choice(verbs + things) for _ in range(rng.randint(1, 5)))]) for _ in range(n)]


@pytest.mark.parametrize("settings", [drain.Settings(), drain.Settings(most_clusters=3), drain.Settings(similarity=0.7, most_children=3), drain.Settings(similarity=0.8, most_clusters=5)])
def test_strict_mining(spark, settings):
    from dataclasses import replace

    messages = random_messages(500)
    df = spark.createDataFrame(list(enumerate(messages)), "i long, message string")
    got = {r.i: r.template for r in drain.mine(df, ["i"], settings=replace(settings, strict=True, masks=())).collect()}
    assert [got[i] for i in range(len(messages))] == mined_by_definition(messages, settings.similarity, settings.most_children, settings.most_clusters)
    # Without strict, it is the same of the distinct messages.
    distinct = list(dict.fromkeys(messages))
    want = dict(zip(distinct, mined_by_definition(distinct, settings.similarity, settings.most_children, settings.most_clusters)))
    assert {r.i: r.template for r in drain.mine(df, ["i"], settings=replace(settings, masks=())).collect()} == {i: want[m] for i, m in enumerate(messages)}


def test_rows_over_lines_of_documents(spark):
    """Masks and templates of the documents' lines, against Python's masks and a miner that reads one form after the other."""
    import hashlib
    import re
    from collections import Counter

    from logtide.plans import catalogue

    folder = "/root/testdata/sf0.001"
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    lines = [(r.doc_id, i, line) for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()) for i, line in enumerate((r.text or "").split("\n")) if line.strip(" ")]

    def masked(line):
        for pattern, name in texts.MASKS:
            line = re.sub(pattern, f"<{name}>", line)
        return line

    assert {(r.doc_id, r.lineno): r.masked_md5 for r in catalogue.mask_documents(spark, folder).collect()} == {(d, i): md5(masked(line)) for d, i, line in lines}
    forms = [masked(line.strip(" ")) for *_, line in lines]
    assert sum(a != b[2].strip(" ") for a, b in zip(forms, lines)) > 20
    distinct = list(dict.fromkeys(forms))
    template = dict(zip(distinct, mined_by_definition(distinct)))
    assert {r.template_md5: r.n for r in catalogue.drain_documents(spark, folder).collect()} == Counter(md5(template[f]) for f in forms)


def test_mining_of_a_large_leaf():
    """Thousands of forms of one leaf are no longer compared token by token."""
    import time

    leaf, began = drain.Leaf(9), time.perf_counter()
    for i in range(8_000):
        leaf.add(["ERROR", *(f"t{i}-{k}" for k in range(8))])
    assert leaf.count == drain.MOST_CLUSTERS and time.perf_counter() - began < 20


def test_mining_of_the_scenario(spark, tmp_path):
    """Both ways of mining agree on the incident's logs, and with a miner that reads one record after the other."""
    from dataclasses import replace

    from tests.scenario import gateway

    messages = [text.split("\n")[0] for _, _, _, text in sorted(gateway(), key=lambda e: e[0])]
    df = spark.createDataFrame(list(enumerate(messages)), "i long, message string")
    forms = [r.form for r in df.select("i", texts.masked(F.col("message")).alias("form")).orderBy("i").collect()]
    strict = {r.i: r.template for r in drain.mine(df, ["i"], settings=replace(drain.Settings(), strict=True)).collect()}
    usual = {r.i: r.template for r in drain.mine(df, ["i"]).collect()}
    assert [strict[i] for i in range(len(forms))] == mined_by_definition(forms) and strict == usual


@pytest.mark.parametrize(("size", "settings"), [(3, drain.Settings(most_clusters=4)), (5, drain.Settings()), (5, drain.Settings(similarity=0.0)), (5, drain.Settings(similarity=1.1, most_clusters=7)), (6, drain.Settings(similarity=0.5, most_clusters=70)), (300, drain.Settings(similarity=0.2, most_clusters=20))])
def test_mining_in_batches(monkeypatch, size, settings):
    """Batches of any size give what forms give one by one: past the limit of clusters, with more numbers than marks, and when numbers are given anew."""
    import random
    from collections import Counter

    monkeypatch.setattr(drain, "MOST_NAMES", 50)
    rng = random.Random(size)
    # The first token is the leaf's.
    forms = [["job", *(rng.choice(["<*>", "a", "b", f"t{rng.randrange(4)}", f"u{i}-{k}"]) for k in range(size - 1))] for i in range(400)]
    want = mined_by_definition([" ".join(f) for f in forms], settings.similarity, most_clusters=settings.most_clusters)
    for most in (1, 7, 64, 400):
        leaf, got, ended = drain.Leaf(size, settings), [], []
        for i in range(0, len(forms), most):
            got += leaf.add_all(forms[i : i + most], list(range(i, min(i + most, len(forms)))))
            ended += leaf.take_closed()
        ended += leaf.clusters()
        text = {k: t for k, t, _ in ended}
        assert len(text) == len(ended) and [text[k] for k in got] == want
        weights = Counter()
        for i, k in enumerate(got):
            weights[k] += i
        assert weights == {k: n for k, _, n in ended}


@pytest.mark.parametrize("strict", [False, True])
def test_counts_of_templates(spark, strict):
    """Counts are those of the mined records; tokens end at the white space that Python's split() knows, and blanks around them make none."""
    from collections import Counter
    from dataclasses import replace

    messages = [*random_messages(300), "\tat one.two three", "at one.two\u3000three ", "job\x1cread  lost", "\u2003", "\t", "it\u2019s read", "lost\xa0sent\u2028"] * 2
    settings = replace(drain.Settings(most_clusters=5), strict=strict)
    df = spark.createDataFrame(list(enumerate(messages)), "i long, message string")
    forms = [r.form for r in df.select("i", drain.form_of("message", settings).alias("form")).orderBy("i").collect()]
    of = forms if strict else list(dict.fromkeys(forms))
    want = mined_by_definition(of, most_clusters=5)
    per_form = Counter(forms)
    counts = Counter()
    for form, template in zip(of, want, strict=True):
        counts[template] += 1 if strict else per_form[form]
    assert {r.template: r.n for r in drain.counted(df, ["i"], settings=settings).collect()} == counts
    assert Counter(r.template for r in drain.mine(df, ["i"], settings=settings).collect()) == counts


def test_counting_templates_writes_no_records(spark):
    """The row over documents writes distinct forms only, and joins no record to its template."""
    from pathlib import Path

    from logtide.plans import catalogue

    with ordering.scope(spark) as folder:
        found = catalogue.drain_documents(spark, "/root/testdata/sf0.001").collect()
        assert found and {p.name.rsplit("-", 1)[0] for p in Path(folder.removeprefix("file:")).iterdir()} == {"drain-distinct", "drain-heads"}


def test_masks_of_texts_that_need_none(spark):
    """What is looked for before masks are tried is in whatever a mask takes."""
    import random

    rng = random.Random(5)
    cases = ["abcdefab-abcd-abcd-abcd-abcdefabcdef", "a\u0663b \u0663", "D: x", "q:\\", "\\\\srv", "/a/b", "x://y", "plain words", "", None]
    cases += ["".join(rng.choice("aZ09f\u0663:/\\-. <") for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(c,) for c in cases], "m string")
    # One more mask, which takes nothing, has all masks tried.
    rows = df.select(texts.masked(F.col("m")).alias("got"), texts.masked(F.col("m"), (*texts.MASKS, ("(?!)", "NO"))).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.want != c for r, c in zip(rows, cases)) > 500
