"""The query tools, SQL guard, knowledge workflow and command line over the scenario."""

import json
from datetime import date, datetime

import pytest
import yaml

from logtide.functions.times import ArgumentError, normal_periods
from logtide.operators import noise
from logtide.plans import cli, digest, knowledge, render, store
from logtide.plans.tools import Tools
from tests.scenario import DROPPED, REPORTED, RULES, write_logs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    logs, out = write_logs(tmp_path_factory.mktemp("logs")), tmp_path_factory.mktemp("out")
    incident = digest.Incident("HB-77", REPORTED, version="7.4.1")
    render.write(digest.analyse(spark, [str(logs)], incident, rules=noise.rules_of(RULES)), str(out))
    return out


@pytest.fixture(scope="module")
def tools(spark, folder):
    return Tools(spark, str(folder))


def template(tools, start):
    return tools.tables["templates"].where(f"template LIKE '{start}%'").first().template_id


def test_search(tools):
    text = tools.search(["Certificate ends"], level="WARN", high="14:05")
    assert text.splitlines()[0] == "4 records" and "ends in 2 days" in text
    assert tools.search(["ends in [12] days"], regex=True).startswith("2 records")
    text = tools.search(["forwarder.java:140"], low="2025-03-12")
    assert text.startswith(f"{DROPPED} records") and "by template:" in text and len(text.splitlines()) < 40
    assert tools.search(["Forwarder.java:140"], message_only=True).startswith("0 records")
    assert tools.search(["Clock drift"], exclude_noise=True).startswith("0 records")
    assert tools.search(["Handshake refused"], files=["gateway"], limit=5).startswith(f"{DROPPED} records")
    assert "ends in 2 days" in tools.search(["Certificate ends"]).splitlines()[1]
    assert "03-12 14:00:10" in tools.search(["Certificate ends"], descending=True).splitlines()[1]
    for bad in ({"texts": ["("], "regex": True}, {"level": "LOUD"}, {"files": ["x.log"]}, {"low": "11:00", "high": "10:00"}, {"low": "soon"}):
        with pytest.raises(ArgumentError):
            tools.search(**bad)


def test_context(tools):
    line = tools.tables["logs"].where("message LIKE 'Reading R-9000 dropped%'").first()
    text = tools.context(f"gateway.log:{line.lineno + 3}", before=2, after=2)
    assert f"continues the record at gateway.log:{line.lineno}" in text
    assert sum(x.startswith(">> ") for x in text.splitlines()) == 1 and "Forwarder.run" in text
    # The buoy's first refusal comes three seconds later, and is the second record after it.
    merged = tools.context(f"@gateway.log:{line.lineno}", before=3, after=3, merged=True)
    assert "buoy" in merged and len([x for x in merged.splitlines() if "@" in x]) == 7
    with pytest.raises(ArgumentError):
        tools.context("gateway.log:1")
    with pytest.raises(ArgumentError):
        tools.context("nothing")


def test_lines(tools):
    name = template(tools, "Handshake refused")
    for sample in ("first", "last", "spread"):
        assert f"20 of {DROPPED}" in tools.lines(name.lower(), sample=sample)
    assert f"3 of {DROPPED}" in tools.lines(name, limit=3)
    with pytest.raises(ArgumentError):
        tools.lines("T999")


def test_count(tools):
    """From 34.5 to 80.5 seconds after the expiry, each 11.5 seconds: five in the minute from 14:22."""
    name = template(tools, "Handshake refused")
    text = tools.count([name], "1m", "14:10", "14:40")
    assert "03-12 14:22:00\t5" in text and "buckets)" in text
    assert tools.count([name]).splitlines()[-1] == f"total\t{DROPPED}"
    with pytest.raises(ArgumentError):
        tools.count([])


def test_sql(tools):
    text = tools.sql("SELECT level, count(*) AS n FROM logs WHERE severity >= 4 GROUP BY level")
    assert "ERROR" in text
    assert "cut at 5" in tools.sql("SELECT * FROM range(100)", most=5)
    assert tools.sql("WITH t AS (SELECT 1 AS a) SELECT a FROM t").splitlines()[-1] == "1"
    assert "Plan" in tools.sql("EXPLAIN SELECT * FROM logs")
    for bad in (
        "SELECT 1; SELECT 2",
        "INSERT INTO logs SELECT * FROM logs",
        "DROP TABLE logs",
        "SET spark.sql.ansi.enabled=false",
        "CREATE VIEW v AS SELECT 1",
        "SHOW TABLES",
        "CACHE TABLE logs",
        "SELECT TRANSFORM(level) USING 'cat' FROM logs",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT * FROM (SELECT java_method('java.lang.Math', 'abs', 1)) t",
        "SELECT * FROM other",
        "SELECT * FROM logs WHERE seq IN (SELECT a FROM other)",
        "WITH t AS (SELECT * FROM other) SELECT * FROM t",
        "SELECT (SELECT max(a) FROM parquet.`/tmp/x`)",
        "SELECT",
    ):
        with pytest.raises(ArgumentError):
            tools.sql(bad)


def test_sql_functions(tools):
    """Every registered function is allowed or not by what it is; words in texts are no calls."""
    from logtide.plans import sql_guard

    spark = tools.spark
    names = [r.function for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()]
    allowed = {n for n in names if sql_guard.is_allowed(spark, n)}
    assert len(names) > 400 and len(allowed) > 300
    assert {"count", "lower", "regexp_extract", "date_trunc", "row_number", "explode", "transform", "percentile_approx", "to_json", "coalesce"} <= allowed
    never = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "current_user", "session_user", "version", "from_avro", "to_avro", "spark_partition_id"}
    assert not never & allowed
    for name in sorted(never & set(names)):
        with pytest.raises(ArgumentError):
            tools.sql(f"SELECT {name}('a', 'b') FROM logs WHERE lower({name}('a')) = 'x'")
    assert tools.sql("SELECT 'reflect(x) and java_method(y)' AS t FROM logs LIMIT 1").splitlines()[-1].startswith("reflect(x)")
    assert "a" in tools.sql("SELECT row_number() OVER (ORDER BY ts) AS a, CASE WHEN message LIKE 'x%' THEN CAST(1 AS STRING) END FROM logs WHERE ts IN (SELECT max(ts) FROM logs)")
    with pytest.raises(ArgumentError):
        tools.sql("SELECT (SELECT reflect('java.lang.System', 'exit', 0))")
    assert len(tools.sql("SELECT repeat('x', 10000000) AS t")) < 200_000


def test_sql_is_stopped(tools):
    with pytest.raises(ArgumentError, match="stopped"):
        tools.sql("SELECT sum(a.id * b.id % 7) FROM range(10000000) a CROSS JOIN range(10000000) b", seconds=1)


def test_schema_and_calls(tools, folder):
    assert "line_id string" in tools.call("schema")
    with pytest.raises(ArgumentError):
        tools.call("sql", text="SELECT 1; SELECT 2")
    notes = [json.loads(x) for x in (folder / "calls.jsonl").read_text().splitlines()]
    assert [n["status"] for n in notes[-2:]] == ["ok", "refused"]


def test_store_is_versioned(folder, tmp_path):
    assert store.manifest(str(folder / "store"))["version"] == store.VERSION
    with pytest.raises(store.StoreError):
        store.manifest(str(tmp_path))
    (tmp_path / store.MANIFEST).write_text('{"version": 99}')
    with pytest.raises(store.StoreError):
        store.manifest(str(tmp_path))
    assert not store.is_fresh(str(tmp_path), [])


def test_export_round_trip(spark, tools, tmp_path):
    logs = tools.tables["logs"]
    store.export_records(logs, str(tmp_path / "records"))
    back = store.import_records(spark, str(tmp_path / "records"))
    assert back.count() == logs.count() and back.exceptAll(logs.select(back.columns)).count() == 0


def test_knowledge(spark, tools):
    about = store.manifest(tools.folder + "/store")["about"]
    periods = digest.normal_days(about["baseline"])
    found = knowledge.propose(tools.tables["logs"], tools.tables["templates"], periods, ["7.4.*"], "quay 3")
    assert [c["template"].split(":")[0] for c in found["candidates"]] == ["Modem ping lost", "Clock drift ignored"]
    assert "about 6.0 an hour" in found["candidates"][1]["rate"]
    assert "[modem]" in found["candidates"][0]["sample"]
    # Six days until the renewal went off, and the weekend after it.
    assert found["normal_periods"][0] == "2025-03-01 00:00 – 2025-03-07 00:00"
    known, rejected, bad = knowledge.merge(found, [], [], date(2025, 4, 1))
    assert bad and not known
    found["candidates"][0] |= {"decision": "register", "reason": "asleep between passes", "code": "Modem.java:10"}
    found["candidates"][1] |= {"decision": "reject", "reject_reason": "may matter"}
    known, rejected, bad = knowledge.merge(found, [], [], date(2025, 4, 1))
    assert not bad and len(known) == len(rejected) == 1 and known[0]["versions"] == ["7.4.*"]
    again = knowledge.propose(tools.tables["logs"], tools.tables["templates"], periods, ["7.4.1"], "quay 3", known, rejected)
    assert [s["why"] for s in again["skipped"]] == ["KNOWN", "REJECTED"] and not again["candidates"]
    found["candidates"][1] = found["candidates"][1] | {"decision": "register", "reason": "normal", "code": "Clock.java:3"}
    known, rejected, bad = knowledge.merge(found, known, rejected, date(2025, 4, 2))
    assert not bad and len(known) == 2 and not rejected
    with pytest.raises(ArgumentError):
        knowledge.propose(tools.tables["logs"], tools.tables["templates"], normal_periods(["2020-01-01"]), ["*"], "x")


def test_dictionary_checks():
    good = {"template": "Modem ping lost: <*>", "reason": "r"}
    assert knowledge.problems([good]) == []
    bad = [{"reason": "r"}, {"template": "x <*>", "reason": "r"}, {"template": "long enough text"}, good, good, good | {"generated_by": knowledge.GENERATED, "versions": ["1"]}]
    assert len(knowledge.problems(bad)) == 7
    assert len(knowledge.problems([good | {"versions": "1.*"}, "text", None, good | {"versions": ["2"], "reason": " "}])) == 4
    assert knowledge.usual_versions("5.2.3") == ["5.2.*"] and knowledge.usual_versions("5") == ["5"] and knowledge.usual_versions(None) is None
    assert knowledge.overlap(["5.2.*"], ["5.2.3"]) and knowledge.overlap(["5.2.3"], ["5.2.*"]) and not knowledge.overlap(["4.*"], ["5.2.3"])


def test_merge_is_all_or_nothing():
    """Every problem of a proposal is told, and none of it is taken."""
    about = {"template": "A template that repeats <*>", "decision": "register", "reason": "r", "code": ""}
    proposal = {"source": " ", "versions": ["1"], "candidates": [about, about | {"decision": "maybe"}, about | {"decision": "reject"}, about | {"decision": ""}]}
    known, rejected, bad = knowledge.merge(proposal, [{"template": "old"}], [], date(2025, 4, 1))
    assert known == [{"template": "old"}] and rejected == [] and len(bad) == 5
    one = {"source": "s", "versions": ["1"], "candidates": [about | {"code": "c", "rate": "1 an hour"}, about | {"decision": ""}]}
    assert len(knowledge.merge(one, [], [], date(2025, 4, 1))[2]) == 1
    known, _, bad = knowledge.merge(one, [about | {"versions": ["1"]}, about | {"versions": ["2"], "reason": "other"}], [], date(2025, 4, 1), True)
    assert not bad and [k["versions"] for k in known] == [["1"], ["2"]] and known[0]["added"] == "2025-04-01"


def test_command_line(spark, folder, tmp_path):
    (tmp_path / "one.log").write_text("2026-09-30 10:00:00 INFO [a] started\n2026-09-30 10:30:00 ERROR [a] failed 1\n")
    out = cli.run(["digest", "--ticket", "T/1", "--incident-time", "2026-09-30 10:30", "--logs", str(tmp_path / "one.log"), "--out", str(tmp_path / "out"), "--baseline", "none"], spark)
    assert "digest_T_1.md" in out and '"records": 2' in out
    assert cli.run(["search", "--dir", str(tmp_path / "out"), "failed"], spark).startswith("1 records")
    rules, rejected = tmp_path / "rules.yaml", tmp_path / "rejected.yaml"
    rules.write_text("# the header\n\n[]\n")
    said = cli.run(["noise-candidates", "--dir", str(folder), "--source", "site", "--dict", str(rules), "--rejected", str(rejected), "--out", str(tmp_path / "c.yaml")], spark)
    assert said.startswith("2 candidates")
    found = yaml.safe_load((tmp_path / "c.yaml").read_text())
    for c in found["candidates"]:
        c |= {"decision": "register", "reason": "r", "code": "c"}
    knowledge.write_yaml(str(tmp_path / "c.yaml"), found)
    assert cli.run(["noise-merge", "--candidates", str(tmp_path / "c.yaml"), "--dict", str(rules), "--rejected", str(rejected)]).startswith("2 rules")
    assert rules.read_text().startswith("# the header") and cli.run(["noise-validate", "--dict", str(rules)]) == "no problems\n"
    with pytest.raises(ArgumentError):
        cli.offsets_of(["x"])


def test_unchanged_inputs(spark, tmp_path):
    """A digest of the same files and settings isn't made again on demand; facts of files, counts of unknown levels and offsets are kept."""
    log = tmp_path / "one.log"
    log.write_text("junk\n" + "\n".join(f"2026-09-30 10:30:0{i} VERBOSE [a] x{i}" for i in range(3)) + "\n")
    out = str(tmp_path / "out")
    asked = ["digest", "--ticket", "T", "--incident-time", "2026-09-30 10:30", "--logs", str(log), "--out", out, "--baseline", "none", "--clock-offset", "one=2.5", "--if-changed"]
    assert not cli.run(asked, spark).endswith(": unchanged\n")
    meta = json.loads((tmp_path / "out" / "meta.json").read_text())
    facts = meta["files"][0]
    assert (facts["file"], facts["total_lines"], facts["records"], facts["unparsed_lines"], facts["unknown_levels"], facts["clock_offset_seconds"], facts["window_records"]) == ("one.log", 4, 3, 1, {"VERBOSE": 3}, 2.5, 3)
    assert any("VERBOSE (3)" in w for w in meta["warnings"])
    assert Tools(spark, out).tables["files"].first().clock_offset_seconds == 2.5
    built = store.manifest(out + "/store")["data"]
    assert cli.run(asked, spark).endswith(": unchanged\n") and store.manifest(out + "/store")["data"] == built
    for changed in ([*asked, "--context-lines", "2"], asked):
        if changed is asked:
            log.write_text(log.read_text() + "2026-09-30 10:30:09 INFO [a] y\n")
        assert not cli.run(changed, spark).endswith(": unchanged\n")
        assert store.manifest(out + "/store")["data"] != built
        built = store.manifest(out + "/store")["data"]


def test_configuration_files(spark, tmp_path):
    """Level aliases, a single pattern, Drain's settings and search limits are used, and meta.json has the files' hashes."""
    import hashlib

    logs = [f"2026-09-30 10:30:0{i}|ALARM|pump A-{i} is off" for i in range(3)] + ["2026-09-30 10:30:05|warning|low"]
    (tmp_path / "one.log").write_text("\n".join(logs) + "\n")
    formats, ini, limits = tmp_path / "formats.yaml", tmp_path / "drain.ini", tmp_path / "limits.yaml"
    formats.write_text("level_aliases: {alarm: error}\nformats:\n- name: own\n  files: ['*.log']\n  pattern: '^(?P<ts>[^|]+)\\|(?P<level>\\w+)\\|(?P<message>.*)$'\n")
    ini.write_text('[DRAIN]\nsim_th = 0.4\ndepth = 4\nmax_children = 100\n[MASKING]\nmasking = [{"regex_pattern": "A-\\\\d", "mask_with": "PUMP"}]\n')
    limits.write_text("search_logs: {max_lines: 2, overflow_lines: 1}\ncommon: {threads: 2}\n")
    out = str(tmp_path / "out")
    cli.run(["digest", "--ticket", "T", "--incident-time", "2026-09-30 10:30", "--logs", str(tmp_path / "one.log"), "--out", out, "--baseline", "none", "--formats", str(formats), "--drain", str(ini)], spark)
    meta = json.loads((tmp_path / "out" / "meta.json").read_text())
    assert {k: v["sha256"] for k, v in meta["config"].items()} == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (formats, ini)}
    assert meta["counts"]["blocks"] == 1 and not any("unknown levels" in w for w in meta["warnings"])
    tables = Tools(spark, out).tables
    assert sorted(r.level for r in tables["logs"].collect()) == ["ERROR"] * 3 + ["WARN"]
    assert "pump <PUMP> is off" in {r.template for r in tables["templates"].collect()}
    found = cli.run(["search", "--dir", out, "pump", "--limits", str(limits)], spark)
    assert found.startswith("3 records") and found.count("pump A-") == 1
    ini.write_text("[DRAIN]\ndepth = 5\n")
    limits.write_text("search_logs: {lines: 2}\n")
    for bad in (lambda: cli.mining_of(str(ini)), lambda: cli.run(["search", "--dir", out, "pump", "--limits", str(limits)], spark)):
        with pytest.raises(ArgumentError):
            bad()
