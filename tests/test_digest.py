"""End to end over the scenario: what the digest, the store and the noise workflow must say of it."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from logtide.operators import noise
from logtide.plans import digest, render, store
from tests.scenario import DROPPED, DROPPED_IN_WINDOW, EXPIRED, REPORTED, RULES, USUAL_DAY, USUAL_ERRORS, USUAL_RECORDS, write_logs

INCIDENT = digest.Incident("HB-77", REPORTED, version="7.4.1", product="Harbour gateway")


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    return write_logs(tmp_path_factory.mktemp("logs"))


@pytest.fixture(scope="module")
def analysis(spark, logs):
    return digest.analyse(spark, [str(logs)], INCIDENT, rules=noise.rules_of(RULES))


@pytest.fixture(scope="module")
def written(analysis, tmp_path_factory):
    folder = tmp_path_factory.mktemp("out")
    return folder, render.write(analysis, str(folder))


def text_of(analysis, start):
    return analysis.templates.where(F.col("text").startswith(start)).collect()


def test_files(analysis):
    files = {f.file: f for f in analysis.files.collect()}
    assert sorted(files) == ["archive.log", "buoy.log", "door.log", "gateway.log"]
    assert files["door.log"].encoding == "cp932" and files["gateway.log"].encoding == "utf-8"
    # The first line of the main log is no record, and each dropped reading has five lines of trace.
    assert files["gateway.log"].unparsed_lines == 1 and files["gateway.log"].continuation_lines == 5 * DROPPED
    assert files["archive.log"].records == 31 and files["door.log"].records == 280


def test_first_error_and_template_texts(analysis):
    first = analysis.stream.where("is_trigger").orderBy("position").first()
    assert first.ts == EXPIRED and first.message.startswith("Handshake refused")
    assert [t.text for t in text_of(analysis, "Modem")] == ["Modem ping lost: <IP> no carrier"]
    assert [t.text for t in text_of(analysis, "Clock")] == ["Clock drift ignored: <URL>"]
    (ends,) = text_of(analysis, "Certificate ends")
    assert ends.total_count == 4
    (refused,) = text_of(analysis, "Handshake")
    assert (refused.total_count, refused.window_count, refused.text) == (DROPPED, DROPPED_IN_WINDOW, "Handshake refused: certificate expired, key <PATH>")


def test_days_and_selection(analysis):
    """Renewal goes off on Friday the 7th, so Thursday is the last usual day; days at the weekend are no business days."""
    days = {d.day: d for d in analysis.days.collect()}
    usual = days[USUAL_DAY]
    assert (usual.records, usual.errors, usual.business, usual.normal_candidate) == (USUAL_RECORDS, USUAL_ERRORS, True, True)
    assert not any(days[date(2025, 3, d)].normal_candidate for d in (7, 10, 11, 12))
    assert not any(days[date(2025, 3, d)].business for d in (1, 2, 8, 9))
    assert analysis.first_change == date(2025, 3, 7)
    (period,) = analysis.selection.periods
    assert (analysis.selection.how, period.start, period.end) == ("auto", datetime(2025, 3, 6, 13, 50), datetime(2025, 3, 6, 14, 50))


def test_change_points(analysis):
    named = analysis.points.join(analysis.templates.select("template", "text"), "template").collect()
    before = {(p.kind, p.text.split(":")[0].split(" <")[0]): (p.day.day, p.before_present, p.before_days, p.after_present, p.after_days) for p in named if p.day < date(2025, 3, 12)}
    assert before == {("VANISHED", "Key renewal done"): (7, 6, 6, 0, 6), ("APPEAR", "Renewal of keys is off"): (7, 0, 6, 6, 6), ("APPEAR", "Certificate ends in"): (10, 0, 9, 3, 3)}
    # Handshake, dropped reading, queue, uplink and writer pool.
    assert sum(p.day == date(2025, 3, 12) and p.kind == "APPEAR" for p in named) == 5


def test_comparison_and_noise(analysis):
    found = analysis.comparisons.join(analysis.templates.select("template", "text", "is_noise"), "template").collect()
    refused = next(c for c in found if c.text.startswith("Handshake"))
    assert (refused.kind, refused.expected, refused.observed) == ("NEW", 0, DROPPED_IN_WINDOW)
    # Each ten minutes of the window's hour, as in the hour it is compared with.
    (clock,) = text_of(analysis, "Clock")
    assert clock.is_noise and clock.window_count == 6
    assert analysis.expected.where(F.col("template") == clock.template).first().expected == 6
    assert not any(c.is_noise for c in found)


def test_blocks(analysis):
    rows = analysis.blocks_all.orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    assert all(r.hi - r.lo < 60 for r in rows)
    assert sum(len(r.triggers) for r in rows) == analysis.stream.where("is_trigger").count()
    assert analysis.blocks.first().block == "E01"


def test_digest_text(written):
    folder, texts = written
    text = texts["digest_HB-77.md"]
    assert render.tokens_in(text) <= 5000
    assert "14:21:30.250" in text and "| NEW |" in text and "6/6" in text and "(6 observed, 6 expected)" in text
    assert "Modem" not in text.split("## Known noise")[0] and "Modem" not in texts["context.md"]
    assert "Forwarder.java:140" in texts["context.md"]
    assert texts["templates.tsv"].splitlines()[0].split("\t")[0] == "id"
    assert json.loads(texts["meta.json"])["baseline"]["selection"] == "auto"


def test_same_bytes_again(spark, logs, written):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = digest.analyse(spark, [str(logs)], INCIDENT, rules=noise.rules_of(RULES))
        renderer = render.Renderer(render.Bounded(again))
        assert render.fitted(renderer) == written[1]["digest_HB-77.md"]
        assert renderer.context() == written[1]["context.md"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_store(spark, written):
    folder, _ = written
    tables = store.opened(spark, str(folder / "store"))
    logs = tables["logs"]
    assert logs.count() == logs.selectExpr("max(seq) + 1").first()[0]
    assert logs.where("message LIKE 'Handshake refused%'").count() == DROPPED
    assert logs.where("extra LIKE '%Forwarder.java:140%'").count() == DROPPED
    assert logs.where("noise AND message LIKE 'Clock%'").count() > 0
    assert logs.select("template_id").distinct().count() == tables["templates"].count()


def test_logs_without_records(spark, tmp_path):
    (tmp_path / "a.log").write_text("nothing here\n")
    (tmp_path / "b.log").write_text("")
    found = digest.analyse(spark, [str(tmp_path)], INCIDENT)
    text = render.Renderer(render.Bounded(found)).digest(render.Limits())
    assert "no line fits a pattern" in text and "no record in the window" in text and found.selection.how == "none"


def test_one_day_of_logs(spark, tmp_path):
    at = digest.Incident("one day", datetime(2024, 5, 14, 9, 40))
    lines = [f"2024-05-14 {h:02d}:{m:02d}:00 {'ERROR' if (h, m) > (9, 40) else 'INFO'} [a] event {m}" for h in range(7, 10) for m in range(60)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    found = digest.analyse(spark, [str(tmp_path)], at)
    assert found.selection.how == "fallback" and found.selection.periods[0].end == at.start
    off = digest.analyse(spark, [str(tmp_path)], at, compare=False)
    assert off.selection.how == "none" and off.comparisons.count() == 0
    named = digest.analyse(spark, [str(tmp_path)], at, baselines=["2024-05-14 09:30/2024-05-14 09:45", "2024-05-01"], offsets={"a": 60, "zzz": 1})
    assert any("overlaps" in w for w in named.warnings) and any("no logs in the period" in w for w in named.warnings) and any("zzz" in w for w in named.warnings)
    assert named.records.agg({"ts": "min"}).first()[0] == datetime(2024, 5, 14, 7, 1)
