"""Expressions and time formats, against Python's own."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logtide.functions.regex import TimeFormat, java_regex
from logtide.functions.times import ArgumentError, zone_name
from logtide.operators import parse

TEXTS = ["", "a", "ab\n", "a1 b2", "A\nb\r\n", "x٣y", "é_è", " \u00a0\u2003\u1680tab\t", "foo.bar", "ǅ", "a-b", "日本 12", "\x1c\x85", "\U0001f600x", "aa\nab\n\nb", "[x]", "e\u0301", "½ Ⅷ"]


def agree(spark, patterns):
    """Where Spark finds each pattern, and its first groups, as Python does."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    checked = []
    for p in patterns:
        groups = re.compile(p).groups
        j = java_regex(p)
        checked.append(F.struct(F.col("t").rlike(j).alias("hit"), *[F.regexp_extract("t", j, g).alias(f"g{g}") for g in range(groups + 1)]))
    rows = df.select("i", *[c.alias(f"p{n}") for n, c in enumerate(checked)]).collect()
    for row in rows:
        for n, p in enumerate(patterns):
            m = re.search(p, TEXTS[row.i])
            want = [bool(m), *((m[g] or "" for g in range(re.compile(p).groups + 1)) if m else [""] * (re.compile(p).groups + 1))]
            assert list(row[f"p{n}"]) == want, (p, TEXTS[row.i], java_regex(p))


def test_regex_dialect(spark):
    agree(
        spark,
        [
            r"(?P<x>a)(?P=x)?", r"\d+", r"\bb", r"\Bb", r"\w+$", r"^\s", r"\S\Z", r"(?i)FOO\.", r"(?m)^b$", r"a.b", r"(?s)a.b", r"[^\W\d]+", r"[\s\w]+", r"[^a-z\n]+", r"(?a)\w+", r"(?a:\d)|é", r"(?x) a  # note\n b", r"(?<=a)\d(?! b3)",
            r"(a|ab)(b|)(?:\n)?", r"a*?b", r"(?>a+)b", r"a{2}|a{1,}b", r"[\]\[]", r"[-a]+", r"[.\\^$]", r"\x41|\u00e9", r"$", r"^", r"\A\Z", r"[^\S ]", r"(?i)é", r"(?i:ǆ)", r"\U0001f600.", r"(a)?b\1?", r"a++1",
        ],
    )
    for bad in ("(", "(?P<x", "a{2,1}", "(?<x>a)", "[z-a]", r"(a)?(?(1)b|c)"):
        with pytest.raises(ArgumentError):
            java_regex(bad)


def test_regex_random(spark):
    rng = random.Random(12)
    atoms = ["a", "b", r"\d", r"\w", r"\s", ".", "[ab1]", "[^a]", r"[^\w]", "é", r"\b", "^", "$", r"\.", "日"]

    def grown(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(atoms)
        kind = rng.randrange(4)
        if kind == 0:
            return f"({grown(depth - 1)}|{grown(depth - 1)})"
        if kind == 1:
            return f"(?:{grown(depth - 1)}){rng.choice(['?', '*', '+', '{1,2}', '*?'])}"
        return grown(depth - 1) + grown(depth - 1)

    agree(spark, [grown(3) for _ in range(120)])


def test_time_formats(spark):
    rng = random.Random(13)
    forms = ["%Y-%m-%d %H:%M:%S.%f", "%d/%b/%Y:%H:%M:%S %z", "%y%m%d%H%M", "%A, %B %d %Y %I:%M %p", "%Y.%j %H", "%d.%m.%Y  %T", "%a %b %d %H:%M:%S %Y", "100%% %F", "%m/%d/%y"]
    texts = []
    for _ in range(60):
        at = datetime(1969, 1, 1) + timedelta(seconds=rng.randrange(3 * 10**9), microseconds=rng.randrange(10**6))
        form = rng.choice(forms)
        text = at.strftime(form.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%z", rng.choice(["+0900", "Z", "-03:30"])))
        texts += [text, text.lower(), text.replace("0", "", 1), text + " x", text.replace(" ", "   ")]
    texts += ["", None, "31/Feb/2024:00:00:00 +0000", "2023-02-29 00:00:00.0", "2024.366 07", "2023.366 07"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[parse.timestamp(F.col("t"), "+09:00", "UTC", form=f).alias(f"f{i}") for i, f in enumerate(forms)]).collect()
    hits = 0
    for r in rows:
        for i, form in enumerate(forms):
            try:
                at = datetime.strptime((r.t or "").strip(), form.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d"))
                want = (at - (timedelta(hours=9) if at.utcoffset() is None else at.utcoffset())).replace(tzinfo=None)
            except ValueError:
                want = None
            hits += want is not None
            assert r[f"f{i}"] == want, (form, r.t)
    assert hits > 150
    for bad in ("%Q", "%Y", "%H:%M", "%Y-%m-%d %I", "%Y-%Y"):
        with pytest.raises(ArgumentError):
            TimeFormat(bad)


def test_zones():
    assert [zone_name(z) for z in ("z", "GMT", "utc", "+9:00", "-0330", "Asia/Tokyo")] == ["UTC", "UTC", "UTC", "+09:00", "-03:30", "Asia/Tokyo"]
    for bad in ("", "Mars/Base", "+25:00", "9", "+09:75"):
        with pytest.raises(ArgumentError):
            zone_name(bad)
    with pytest.raises(ArgumentError):
        parse.LogFormat(timezone="Nowhere")
    with pytest.raises(ArgumentError):
        parse.LogFormat(ts_format="%Y %Q")
