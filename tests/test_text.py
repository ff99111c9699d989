import json
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runcourier.functions import text as X


def _column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


# Every character that Python strips, and some that it does not.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
OTHERS = ["​", "﻿", "­", "x", "᠎"]


def test_trim_takes_every_white_space(spark):
    values = [c + "a" + c + "b" + c for c in SPACES + OTHERS] + ["", "  ", "\n\t"]
    got = _column(spark, values, X.trim_all(F.col("v")))
    assert [g[0] for g in got] == [v.strip() for v in values]


def test_one_line(spark):
    values = ["a  b\n\tc ", " " * 100, "x" * 200, "a" + "".join(SPACES) + "b", "é" * 90]
    got = _column(spark, values, X.one_line(F.col("v")))
    assert [g[0] for g in got] == [" ".join(v.split())[:80] for v in values]


def test_split_list(spark):
    values = [" a@example.com , ,b@example.com", "", None, ",,", "\ta\n, b", "a,a"]
    got = _column(spark, values, X.split_list(F.col("v")))
    assert [g[0] for g in got] == [
        [x.strip() for x in (v or "").split(",") if x.strip()] for v in values
    ]


def test_blank_to(spark):
    values = ["", "  ", None, " a ", " "]
    got = _column(spark, values, X.blank_to(F.col("v"), F.lit("d")))
    assert [g[0] for g in got] == ["d", "d", "d", "a", "d"]


def test_redact(spark):
    values = ["", None, "abc", "abcdefghij"]
    got = _column(spark, values, X.redact(F.col("v")))
    assert [g[0] for g in got] == ["<none>", "<none>", "abc…redacted…", "abcdef…redacted…"]


def test_json_part_and_field(spark):
    values = ['v1.2\n{"a": {"b": 3}}', "nothing", "", '{"a": {}}']
    got = _column(spark, values, X.json_part(F.col("v")), X.json_field(F.col("v"), "$.a.b"))
    assert got == [
        ('{"a": {"b": 3}}', "3"),
        ("{}", None),
        ("{}", None),
        ('{"a": {}}', None),
    ]


def test_small_helpers(spark):
    got = _column(
        spark,
        ["true", "false", None, "Grüße\nx"],
        X.is_true(F.col("v")),
        X.shown(F.col("v")),
        X.tail(F.col("v"), 3),
        X.n_chars(F.col("v")),
        X.n_bytes(F.col("v")),
        X.markdown_breaks(F.col("v")),
    )
    assert got[0] == (True, "true", "rue", 4, 4, "true")
    assert got[1][0] is False
    assert got[2] == (False, "None", None, None, None, None)
    assert got[3] == (False, "Grüße\nx", "e\nx", 7, 9, "Grüße  \nx")


def test_utf8(spark):
    assert bytes(_column(spark, ["aé—"], X.utf8(F.col("v")))[0][0]) == "aé—".encode()


def test_report_path(spark):
    ids = ["1", "a/../../b", "..", "50% + x", "ä~_-.", "%2F"]
    got = [r[0] for r in _column(spark, ids, X.report_path("/r", F.col("v")))]
    assert got == [f"/r/report_run_{urllib.parse.quote(i, safe='')}.html" for i in ids]
    for bad in ("", None):
        with pytest.raises(Exception, match="run id"):
            _column(spark, [bad], X.report_path("/r", F.col("v")))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_form_encoding_matches_the_library(spark, values):
    got = _column(spark, values, X.form_encode(a=F.col("v"), b=F.lit("x y~*")))
    want = [urllib.parse.urlencode({"a": v, "b": "x y~*"}) for v in values]
    assert [g[0] for g in got] == want


def test_json_text_survives(spark):
    from runcourier.operators.deliver import plain_payload

    values = ['a"b', "line\nbreak", "<tag> & 'x'", "— · …", "\t\\", None]
    got = _column(spark, values, plain_payload(F.col("v")))
    assert [json.loads(g[0])["text"] for g in got] == values
