import html as html_lib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runcourier.functions.html import PROFILES, escape, strip_borders
from runcourier.operators.render import render, sizes, write_archive, write_reports
from runcourier.operators.sections import assemble
from runcourier.plans.jobs import preview, reports
from runcourier.sources.sample import sample_tables
from runcourier.sources.tables import inline_tables, whole_text

HEADERS = {
    "Request Summary": [
        "Super Client Name", "Request Run Date", "Parent Request Id", "Request Id", "Task Id",
        "Forecast Start Date", "LOB", "App ID",
    ],
    "Execution Suite Status Summary": [
        "Run ID", "Suite Category", "Execution Status", "Status", "Total Count", "Success Count",
        "Failure Count", "Elapsed Time", "Run User",
    ],
    "Execution Failed Query Summary Status": [
        "Run ID", "Suite Category", "Test Code", "Tags", "Test Description", "Execution Status",
    ],
    "Threshold Summary Status": ["Threshold Query Description"],
}


def tables_of(text):
    """Title, header and rows of every table in a document."""
    found = []
    pattern = r"<(?:div|h3)[^>]*>([^<]*)</(?:div|h3)><table[^>]*>(.*?)</table>"
    for title, body in re.findall(pattern, text, re.S):
        rows = []
        for row in re.findall(r"<tr>(.*?)</tr>", body, re.S):
            cells = re.findall(r"<t[hd][^>]*>(.*?)</t[hd]>", row, re.S)
            cells = [re.sub(r"<[^>]*>", "", c.replace("<br>", " ")) for c in cells]
            rows.append([html_lib.unescape(c) for c in cells])
        found.append((title, rows[0], rows[1:]))
    return found


def html_of(tables, profile="compact", **kwargs):
    rows = render(assemble(tables, **kwargs), profile).orderBy("run_id", "page_no").collect()
    return {(r.run_id, r.page_no): r.html for r in rows}


def test_sample_in_all_profiles(spark):
    for profile in PROFILES:
        (text,) = html_of(sample_tables(spark), profile).values()
        found = tables_of(text)
        assert [(t, h) for t, h, _ in found] == list(HEADERS.items())
        assert [len(r) for _, _, r in found] == [1, 1, 3, 2]
        assert found[1][2][0][4:8] == ["20", "17", "3", "00:10:05"]
        assert found[2][2][0][4] == "Row count <= 10 & not null"
        assert '<a href="mailto:owner@example.com"' in text
        assert "\n" not in text


def test_plain_profile_word_for_word(spark):
    (text,) = html_of(sample_tables(spark), "plain").values()
    assert text.startswith(
        '<h3>Request Summary</h3><table border="1" cellpadding="6" cellspacing="0" width="100%">'
        '<tr><th align="center"><b>Super Client Name</b></th>'
    )
    assert text.endswith(
        '</table><br><h3>Threshold Summary Status</h3>'
        '<table border="1" cellpadding="6" cellspacing="0" width="50%">'
        '<tr><th align="center"><b>Threshold Query Description</b></th></tr>'
        '<tr><td align="center">Outlier present in A</td></tr>'
        '<tr><td align="center">Outlier present in B</td></tr></table>'
    )


def test_profiles_differ_as_meant(spark):
    full = html_of(sample_tables(spark), "full").popitem()[1]
    compact = html_of(sample_tables(spark), "compact").popitem()[1]
    assert "text-decoration:underline" in full and "text-decoration" not in compact
    assert "#000000" in full and "#000000" not in compact
    assert "viewport" in full and "viewport" not in compact
    assert "Super Client<br>Name" in full and "Super Client<br>Name" in compact


def test_missing_sections_and_nulls(spark):
    tables = inline_tables(
        spark,
        suite_status=[("1", None, "FAILED", None, 1, None, 1, None, None)],
        failed_check=[("1", None, None, None, None, None), ("9", "S", "T", "g", "d", "FAIL")],
    )
    found = html_of(tables)
    assert list(found) == [("1", 0)]
    parts = tables_of(found["1", 0])
    assert parts[0][2] == [[""] * 8]
    assert parts[1][2] == [["1", "", "FAILED", "", "1", "", "1", "", ""]]
    assert parts[2][2] == [["1", "", "", "", "", ""]]
    assert parts[3][2] == []
    shown = render(assemble(tables), "plain", null_text="None").first().html
    assert '<td align="center">None</td>' in shown


def test_all_mode_shows_every_row(spark):
    suite = ("1", "S", "FAILED", "FAIL", 1, 0, 1, "t", "u")
    request = ("1", "c", "d", "p", "r", "t", "f", "l", "a")
    tables = inline_tables(spark, suite_status=[suite, suite], run_request=[request] * 3)
    parts = tables_of(html_of(tables, mode="all")["1", 0])
    assert [len(p[2]) for p in parts] == [3, 2, 0, 0]
    parts = tables_of(html_of(tables)["1", 0])
    assert [len(p[2]) for p in parts] == [1, 1, 0, 0]


def test_empty_tables(spark):
    assert html_of(inline_tables(spark)) == {}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab&<>'\";lt#3 ", max_size=30), min_size=1, max_size=20))
def test_escape(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, e in df.select("v", escape(F.col("v"))).collect():
        assert not set("<>'\"") & set(e)
        assert html_lib.unescape(e) == v


def test_strip_borders(spark):
    text = (
        '<table border="1" cellpadding="6"><tr><td style="a:b" align="center"><b>x</b>'
        '<a href="mailto:y">y</a></td></tr></table>'
    )
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(strip_borders(F.col("v"))).first()[0] == (
        '<table cellpadding="6"><tr><td align="center"><b>x</b>'
        '<a href="mailto:y">y</a></td></tr></table>'
    )


def test_files_of_other_runs_stay(spark, tmp_path):
    folder = str(tmp_path / "reports")
    suite = [(r, "S", "FAILED", "FAIL", 1, 0, 1, "t", "u") for r in ("1", "2")]
    write_reports(reports(inline_tables(spark, suite_status=suite)), folder)
    before = {r.path.split("report_run_")[1]: r.text for r in whole_text(spark, folder).collect()}
    again = [("2", "NEW", "PASSED", "PASS", 1, 1, 0, "t", "u")]
    write_reports(reports(inline_tables(spark, suite_status=again)), folder)
    after = {r.path.split("report_run_")[1]: r.text for r in whole_text(spark, folder).collect()}
    assert len(before) == len(after) == 2
    kept = [k for k in before if k == "1.html"]
    assert before[kept[0]] == after[kept[0]]
    assert any("NEW" in t for t in after.values())


def test_archive_and_preview(spark, tmp_path):
    pages = sizes(reports(sample_tables(spark), "plain"))
    write_archive(pages, str(tmp_path / "archive"))
    row = spark.read.parquet(str(tmp_path / "archive")).first()
    assert row.n_chars == len(row.html) and row.n_bytes == len(row.html.encode())
    preview(spark, str(tmp_path / "preview"))
    assert whole_text(spark, str(tmp_path / "preview")).count() == 1
