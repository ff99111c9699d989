from collections import Counter

import pytest
from pyspark.sql import functions as F

from runcourier.functions import paging
from runcourier.operators.runs import latest_at, latest_run, resolve, top_run
from runcourier.operators.sections import (
    assemble,
    counter_mismatch,
    first_rows,
    first_rows_by_window,
    heads,
    incomplete_runs,
    runs_with,
    runs_without,
    section,
)
from runcourier.sources.tables import inline_tables


def suite(run, category="S", total=1, ok=1, bad=0, status="PASS"):
    return (run, category, status + "ED", status, total, ok, bad, "00:00:01", "u@example.com")


def check(run, i, text="text"):
    return (run, "S", f"T{i:06d}", "tag", text, "FAIL")


def request(run, client="c"):
    return (run, client, "d", "p", "r", "t", "f", "l", "a")


def test_latest_by_text_and_by_number(spark):
    t = inline_tables(spark, suite_status=[suite("999"), suite("2088075"), suite("x1")])
    assert latest_run(t.suite_status).first()[0] == "x1"
    assert latest_run(t.suite_status.where("run_id <> 'x1'")).first()[0] == "999"
    assert latest_run(t.suite_status, "numeric").first()[0] == "2088075"
    assert top_run(t.suite_status).first()[0] == "x1"
    with pytest.raises(ValueError):
        latest_run(t.suite_status, "newest")


def test_no_runs_at_all(spark):
    t = inline_tables(spark)
    assert latest_run(t.suite_status).first()[0] is None
    assert top_run(t.suite_status).collect() == []
    for name in ("request", "suite", "failed", "threshold"):
        assert section(t, name).collect() == []
    assert assemble(t).collect() == []


@pytest.mark.parametrize(
    "param,expected", [("", "2"), ("  \n", "2"), (None, "2"), (" 1 ", "1"), ("7", None)]
)
def test_run_parameter(spark, param, expected):
    t = inline_tables(spark, suite_status=[suite("1"), suite("2")])
    rows = section(t, "suite", run_id=param).collect()
    assert [r.run_id for r in rows] == ([expected] if expected else [])


def test_run_parameter_as_column(spark):
    t = inline_tables(spark, suite_status=[suite("1"), suite("2")])
    params = spark.createDataFrame([("",), (" 1 ",), (None,), ("7",)], "p string")
    got = params.select(resolve(F.col("p"), t.suite_status)).collect()
    assert [r[0] for r in got] == ["2", "1", "2", "7"]


def test_latest_run_comes_from_the_suites(spark):
    t = inline_tables(
        spark, suite_status=[suite("1")], run_request=[request("2")], failed_check=[check("1", 1)]
    )
    assert section(t, "request").collect() == []
    assert len(section(t, "failed").collect()) == 1
    assert section(t, "failed", labels=True).columns == [
        "Run ID", "Suite Category", "Test Code", "Tags", "Test Description", "Execution Status",
    ]


def test_first_row_is_the_same_both_ways(spark):
    rows = [suite("1", c) for c in "BAC"] + [suite("2", "Z"), suite("2", "Z")]
    t = inline_tables(spark, suite_status=rows)
    a, b = first_rows(t, "suite"), first_rows_by_window(t, "suite")
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())
    assert {r.run_id: r.suite_category for r in a.collect()} == {"1": "A", "2": "Z"}


def test_completeness(spark):
    t = inline_tables(
        spark,
        suite_status=[suite("1"), suite("2")],
        run_request=[request("1"), request("3")],
        failed_check=[check("1", 1)],
        threshold_breach=[("1", "x")],
    )
    got = {r.run_id: tuple(r)[1:] for r in incomplete_runs(t).collect()}
    assert got == {"2": (False, True, False, False), "3": (True, False, False, False)}
    assert [r[0] for r in runs_without(t, "request").collect()] == ["2"]
    assert [r[0] for r in runs_with(t, "request").collect()] == ["1"]


def test_counter_mismatch(spark):
    rows = [suite("1", total=3, ok=2, bad=1), suite("2", total=3), suite("3", total=None)]
    got = counter_mismatch(inline_tables(spark, suite_status=rows).suite_status)
    assert sorted(r.run_id for r in got.collect()) == ["2", "3"]


# ------------------------------------------------------------------- pages


def _rows_of(report):
    failed, breaches = Counter(), Counter()
    for r in report.collect():
        for f in r.failed:
            failed[tuple(f)] += 1
        for b in r.thresholds:
            breaches[r.run_id, b.threshold_query_description] += 1
    return failed, breaches


def _skewed(spark):
    """One run with most rows, among them one row a thousand times."""
    failed = [check("hot", i, "y" * (i % 50)) for i in range(400)]
    failed += [check("hot", 7, "same")] * 1000 + [check("big", 1, "z" * 9000)]
    failed += [check("cold", i) for i in range(2)] + [check("lost", 1)] * 300
    breaches = [("hot", f"b{i % 60}") for i in range(300)] + [("cold", "b")]
    suites = [suite("hot")] * 500 + [suite("cold"), suite("big"), suite("quiet")]
    requests = [request("hot", f"c{i}") for i in range(200)]
    return inline_tables(
        spark, suite_status=suites, failed_check=failed, threshold_breach=breaches,
        run_request=requests,
    ), failed, breaches


def test_pages_keep_every_row(spark):
    tables, failed, breaches = _skewed(spark)
    report = assemble(tables, page_chars=5000).cache()
    got_failed, got_breaches = _rows_of(report)
    assert got_failed == Counter(f for f in failed if f[0] != "lost")
    assert got_breaches == Counter(breaches)

    rows = report.collect()
    pages = {}
    for r in rows:
        pages.setdefault(r.run_id, []).append(r)
    assert {k: len(v) for k, v in pages.items() if k != "hot"} == {"cold": 1, "big": 2, "quiet": 1}
    hot = sorted(pages["hot"], key=lambda r: r.page_no)
    assert [r.page_no for r in hot] == list(range(hot[0].n_pages)) and len(hot) > 100
    # The copies are spread too: no page holds a large part of them.
    assert max(sum(f.test_description == "same" for f in r.failed) for r in hot) < 60
    # Every page shows the same request and suite.
    assert {r.suite.run_id for r in hot} == {"hot"}
    assert {r.request.super_client_name for r in hot} == {"c0"}
    assert all(r.request is None for k in ("cold", "big", "quiet") for r in pages[k])
    for r in rows:
        assert list(r.failed) == sorted(r.failed)


def test_pages_in_all_mode(spark):
    tables, failed, _ = _skewed(spark)
    report = assemble(tables, mode="all", page_chars=5000).cache()
    assert _rows_of(report)[0] == Counter(f for f in failed if f[0] != "lost")
    assert sum(len(r.suite) for r in report.collect()) == 503
    assert sum(len(r.request) for r in report.collect()) == 200


def test_pages_and_single_page_agree(spark):
    tables, _, _ = _skewed(spark)
    assert _rows_of(assemble(tables)) == _rows_of(assemble(tables, page_chars=2000))
    assert assemble(tables).where("n_pages > 1").count() == 0


def test_many_large_runs_use_the_stored_list(spark, monkeypatch):
    tables, failed, _ = _skewed(spark)
    monkeypatch.setattr(paging, "DRIVER_ROWS", 1)
    report = assemble(tables, page_chars=1000)
    assert _rows_of(report)[0] == Counter(f for f in failed if f[0] != "lost")


def test_rows_without_a_run_id_belong_to_no_run(spark):
    t = inline_tables(
        spark, suite_status=[suite(None), suite("1")], failed_check=[check(None, 1)] * 50
    )
    for limit in (1000, 8_000_000):
        report = assemble(t, page_chars=limit).collect()
        assert [(r.run_id, len(r.failed)) for r in report] == [("1", 0)]
    assert [r.run_id for r in heads(t).collect()] == ["1"]


def test_heads_equal_the_records(spark):
    tables, _, _ = _skewed(spark)
    whole = assemble(tables).select("run_id", "request", "suite")
    assert sorted(heads(tables).select("run_id", "request", "suite").collect()) == sorted(
        whole.collect()
    )


def test_latest_at(spark):
    runs = spark.sql(
        "select * from values ('5', timestamp_ntz'2024-01-01 00:00:00'),"
        " ('3', timestamp_ntz'2024-01-01 00:10:01'), ('7', timestamp_ntz'2024-01-01 00:15:00.5'),"
        " ('6', timestamp_ntz'2024-01-01 00:40:00') as t(run_id, ts)"
    )
    slots = spark.sql(
        "select explode(sequence(timestamp_ntz'2023-12-31 23:45:00',"
        " timestamp_ntz'2024-01-01 01:00:00', interval 15 minutes)) as slot"
    )
    got = [r.run_id for r in latest_at(runs, slots).orderBy("slot").collect()]
    # A run half a second after a slot is not part of it.
    assert got == [None, "5", "5", "7", "7", "7"]
