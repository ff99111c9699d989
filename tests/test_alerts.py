import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runcourier.functions.ordered import previous
from runcourier.operators.alerts import (
    evaluate,
    notifications,
    run_verdicts,
    states,
    transitions,
)
from runcourier.operators.deliver import fan_out
from runcourier.plans.jobs import alert_job, alert_verdict
from runcourier.schema import ALERT_RULE, SUBSCRIPTION
from runcourier.session import join_config
from runcourier.sources.tables import inline_tables


def suite(run, category, bad):
    return (run, category, "FAILED" if bad else "PASSED", "", 10, 10 - (bad or 0), bad, "t", "u")


def rules_of(spark, *rows):
    return spark.createDataFrame(rows, ALERT_RULE)


ANY = ("any", "failure_count", "GREATER_THAN", 0.0, 0)


def test_condition(spark):
    t = inline_tables(spark, suite_status=[suite("1", c, b) for c, b in zip("ABC", (0, 3, None))])
    two = rules_of(spark, ANY, ("two", "failure_count", "GREATER_THAN", 3.0, 0))
    got = evaluate(t.suite_status, two).collect()
    fired = {(r.rule_id, r.suite_category): r.fired for r in got}
    assert fired == {
        ("any", "A"): False, ("any", "B"): True, ("any", "C"): False,
        ("two", "A"): False, ("two", "B"): False, ("two", "C"): False,
    }
    verdict = {r.rule_id: r for r in alert_verdict(t, two).collect()}
    assert verdict["any"].fired and verdict["any"].n_fired == 1 and verdict["any"].total_value == 3
    assert not verdict["two"].fired


def test_unknown_operator_is_an_error(spark):
    t = inline_tables(spark, suite_status=[suite("1", "A", 1)])
    with pytest.raises(PySparkException, match="unknown alert operator"):
        evaluate(t.suite_status, rules_of(spark, ("r", "total_count", "LESS", 0.0, 0))).collect()


def _walk(rows):
    """State changes by hand."""
    out, was = set(), {}
    for key, run, fired in sorted(rows):
        if fired != was.get(key, False):
            out.add((key, run, "TRIGGERED" if fired else "RESOLVED"))
        was[key] = fired
    return out


@pytest.mark.parametrize("window_rows", [5_000_000, 3])
def test_transitions(spark, window_rows):
    rng = random.Random(7)
    # One suite holds most of the runs.
    rows = [("hot", f"{i:05d}", rng.random() < 0.5) for i in range(400)]
    rows += [(f"s{i % 5}", f"{i:05d}", rng.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(
        [("r", *r) for r in rows], "rule_id string, suite_category string, run_id string, fired boolean"
    ).repartition(5)
    got = {
        (r.suite_category, r.run_id, r.change)
        for r in transitions(df, window_rows=window_rows).collect()
    }
    assert got == _walk(rows)


def test_transitions_from_a_known_state(spark):
    df = spark.createDataFrame(
        [("r", "A", "1", True), ("r", "B", "1", False), ("r", "C", "1", True)],
        "rule_id string, suite_category string, run_id string, fired boolean",
    )
    known = spark.createDataFrame(
        [("r", "A", True), ("r", "B", True)], "rule_id string, suite_category string, fired boolean"
    )
    got = {(r.suite_category, r.change) for r in transitions(df, known).collect()}
    assert got == {("B", "RESOLVED"), ("C", "TRIGGERED")}


@pytest.mark.parametrize("window_rows", [1000, 2])
def test_previous_keeps_null_values_apart_from_missing_rows(spark, window_rows):
    rows = [("a", i, None if i % 3 == 0 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(6)
    got = {r.o: r.previous_v for r in previous(df, ["k"], ["o"], "v", window_rows).collect()}
    assert got == {i: None if i == 0 else rows[i - 1][2] for i in range(40)}


def test_previous_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, o int, v int")
    assert previous(empty, ["k"], ["o"], "v").collect() == []


def test_rearm(spark):
    # One evaluation every 10 seconds: fires, stays, recovers, fires.
    fired = [1, 1, 1, 1, 1, 0, 1, 1]
    suites = [suite(f"{i:02d}", "A", b) for i, b in enumerate(fired)]
    t = inline_tables(spark, suite_status=suites)
    times = spark.sql(
        "select lpad(cast(id as string), 2, '0') as run_id,"
        " timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10) as ts from range(8)"
    )

    def runs(rearm):
        rule = rules_of(spark, ("r", "failure_count", "GREATER_THAN", 0.0, rearm))
        got = notifications(evaluate(t.suite_status, rule), times).orderBy("run_id").collect()
        return [(int(r.run_id), r.reason) for r in got]

    assert runs(0) == [(0, "FIRST"), (6, "FIRST")]
    assert runs(20) == [(0, "FIRST"), (2, "AGAIN"), (4, "AGAIN"), (6, "FIRST")]
    assert runs(30) == [(0, "FIRST"), (3, "AGAIN"), (6, "FIRST")]
    state = states(evaluate(t.suite_status, rules_of(spark, ANY)))
    first = transitions(state).where("change = 'TRIGGERED'")
    assert sorted(int(r.run_id) for r in first.collect()) == [0, 6]


def test_notifications_within_a_second_and_without_a_time(spark):
    suites = [suite(f"{i}", "A", b) for i, b in enumerate([1, 0, 1, 0, 1])]
    t = inline_tables(spark, suite_status=suites)
    times = spark.sql(
        "select cast(id as string) as run_id, timestamp_ntz'2024-01-01 00:00:00' as ts from range(3)"
    )
    evaluated = evaluate(t.suite_status, rules_of(spark, ("r", "failure_count", "GREATER_THAN", 0.0, 5)))
    for window_rows in (100, 1):
        got = notifications(evaluated, times, window_rows).orderBy("run_id").collect()
        assert [(r.run_id, r.reason, r.fire_ts is None) for r in got] == [
            ("0", "FIRST", False), ("2", "FIRST", False), ("4", "FIRST", True)
        ]


def test_transitions_in_number_order(spark):
    t = inline_tables(spark, suite_status=[suite("999", "A", 0), suite("1000", "A", 1)])
    state = states(evaluate(t.suite_status, rules_of(spark, ANY)))
    assert [r.run_id for r in transitions(state, order="numeric").collect()] == ["1000"]


def test_fan_out_skips_paused_and_keeps_duplicates(spark):
    fired = spark.createDataFrame([("r", "1"), ("q", "1")], "rule_id string, run_id string")
    subs = spark.createDataFrame(
        [("r", "user", "a", False), ("r", "user", "a", False), ("r", "user", "b", True),
         ("r", "destination", "c", None), ("other", "user", "d", False)],
        SUBSCRIPTION,
    )
    got = sorted((r.run_id, r.kind, r.address) for r in fan_out(fired, subs).collect())
    assert got == [("1", "destination", "c"), ("1", "user", "a"), ("1", "user", "a")]


def test_config_join_with_and_without_broadcast(spark):
    facts = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        "id",
    )
    config = spark.createDataFrame([("hot", i) for i in range(5)] + [("k1", 9)], "k string, c int")
    small = join_config(facts, config, "k")
    large = join_config(facts, config, "k", rows=2, salts=8)
    assert "_salt" not in large.columns
    assert sorted(small.collect()) == sorted(large.select(small.columns).collect())
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_alert_job(spark):
    t = inline_tables(
        spark, suite_status=[suite("1", "A", 2), suite("2", "A", 1), suite("2", "B", 0)]
    )
    subs = spark.createDataFrame([("any", "user", "a", False)], SUBSCRIPTION)
    # Run 1 triggered already.
    assert alert_job(t, rules_of(spark, ANY), subs).collect() == []
    fresh = inline_tables(
        spark, suite_status=[suite("999", "A", 0), suite("1000", "A", 1), suite("1000", "B", 0)]
    )
    rows = alert_job(fresh, rules_of(spark, ANY), subs, order="numeric").collect()
    assert [(r.run_id, r.address, r.subject) for r in rows] == [
        ("1000", "a", "Regression Report - Run 1000 - FAILED")
    ]
    # As text, 999 is the latest run, and it is OK.
    assert alert_job(fresh, rules_of(spark, ANY), subs).collect() == []
    assert alert_job(fresh, rules_of(spark, ANY), subs, paused=True, order="numeric").collect() == []
    assert [r.run_id for r in alert_job(t, rules_of(spark, ANY), subs, run_id="1").collect()] == ["1"]
    verdicts = run_verdicts(evaluate(t.suite_status, rules_of(spark, ANY)))
    assert {r.run_id: r.fired for r in verdicts.collect()} == {"1": True, "2": True}
