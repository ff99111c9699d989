import time

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contract import queries as Q
from runcourier.operators.alerts import evaluate, states, transitions
from runcourier.operators.cadence import debounce
from runcourier.operators.deliver import alert_outbox, fan_out
from runcourier.schema import ALERT_RULE, SUBSCRIPTION
from runcourier.sources.event_runs import event_tables, read_events, tables_from_events, tagged
from runcourier.sources.tables import inline_tables, load_tables, save_tables, whole_text
from runcourier.streaming import jobs as SJ
from runcourier.streaming.changes import file_changes, table_changes
from runcourier.streaming.notify import notification_stream
from runcourier.streaming.state import StateTable, read_outbox

SF = "/root/testdata/sf0.001"


def _split(spark, folder, parts=4):
    """The events as files that each hold whole runs, in the order of time."""
    events = tagged(read_events(spark, SF))
    runs = sorted(r[0] for r in events.select("run_id").distinct().collect())
    step = len(runs) // parts + 1
    for i in range(parts):
        own = runs[i * step : (i + 1) * step]
        rows = events.where(F.col("run_id").between(own[0], own[-1])).coalesce(1)
        rows.drop("run_id", "suite_category", "bad").write.mode("append").parquet(folder)
    return events


def test_alerts_of_stream_and_batch_agree(spark, tmp_path):
    folder, work = str(tmp_path / "events"), str(tmp_path / "work")
    _split(spark, folder)
    rules = Q.rules(spark)
    subs = Q.subscriptions(spark, SF)
    schema = read_events(spark, SF).schema
    tables = event_tables(spark, SF)

    def run():
        stream = tagged(file_changes(spark, folder, "*.parquet", schema, 1)).select("run_id")
        on_batch = SJ.alert_batches(
            lambda: tables, rules, subs,
            StateTable(f"{work}/state", SJ.alert_state_table("x").keys, SJ.ALERT_STATE, 2),
            f"{work}/outbox",
        )
        SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()

    run()
    fired = transitions(states(evaluate(tables.suite_status, rules))).where("change = 'TRIGGERED'")
    want = alert_outbox(fan_out(fired, subs), Q._status(tables))
    stored = spark.read.parquet(f"{work}/outbox")
    assert stored.select("batch").distinct().count() == 4
    got = read_outbox(spark, f"{work}/outbox").select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # Started again without news, it adds nothing.
    n = stored.count()
    run()
    assert spark.read.parquet(f"{work}/outbox").count() == n


def test_a_run_updated_again_is_not_its_own_past(spark, tmp_path):
    def suite(run, bad):
        return (run, "A", "x", "x", 5, 5 - bad, bad, "t", "u")

    state = SJ.alert_state_table(str(tmp_path / "state"))
    subs = spark.createDataFrame([("any_failure", "user", "a", False)], SUBSCRIPTION)
    current = {}
    on_batch = SJ.alert_batches(
        lambda: inline_tables(spark, suite_status=list(current.values())),
        Q.rules(spark).where("rule_id = 'any_failure'"), subs, state, str(tmp_path / "outbox"),
    )

    def update(batch_id, *rows):
        for r in rows:
            current[r[0]] = r
        on_batch(spark.createDataFrame([(r[0],) for r in rows], "run_id string"), batch_id)
        stored = spark.read.parquet(f"{tmp_path}/outbox/batch={batch_id}").collect()
        return sorted(r.run_id for r in stored)

    assert update(0, suite("1", 0), suite("2", 1)) == ["2"]
    # The same run again: it is still the run that triggered.
    assert update(1, suite("2", 2)) == ["2"]
    assert update(2, suite("3", 1)) == []
    assert update(3, suite("4", 0)) == []
    assert update(4, suite("5", 1), suite("6", 1)) == ["5"]
    # A repeated batch gives the same.
    assert update(4, suite("5", 1), suite("6", 1)) == ["5"]
    rows = read_outbox(spark, str(tmp_path / "outbox")).collect()
    assert sorted(r.run_id for r in rows) == ["2", "5"]
    # An older run is updated: the runs behind it keep their state.
    assert update(5, suite("3", 2)) == []
    assert update(6, suite("7", 1)) == []
    # Run 5 recovers after the fact, so run 6 is where it started.
    assert update(7, suite("5", 0)) == ["6"]


def test_debounce_of_stream_and_batch_agree(spark, tmp_path):
    folder, work = str(tmp_path / "events"), str(tmp_path / "work")
    _split(spark, folder, 5)
    schema = read_events(spark, SF).schema
    stream = file_changes(spark, folder, "*.parquet", schema, 1).select("user_id", "ts")
    state = StateTable(
        f"{work}/state", ("user_id",),
        SJ.fire_state_table("x", "user_id", schema["user_id"].dataType).schema, 2,
    )
    on_batch = SJ.debounce_batches("user_id", "ts", 20_000, state, f"{work}/fires")
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    got = SJ.read_fires(spark, f"{work}/fires", "user_id")
    want = debounce(read_events(spark, SF), "user_id", "ts", 20_000)
    assert want.count() > 100
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_reports_from_any_of_several_tables(spark, tmp_path):
    folder, work = str(tmp_path / "tables"), str(tmp_path / "work")
    events = read_events(spark, SF).where("event_id < 60")
    save_tables(tables_from_events(events), folder)
    stream = table_changes(spark, folder, ["suite_status", "threshold_breach", "failed_check"])
    on_batch = SJ.report_batches(
        lambda: load_tables(spark, folder), f"{work}/reports", f"{work}/outbox"
    )
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    runs = load_tables(spark, folder).suite_status.select("run_id").distinct().count()
    assert read_outbox(spark, f"{work}/outbox").count() == runs
    files = whole_text(spark, f"{work}/reports")
    assert files.select("path").distinct().count() == runs
    assert files.where("path not like '%/report_run_%.html'").isEmpty()


def test_paused_job_is_not_started(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    assert SJ.start(stream, lambda df, i: None, str(tmp_path), paused=True) is None


def test_running_job_keeps_its_distance(spark, tmp_path):
    seen = []
    stream = spark.readStream.format("rate").option("rowsPerSecond", 10).load()
    query = SJ.start(stream, lambda df, i: seen.append(i), str(tmp_path / "c"), min_seconds=60)
    try:
        for _ in range(40):
            if seen:
                break
            time.sleep(0.5)
        time.sleep(2)
        assert query.isActive and len(seen) == 1
    finally:
        query.stop()


def test_state_table(spark, tmp_path):
    schema = SJ.fire_state_table("x", "k", StringType()).schema
    table = StateTable(str(tmp_path), ("k",), schema, compact_every=3)

    def rows(*pairs):
        df = spark.createDataFrame(list(pairs), "k string, t string")
        return df.select("k", F.col("t").cast("timestamp_ntz").alias("last_fire"))

    def state(before):
        return {r.k: str(r.last_fire)[8:10] for r in table.read(spark, before).collect()}

    assert state(0) == {}
    for i in range(8):
        table.read(spark, i)
        table.write(rows(("a", f"2024-01-{i + 1:02d}"), (f"k{i % 4}", f"2024-01-{i + 1:02d}")), i)
    assert state(8) == {"a": "08", "k0": "05", "k1": "06", "k2": "07", "k3": "08"}
    assert state(4) == {"a": "04", "k0": "01", "k1": "02", "k2": "03", "k3": "04"}




def test_a_timer_notifies_again_without_new_runs(spark, tmp_path):
    folder, out = str(tmp_path / "suites"), str(tmp_path / "fires")
    rows = [("1", "S", 5, 5, 0, 1), ("2", "S", 5, 4, 1, 2), ("2", "U", 5, 5, 0, 2)]
    schema = (
        "run_id string, suite_category string, total_count int, success_count int, failure_count int, ts timestamp_ntz"
    )
    add = lambda found: spark.createDataFrame(found, schema.replace("timestamp_ntz", "int")).withColumn(
        "ts", F.timestamp_seconds("ts").cast("timestamp_ntz")
    ).coalesce(1).write.mode("append").parquet(folder)
    add(rows)
    rules = spark.createDataFrame([("r", "failure_count", "GREATER_THAN", 0.0, 2)], ALERT_RULE)
    fires = notification_stream(spark.readStream.schema(schema).parquet(folder), rules)
    query = SJ.start(
        fires, lambda batch, i: batch.write.mode("append").parquet(out), f"{tmp_path}/c", min_seconds=1
    )

    def seen():
        try:
            return sorted((r.suite_category, r.run_id, r.reason) for r in spark.read.schema(fires.schema).parquet(out).collect())
        except Exception:  # noqa: BLE001
            return []

    try:
        end = time.time() + 90
        while time.time() < end and seen().count(("S", "2", "AGAIN")) < 2:
            time.sleep(1)
        assert set(seen()) == {("S", "2", "FIRST"), ("S", "2", "AGAIN")}
        assert seen().count(("S", "2", "FIRST")) == 1 and seen().count(("S", "2", "AGAIN")) >= 2
        add([("3", "S", 5, 5, 0, 10)])  # it is OK again
        progress = lambda: sum(p["numInputRows"] for p in query.recentProgress)
        while time.time() < end and progress() < 4:
            time.sleep(1)
        time.sleep(3)
        n = len(seen())
        time.sleep(5)
        assert len(seen()) == n
    finally:
        query.stop()


def test_notifications_of_a_stream_follow_the_newest_run(spark, tmp_path):
    folder = str(tmp_path / "suites")
    schema = (
        "run_id string, suite_category string, total_count int, success_count int, failure_count int, second long"
    )
    rules = spark.createDataFrame([("r", "failure_count", "GREATER_THAN", 0.0, 10)], ALERT_RULE)
    batches = [
        # the order within a batch is that of times and, within a second, of numbers
        [("10", "S", 1, 0, 1, 3), ("9", "S", 1, 1, 0, 3), ("8", "S", 1, 0, 1, 1)],
        [("11", "S", 1, 0, 1, 12), ("7", "S", 1, 1, 0, 2), ("12", "S", 1, 0, 1, 13)],
        [("13", "S", 1, 0, 1, None), ("14", "S", 1, 0, 1, 30), (None, "T", 1, 0, 1, 5), ("1", None, 1, 0, 1, 5)],
    ]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        stream = stream.withColumn("ts", F.timestamp_seconds("second").cast("timestamp_ntz")).drop("second")
        fires = notification_stream(stream, rules, order="numeric")
        SJ.start(fires, lambda batch, i: got.extend(batch.collect()), f"{tmp_path}/c", once=True).awaitTermination()
    seen = [(r.suite_category, r.run_id, r.reason) for r in got]
    assert sorted(s for s in seen if s[0] == "S") == [
        ("S", "10", "FIRST"), ("S", "12", "AGAIN"), ("S", "14", "AGAIN"), ("S", "8", "FIRST"),
    ]
    assert (None, "1", "FIRST") in seen and ("T", None, "FIRST") in seen


def test_an_update_without_change_sends_nothing(spark, tmp_path):
    work = str(tmp_path)
    suites = {"1": ("1", "S", "PASSED", "PASS", 5, 5, 0, "t", "u"), "2": ("2", "S", "FAILED", "FAIL", 5, 4, 1, "t", "u")}
    rules = spark.createDataFrame([("r", "failure_count", "GREATER_THAN", 0.0, 0)], ALERT_RULE)
    subs = spark.createDataFrame([("r", "user", "a", False)], SUBSCRIPTION)

    def batch(i, runs):
        on_batch = SJ.alert_batches(
            lambda: inline_tables(spark, suite_status=list(suites.values())), rules, subs,
            SJ.alert_state_table(f"{work}/state"), f"{work}/outbox",
        )
        on_batch(spark.createDataFrame([(r,) for r in runs], "run_id string"), i)
        return [r.run_id for r in spark.read.parquet(f"{work}/outbox/batch={i}").collect()]

    assert batch(0, ["1", "2"]) == ["2"]
    assert batch(1, ["1"]) == [] and batch(2, ["2"]) == []
    suites["1"] = ("1", "S", "FAILED", "FAIL", 5, 4, 1, "t", "u")
    # The first run fires now; the second one did already, and no longer follows an OK.
    assert batch(3, ["1"]) == ["1"]
    suites["1"] = ("1", "S", "PASSED", "PASS", 5, 5, 0, "t", "u")
    assert batch(4, ["1"]) == ["2"]
    # A run between two known ones.
    suites["15"] = ("15", "S", "FAILED", "FAIL", 5, 4, 1, "t", "u")
    assert batch(5, ["15"]) == ["15"]
