"""Streaming jobs: a table update leads to reports, alerts and deliveries.

Each job works in micro-batches. A micro-batch only tells which runs were touched; the
runs themselves are read from the full tables and processed by the same functions as in
a batch job. Batches run one after the other and each one owns the part of the output it
writes, so a restart leaves neither gaps nor duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runcourier.functions.ordered import previous
from runcourier.operators.alerts import evaluate
from runcourier.operators.cadence import debounce
from runcourier.operators.deliver import alert_outbox, chat_outbox, email_outbox, fan_out
from runcourier.operators.documents import documents
from runcourier.operators.render import write_reports
from runcourier.operators.runs import run_key, run_status
from runcourier.sources.params import EmailParams
from runcourier.sources.tables import ReportTables
from runcourier.streaming.state import StateTable, write_batch

# Fixed value: least time between two triggers.
MIN_SECONDS = 60


def start(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
    paused: bool = False,
    min_seconds: int = MIN_SECONDS,
) -> StreamingQuery | None:
    """Run ``on_batch`` for every micro-batch: all that is there now, or from now on.

    A running job starts at most one batch every ``min_seconds``. A paused job is not
    started at all.
    """
    if paused:
        return None
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    if once:
        # Timers ask for batches without data for ever; a catch-up ends with the data. The query
        # keeps the setting that it was started under.
        conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name)
        conf.set(name, "false")
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            conf.set(name, before)
    return writer.trigger(processingTime=f"{min_seconds} seconds").start()


def _touched(batch: DataFrame) -> DataFrame:
    return batch.select("run_id").where("run_id is not null").distinct()


def _report_batches(
    tables: Callable[[], ReportTables],
    folder: str,
    outbox: str,
    profile: str,
    deliveries: Callable[[DataFrame], DataFrame],
) -> Callable[[DataFrame, int], None]:
    """Render the touched runs, write their files and put their deliveries in the outbox."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        runs = _touched(batch).persist()
        try:
            report = documents(tables().of_runs(runs), profile).persist()
            write_reports(report, folder)
            write_batch(deliveries(report), outbox, batch_id)
            report.unpersist()
        finally:
            runs.unpersist()

    return on_batch


def report_batches(
    tables: Callable[[], ReportTables],
    folder: str,
    outbox: str,
    url: str = "",
    fmt: str = "slack",
    profile: str = "compact",
) -> Callable[[DataFrame, int], None]:
    """A report file and a chat message for every touched run."""
    return _report_batches(
        tables, folder, outbox, profile, lambda report: chat_outbox(report, url, fmt, folder)
    )


def email_batches(
    tables: Callable[[], ReportTables],
    folder: str,
    outbox: str,
    params: EmailParams,
    token: str = "",
    profile: str = "compact",
) -> Callable[[DataFrame, int], None]:
    """A report file and an email for every touched run."""

    def mails(report: DataFrame) -> DataFrame:
        return email_outbox(
            report,
            params.provider,
            params.sender,
            params.recipients,
            params.subject,
            bool(params.dry_run),
            token,
        )

    return _report_batches(tables, folder, outbox, profile, mails)


ALERT_STATE = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("suite_category", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("fired", T.BooleanType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def alert_state_table(path: str) -> StateTable:
    return StateTable(path, ("rule_id", "suite_category", "run_id"), ALERT_STATE)


def alert_batches(
    tables: Callable[[], ReportTables],
    rules: DataFrame,
    subscriptions: DataFrame,
    state: StateTable,
    outbox: str,
    order: str = "lexical",
) -> Callable[[DataFrame, int], None]:
    """Evaluate the touched runs, and tell subscribers about alerts that are triggered now and were not.

    The state has every run of a rule and suite, so runs may be updated in any order: a touched run is
    judged against the run before it, and the run behind a touched one is judged anew. Both are compared
    with what the state said before the batch, so an update that changes nothing sends nothing. A run that
    still triggers an alert, with another value, is told again.
    """
    keys = ["rule_id", "suite_category"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = _touched(batch).persist()
        evaluated = evaluate(tables().of_runs(runs).suite_status, rules)
        now = evaluated.groupBy(*keys, "run_id").agg(
            F.bool_or("fired").alias("fired"), F.sum(F.col("value").cast("double")).alias("value")
        ).persist()
        try:
            old = state.read(spark, batch_id).join(now.select(*keys).distinct(), keys, "left_semi")
            fired = _newly_triggered(old, now, keys, order)
            names = run_status(tables().of_runs(fired.select("run_id").distinct()))
            write_batch(alert_outbox(fan_out(fired, subscriptions), names), outbox, batch_id)
            state.write(now, batch_id)
        finally:
            now.unpersist()
            runs.unpersist()

    return on_batch


def _newly_triggered(old: DataFrame, now: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs that an alert is triggered by after a batch, but was not by before it, or with another value."""
    place = [*keys, "run_id"]
    was = old.select(*place, F.col("fired").alias("_was"), F.col("value").alias("_before"))
    new = now.select(*place, F.col("fired").alias("_now"), F.col("value").alias("_value"))
    # A value that is not known, as of a run that was not touched, has not changed.
    changed = F.coalesce(F.col("_value") != F.col("_before"), F.lit(False))
    both = was.join(new, place, "full_outer").withColumn("_changed", changed)
    known = both.select(*place, "_was", "_changed", F.coalesce("_now", "_was").alias("_is"))
    known = known.withColumn("_key", run_key(order))
    after = previous(known, keys, ["_key"], "_is")
    triggered = F.col("_is") & ~F.coalesce("previous__is", F.lit(False))
    after = after.where(triggered).select(*place, "_changed")
    before = previous(known.where("_was is not null"), keys, ["_key"], "_was")
    told = F.col("_was") & ~F.coalesce("previous__was", F.lit(False))
    told = before.where(told).select(*place, F.lit(True).alias("_told"))
    return after.join(told, place, "left").where("_told is null or _changed").select(*place)


def fire_state_table(path: str, key: str, key_type: T.DataType) -> StateTable:
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("last_fire", T.TimestampNTZType())]
    )
    return StateTable(path, (key,), schema)


def debounce_batches(
    key: str, ts: str, gap_seconds: int, state: StateTable, fires: str
) -> Callable[[DataFrame, int], None]:
    """Debounced fires of a stream of updates. The counts of a fire add up over batches."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        known = state.read(batch.sparkSession, batch_id)
        found = debounce(batch, key, ts, gap_seconds, known).persist()
        try:
            write_batch(found, fires, batch_id)
            state.write(found.groupBy(key).agg(F.max("fire_ts").alias("last_fire")), batch_id)
        finally:
            found.unpersist()

    return on_batch


def read_fires(spark, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(key, "fire_ts").agg(F.sum("n_updates").alias("n_updates"))
