"""The jobs a user runs: chat report, email report, alert, scheduled snapshot, preview."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.operators.alerts import evaluate, notifications, run_verdicts, states, transitions
from runcourier.operators.cadence import Cadence, bounds, slots
from runcourier.operators.deliver import (
    alert_outbox,
    chat_outbox,
    email_outbox,
    fan_out,
    snapshot_outbox,
    snapshots,
)
from runcourier.operators.documents import documents
from runcourier.operators.render import write_reports
from runcourier.operators.runs import latest_at, resolve, run_key, run_status
from runcourier.session import cut
from runcourier.sources.params import ChatParams, EmailParams
from runcourier.sources.sample import sample_tables
from runcourier.sources.tables import ReportTables


def _of_param(tables: ReportTables, run_id: str | None, order: str) -> ReportTables:
    return tables.of_run(resolve(run_id, tables.suite_status, order))


def reports(tables: ReportTables, profile: str = "compact", mode: str = "first") -> DataFrame:
    """The rendered report of every run, in parts where it is long."""
    return documents(tables, profile, mode).select("run_id", "part_no", "n_parts", "offset", "html")


def append_new(rows: DataFrame, outbox: str, key: str = "delivery_id") -> None:
    """Add deliveries to an outbox, except those whose id it has: a job run again adds nothing.

    Only the ids of the outbox are read.
    """
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(outbox).select(key).distinct()
    except AnalysisException:  # nothing was sent yet
        known = None
    new = rows if known is None else cut(rows.join(known, key, "left_anti")).select(rows.columns)
    new.write.mode("append").parquet(outbox)


def chat_job(tables: ReportTables, params: ChatParams, folder: str, outbox: str) -> None:
    """Report file and chat message of one run. Without a URL the message is a preview."""
    report = documents(_of_param(tables, params.run_id, params.run_order)).persist()
    write_reports(report, folder)
    rows = chat_outbox(report, params.webhook_url, params.webhook_format, folder)
    append_new(rows, outbox)
    report.unpersist()


def email_job(
    tables: ReportTables, params: EmailParams, folder: str, outbox: str, token: str = ""
) -> None:
    """Report file and email of one run, in the form of the chosen provider."""
    report = documents(_of_param(tables, params.run_id, params.run_order)).persist()
    write_reports(report, folder)
    rows = email_outbox(
        report,
        params.provider,
        params.sender,
        params.recipients,
        params.subject,
        bool(params.dry_run),
        token,
    )
    append_new(rows, outbox)
    report.unpersist()


def rearmed_alert_job(
    tables: ReportTables, run_times: DataFrame, rules: DataFrame, subscriptions: DataFrame,
    run_id: str | None = None, paused: bool = False, order: str = "lexical",
) -> DataFrame:
    """As ``alert_job``, but an alert that stays triggered mails again ``rearm_seconds`` after its last mail.

    ``run_times`` has ``run_id`` and ``ts``. When an alert mailed last depends on all runs before.
    """
    target = resolve(run_id, tables.suite_status, order)
    fires = notifications(evaluate(tables.suite_status, rules), run_times, order=order)
    fires = fires.where(F.col("run_id") == target)
    if paused:
        fires = fires.where(F.lit(False))
    return alert_outbox(fan_out(fires, subscriptions), run_status(tables.of_run(target)))


def alert_job(
    tables: ReportTables, rules: DataFrame, subscriptions: DataFrame, run_id: str | None = None,
    paused: bool = False, order: str = "lexical",
) -> DataFrame:
    """Alert mails for one run, the latest by default: evaluate, decide, fan out.

    An alert that was triggered by the suite's run before does not fire again, whatever its rule says
    of ``rearm_seconds``; ``rearmed_alert_job`` honours that.
    """
    target = resolve(run_id, tables.suite_status, order)
    one = tables.of_run(target)
    key = run_key(order)
    number = F.lit(None) if order == "lexical" else target.try_cast("decimal(38,0)")
    this = F.struct(number.cast("decimal(38,0)").alias("n"), target.alias("t"))
    before = (
        tables.suite_status.where(key < this)
        .groupBy("suite_category")
        .agg(F.max(F.struct(key.alias("k"), "run_id")).alias("_m"))
        .select("suite_category", F.col("_m.run_id").alias("run_id"))
    )
    last = tables.suite_status.join(before, ["suite_category", "run_id"], "left_semi")
    seen = transitions(
        states(evaluate(one.suite_status, rules)), states(evaluate(last, rules)), order=order
    )
    fired = seen.where("change = 'TRIGGERED'")
    if paused:
        fired = fired.where(F.lit(False))
    return alert_outbox(fan_out(fired, subscriptions), run_status(one))


def alert_verdict(tables: ReportTables, rules: DataFrame, run_id: str | None = None) -> DataFrame:
    """Whether each rule fires for a run, the latest by default."""
    one = _of_param(tables, run_id, "lexical")
    return run_verdicts(evaluate(one.suite_status, rules))


def snapshot_job(
    runs: DataFrame, subscriptions: DataFrame, cadence: str | Cadence, zone: str,
    order: str = "lexical",
) -> DataFrame:
    """Scheduled mails: at every slot, the run that was the latest at that time.

    ``runs`` holds ``run_id`` and ``ts``, the time a run became known. Subscriptions name
    the cadence as their rule.
    """
    name = cadence if isinstance(cadence, str) else cadence.name
    due = slots(bounds(runs), cadence, zone)
    return snapshot_outbox(fan_out(snapshots(latest_at(runs, due, order=order), name), subscriptions))


LEDGER = "schedule string, slot timestamp_ntz"


def once_job(
    runs: DataFrame, subscriptions: DataFrame, schedule: str, ledger: str, outbox: str, zone: str,
    order: str = "lexical",
) -> None:
    """A one-time send: the run shown at the first slot, mailed once.

    The ledger names the schedules that are consumed; no slots are made for them any more. It is written
    behind the outbox, whose ids tell a job that was stopped in between what was sent.
    """
    spark = runs.sparkSession
    append_new(spark.createDataFrame([], LEDGER), ledger, "schedule")
    consumed = spark.read.schema(LEDGER).parquet(ledger).where(F.col("schedule") == schedule)
    limits = bounds(runs).withColumn("schedule", F.lit(schedule)).join(consumed, "schedule", "left_anti")
    due = slots(limits, "once", zone)
    shown = cut(snapshots(latest_at(runs, due, order=order), schedule))
    append_new(snapshot_outbox(fan_out(shown, subscriptions)), outbox)
    append_new(shown.select(F.col("rule_id").alias("schedule"), "slot"), ledger, "schedule")


def paired(alerts: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Instant alerts and scheduled snapshots in one outbox; ``kind`` tells them apart."""
    return alerts.unionByName(scheduled)


def preview(spark: SparkSession, folder: str, profile: str = "full") -> None:
    """Write the report of the embedded sample run."""
    write_reports(documents(sample_tables(spark), profile), folder)
