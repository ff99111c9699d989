"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from runcourier.functions import text as X
from runcourier.operators import alerts, cadence, deliver, documents, render, runs, sections, spec
from runcourier.plans import jobs
from runcourier.schema import ALERT_RULE, SUBSCRIPTION
from runcourier.session import cut, work_path
from runcourier.sources import tables as T
from runcourier.sources.event_runs import (
    HOURLY,
    event_tables,
    read_events,
    tagged,
)
from runcourier.sources.params import ChatParams, EmailParams
from runcourier.streaming import changes as C
from runcourier.streaming import jobs as SJ
from runcourier.streaming import notify as NS
from runcourier.streaming import state as SS

Query = Callable[[SparkSession, str], DataFrame]

# Page size that splits the larger runs of the test data.
SMALL_PAGE = 3000
GAP_SECONDS = 6 * 3600


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            ("any_failure", "failure_count", "GREATER_THAN", 0.0, 0),
            ("many_failures", "failure_count", "GREATER_THAN", 1.0, 6 * 3600),
            ("large_suite", "total_count", "GREATER_THAN", 5.0, 2 * 3600),
        ],
        ALERT_RULE,
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations subscribe as users, regions as destinations."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    rule = "element_at(array('any_failure', 'many_failures', '15min'), cast({} % 3 as int) + 1)"
    users = nation.select(
        F.expr(rule.format("n_nationkey")).alias("rule_id"),
        F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("@example.com")).alias(
            "address"
        ),
        (F.col("n_nationkey") % 7 == 0).alias("paused"),
    )
    groups = region.select(
        F.expr(rule.format("r_regionkey")).alias("rule_id"),
        F.concat(F.lit("group-"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias(
            "address"
        ),
        F.lit(False).alias("paused"),
    )
    return deliver.subscribers(users, groups).select(*SUBSCRIPTION.names)


# ------------------------------------------------------------------ runs


def latest_run_summary(spark, sf_dir, fmt=HOURLY):
    return sections.section(event_tables(spark, sf_dir, fmt), "suite")


def latest_run_top1(spark, sf_dir, fmt=HOURLY):
    return runs.top_run(event_tables(spark, sf_dir, fmt).suite_status)


def latest_numeric_vs_lexical(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = orders.select(F.col("o_orderkey").cast("string").alias("run_id"))
    number = F.col("run_id").try_cast("decimal(38,0)")
    return ids.agg(
        F.max("run_id").alias("lexical"), F.max_by("run_id", number).alias("numeric")
    )


def latest_numeric(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = orders.select(F.col("o_orderkey").cast("string").alias("run_id"))
    return runs.latest_run(ids, "numeric")


def run_param_default(spark, sf_dir, fmt=HOURLY):
    events = tagged(read_events(spark, sf_dir), fmt)
    kind = F.col("event_id") % 4
    param = (
        F.when(kind == 0, "")
        .when(kind == 1, " \t ")
        .when(kind == 2, F.concat(F.lit(" "), "run_id", F.lit("\n")))
    )
    named = events.select(param.alias("param"), "run_id")
    # The latest run is taken from the whole table.
    resolved = runs.resolve(F.col("param"), named)
    return named.select(resolved.alias("resolved")).groupBy("resolved").agg(
        F.count("*").alias("n")
    )


def section_query(name, labels=False):
    def query(spark, sf_dir, fmt=HOURLY):
        return sections.section(event_tables(spark, sf_dir, fmt), name, labels=labels)

    return query


def failed_of_breached_runs(spark, sf_dir, fmt=HOURLY):
    """Failed checks of a list of runs: those with a breach."""
    tables = event_tables(spark, sf_dir, fmt)
    return tables.of_runs(sections.runs_with(tables, "threshold")).section("failed")


def breaches_of_failed_runs(spark, sf_dir, fmt=HOURLY):
    tables = event_tables(spark, sf_dir, fmt)
    return tables.of_runs(sections.runs_with(tables, "failed")).section("threshold")


# -------------------------------------------------------------- assembly


def assemble_counts(spark, sf_dir, fmt=HOURLY):
    report = sections.assemble(event_tables(spark, sf_dir, fmt))
    return report.select(
        "run_id",
        "page_no",
        "n_pages",
        F.col("request").isNotNull().alias("has_request"),
        F.col("suite.suite_category").alias("suite_category"),
        F.size("failed").alias("n_failed"),
        F.size("thresholds").alias("n_thresholds"),
    )


def assemble_pages(spark, sf_dir, fmt=HOURLY):
    report = sections.assemble(event_tables(spark, sf_dir, fmt), page_chars=SMALL_PAGE)
    return report.select(
        "run_id",
        "page_no",
        "n_pages",
        F.col("suite").isNotNull().alias("has_suite"),
        F.array_join("failed.test_code", ",").alias("test_codes"),
        F.array_join("thresholds.threshold_query_description", ",").alias("breaches"),
    )


def assemble_all_rows(spark, sf_dir, fmt=HOURLY):
    report = sections.assemble(event_tables(spark, sf_dir, fmt), mode="all")
    return report.select(
        "run_id",
        F.size("request").alias("n_requests"),
        F.array_join("suite.suite_category", ",").alias("suites"),
        F.array_join("failed.test_code", ",").alias("test_codes"),
        F.array_join("thresholds.threshold_query_description", ",").alias("breaches"),
    )


def first_row_per_run(spark, sf_dir, fmt=HOURLY):
    return sections.first_rows(event_tables(spark, sf_dir, fmt), "suite")


def first_row_by_window(spark, sf_dir, fmt=HOURLY):
    return sections.first_rows_by_window(event_tables(spark, sf_dir, fmt), "failed")


def incomplete_runs(spark, sf_dir, fmt=HOURLY):
    return sections.incomplete_runs(event_tables(spark, sf_dir, fmt))


def runs_without_request(spark, sf_dir, fmt=HOURLY):
    return sections.runs_without(event_tables(spark, sf_dir, fmt), "request")


def runs_with_breach(spark, sf_dir, fmt=HOURLY):
    return sections.runs_with(event_tables(spark, sf_dir, fmt), "threshold")


def counter_mismatch(spark, sf_dir, fmt=HOURLY):
    suites = event_tables(spark, sf_dir, fmt).suite_status
    broken = F.col("total_count") + F.when(F.col("total_count") % 3 == 0, 1).otherwise(0)
    return sections.counter_mismatch(suites.withColumn("total_count", broken.cast("int"))).select(
        "run_id", "suite_category", "total_count", "success_count", "failure_count"
    )


# ------------------------------------------------------------- rendering


def render_rows(spark, sf_dir, fmt=HOURLY):
    failed = event_tables(spark, sf_dir, fmt).failed_check
    html = render.render_rows(failed, "failed", "full")
    return failed.select("run_id", "test_code", html.alias("html"))


def _digest(pages: DataFrame) -> DataFrame:
    return render.sizes(pages).select(
        "run_id", "part_no", "n_parts", F.md5("html").alias("html_md5"), "n_chars", "n_bytes"
    )


def render_query(profile, mode="first"):
    def query(spark, sf_dir, fmt=HOURLY):
        return _digest(jobs.reports(event_tables(spark, sf_dir, fmt), profile, mode))

    return query


def strip_borders_query(spark, sf_dir, fmt=HOURLY):
    return _digest(render.sanitized(jobs.reports(event_tables(spark, sf_dir, fmt), "plain")))


def report_files(spark, sf_dir, fmt=HOURLY):
    """Write every report as a file and read the files back as whole texts."""
    return _files_of(spark, documents.documents(event_tables(spark, sf_dir, fmt)))


def _files_of(spark, docs):
    folder = work_path(spark, "reports")
    render.write_reports(docs, folder)
    files = T.whole_md5(spark, folder)
    run = F.url_decode(F.regexp_extract("path", r"/report_run_([^/]+)\.html$", 1))
    return files.select(run.alias("run_id"), F.col("md5").alias("html_md5"))


# Parts so short that a run of a year comes in many.
SHORT_PART = 20_000


def report_files_hot(spark, sf_dir):
    """Runs of a year, so that one holds most of the rows: each is one file, written from parts."""
    tables = event_tables(spark, sf_dir, "yyyy")
    return _files_of(spark, documents.documents(tables, "compact", part_chars=SHORT_PART))


def report_files_hot_all(spark, sf_dir):
    """The same with all requests and suites listed."""
    tables = event_tables(spark, sf_dir, "yyyy")
    return _files_of(spark, documents.documents(tables, "full", "all", part_chars=SHORT_PART))


def report_parts(spark, sf_dir):
    """Parts are behind each other without gaps, none much longer than asked for."""
    docs = documents.documents(event_tables(spark, sf_dir, "yyyyMM"), "plain", part_chars=SHORT_PART)
    order = Window.partitionBy("run_id").orderBy("part_no")
    before = F.lag(F.col("offset") + F.octet_length("html"), 1, 0).over(order)
    seen = docs.select("*", (F.col("offset") == before).alias("joined"))
    return seen.groupBy("run_id").agg(
        (F.count("*") == F.max("n_parts")).alias("complete"),
        F.bool_and("joined").alias("joined"),
        (F.max(F.length("html")) < 2 * SHORT_PART).alias("bounded"),
        F.sum(F.length("html")).alias("n_chars"),
        F.max("n_chars").alias("said_chars"),
        F.sum(F.octet_length("html")).alias("n_bytes"),
        F.max("n_bytes").alias("said_bytes"),
    )


def email_hot_run(spark, sf_dir):
    """One mail per run of a year; the payloads of its rows are one message."""
    docs = documents.documents(event_tables(spark, sf_dir, "yyyy"), "plain", part_chars=SHORT_PART)
    rows = deliver.email_outbox(docs, "graph", "", "a@example.com, b@example.com", dry_run=False)
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("part_no", "payload")))["payload"], "")
    mails = rows.groupBy("delivery_id", "run_id", "subject", "status", "n_chars", "n_bytes")
    return mails.agg(F.md5(whole).alias("payload_md5"))


def odd_ids(tables: T.ReportTables) -> T.ReportTables:
    """The tables with run ids that mean something in paths and links."""
    ends = F.array(*[F.lit(x) for x in ODD_ENDS])
    end = F.element_at(ends, F.right("run_id", F.lit(1)).cast("int") % len(ODD_ENDS) + 1)
    return tables.changed(lambda df: df.withColumn("run_id", F.concat("run_id", end)))


ODD_ENDS = ("", "/../../b", " %41 ", "/ä ß", "%2F..", "+&?#", "..")


def report_links(spark, sf_dir, fmt=HOURLY):
    """Every path that a card or a snapshot names, and whether a file is there."""
    folder = work_path(spark, "reports")
    docs = documents.documents(odd_ids(event_tables(spark, sf_dir, fmt)))
    render.write_reports(docs, folder)
    cards = deliver.chat_outbox(docs, "", "generic", folder).select("run_id", "payload")
    named = cards.select(
        "run_id", F.regexp_extract("payload", r"volume: (.*\.html)", 1).alias("path")
    )
    files = T.whole_text(spark, folder).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(True).alias("there")
    )
    named = named.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    found = named.join(files, "path", "left")
    back = F.url_decode(F.regexp_extract("path", r"/report_run_([^/]+)\.html$", 1))
    return found.select("run_id", F.coalesce("there", F.lit(False)).alias("there"), back.alias("id_of_path"))


def stored_tables(spark, sf_dir, fmt=HOURLY):
    """Store the tables, append the suites of failed runs once more, and read them again."""
    folder = work_path(spark, "tables")
    tables = event_tables(spark, sf_dir, fmt)
    T.save_tables(tables, folder)
    T.append(tables.suite_status.where("status = 'FAIL'"), f"{folder}/suite_status")
    stored = T.load_tables(spark, folder)
    return stored.suite_status.groupBy("run_id", "suite_category").agg(
        F.count("*").alias("n"), F.sum("total_count").alias("total")
    )


# ---------------------------------------------------------------- alerts


def alert_eval(spark, sf_dir, fmt=HOURLY):
    suites = event_tables(spark, sf_dir, fmt).suite_status
    return alerts.evaluate(suites, rules(spark)).drop("rearm_seconds")


def alert_run_verdict(spark, sf_dir, fmt=HOURLY):
    suites = event_tables(spark, sf_dir, fmt).suite_status
    return alerts.run_verdicts(alerts.evaluate(suites, rules(spark)))


def _transitions(spark, sf_dir, fmt=HOURLY):
    suites = event_tables(spark, sf_dir, fmt).suite_status
    state = alerts.states(alerts.evaluate(suites, rules(spark)))
    return alerts.transitions(state, rows_per_key=alerts.largest_suite(suites))


def alert_transitions(spark, sf_dir, fmt=HOURLY):
    return _transitions(spark, sf_dir, fmt)


def alert_transitions_sliced(spark, sf_dir, fmt=HOURLY):
    """The same state changes with the suites cut into ranges, as for very many runs."""
    suites = event_tables(spark, sf_dir, fmt).suite_status
    state = alerts.states(alerts.evaluate(suites, rules(spark)))
    return alerts.transitions(state, window_rows=100)


def _run_times(spark, sf_dir, fmt=HOURLY):
    return tagged(read_events(spark, sf_dir), fmt).groupBy("run_id").agg(F.min("ts").alias("ts"))


def alert_notifications(spark, sf_dir, fmt=HOURLY):
    suites = event_tables(spark, sf_dir, fmt).suite_status
    evaluated = alerts.evaluate(suites, rules(spark))
    return alerts.notifications(evaluated, _run_times(spark, sf_dir, fmt))


def _status(tables):
    return tables.suite_status.groupBy("run_id").agg(
        F.min("execution_status").alias("execution_status")
    )


def subscribers(spark, sf_dir):
    """Customers as users and suppliers as group destinations, in one list."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    users = customer.select(F.lower("c_name").alias("address"), F.col("c_nationkey").alias("team"))
    groups = supplier.select(F.lower("s_name").alias("address"), F.col("s_nationkey").alias("team"))
    return deliver.subscribers(users, groups)


def subscription_records(spark, sf_dir):
    everyone = subscribers(spark, sf_dir)
    kind, address = F.col("kind"), F.col("address")
    return everyone.select(
        "kind",
        "address",
        deliver.subscription_record(kind, address).alias("schedule_record"),
        deliver.alert_subscription_record(kind, address).alias("alert_record"),
    )


def alert_fanout(spark, sf_dir, fmt=HOURLY):
    fired = _transitions(spark, sf_dir, fmt).where("change = 'TRIGGERED'")
    sent = deliver.fan_out(fired, subscriptions(spark, sf_dir))
    return sent.select("rule_id", "suite_category", "run_id", "kind", "address")


def _alert_outbox(spark, sf_dir, fmt=HOURLY):
    tables = event_tables(spark, sf_dir, fmt)
    fired = _transitions(spark, sf_dir, fmt).where("change = 'TRIGGERED'")
    sent = deliver.fan_out(fired, subscriptions(spark, sf_dir))
    return deliver.alert_outbox(sent, _status(tables))


def alert_outbox(spark, sf_dir, fmt=HOURLY):
    return _alert_outbox(spark, sf_dir, fmt)


def alert_mails_again(spark, sf_dir, fmt=HOURLY):
    """Mails of all notifications, also of alerts that stay triggered."""
    fires = alert_notifications(spark, sf_dir, fmt)
    sent = deliver.fan_out(fires, subscriptions(spark, sf_dir))
    return deliver.alert_outbox(sent, _status(event_tables(spark, sf_dir, fmt)))


def alert_job_rearmed(spark, sf_dir, fmt="yyyyMMdd"):
    """The alert job for the latest run that mails anything."""
    tables = event_tables(spark, sf_dir, fmt)
    times = _run_times(spark, sf_dir, fmt)
    days = daily_rules(spark)
    last = alerts.notifications(alerts.evaluate(tables.suite_status, days), times)
    run = last.where("reason = 'AGAIN'").agg(F.max("run_id")).first()[0]
    return jobs.rearmed_alert_job(tables, times, days, subscriptions(spark, sf_dir), run)


def alert_bodies(spark, sf_dir, fmt=HOURLY):
    """Alert mails that name the digest of their run's plain report, and whether a body is there."""
    tables = event_tables(spark, sf_dir, fmt)
    bodies = cut(deliver.report_bodies(documents.documents(tables, "plain")))
    fired = _transitions(spark, sf_dir, fmt).where("change = 'TRIGGERED'")
    sent = deliver.fan_out(fired, subscriptions(spark, sf_dir))
    mails = deliver.alert_outbox(sent, _status(tables), folder="/r", bodies=bodies)
    named = mails.withColumn("digest", F.get_json_object("payload", "$.body_md5"))
    there = bodies.select("digest", F.lit(True).alias("there"))
    found = named.join(there, "digest", "left")
    return found.select("delivery_id", "run_id", "payload", F.coalesce("there", F.lit(False)).alias("there"))


def runs_by_bucket(spark, sf_dir, fmt=HOURLY):
    """Tables stored in run buckets, and the failed checks of the runs of one day read from theirs."""
    folder = work_path(spark, "by-run")
    T.save_run_tables(event_tables(spark, sf_dir, fmt), folder)
    tables = T.load_run_tables(spark, folder)
    day = tables.suite_status.agg(F.min("run_id")).first()[0] or ""
    runs_ = tables.suite_status.where(F.col("run_id").startswith(day[:8])).select("run_id").distinct()
    return tables.of_runs(cut(runs_)).section("failed")


def daily_rules(spark):
    return rules(spark).withColumn("rearm_seconds", F.col("rearm_seconds") * 12)


def stream_notifications(spark, sf_dir, fmt=HOURLY):
    """Notifications from a stream of suite rows in five micro-batches, with state and timers."""
    work = _notified(spark, sf_dir, fmt)
    return spark.read.parquet(f"{work}/fires/*").drop("batch")


def stream_mails_again(spark, sf_dir, fmt=HOURLY):
    """Mails of these notifications, read back from the outbox."""
    work = _notified(spark, sf_dir, fmt)
    return SS.read_outbox(spark, f"{work}/outbox")


def _notified(spark, sf_dir, fmt):
    work = work_path(spark, "notified")
    tables = event_tables(spark, sf_dir, fmt)
    timed = tables.suite_status.join(_run_times(spark, sf_dir, fmt), "run_id")
    # Five spans of time, each some files in a folder of its own.
    first = timed.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    fifth = F.floor(5 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1))
    lohi = first.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("lo", "hi")])
    spans = cut(timed.crossJoin(F.broadcast(lohi)).withColumn("span", fifth))  # one row of limits
    schema = timed.schema
    notified = NS.notification_batches(lambda: tables, subscriptions(spark, sf_dir), f"{work}/outbox")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        SS.write_batch(batch, f"{work}/fires", batch_id)
        notified(spark.read.schema(batch.schema).parquet(f"{work}/fires/batch={batch_id}"), batch_id)

    for i in range(5):
        own = spans.where(F.col("span") == i).select(*timed.columns)
        own.write.mode("append").parquet(f"{work}/suites")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{work}/suites")
        fires = NS.notification_stream(stream, rules(spark))
        SJ.start(fires, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    return work


def alert_latest(spark, sf_dir, fmt=HOURLY):
    tables = event_tables(spark, sf_dir, fmt)
    return jobs.alert_job(tables, rules(spark), subscriptions(spark, sf_dir)).select(
        "run_id", "channel", "address", "subject"
    )


# -------------------------------------------------------------- delivery


def parse_recipients(spark, sf_dir):
    """Every text as a list of entries, one row per entry."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", F.posexplode(X.split_list(F.col("text"))).alias("position", "entry")
    ).select("doc_id", "position", F.md5("entry").alias("entry_md5"))


def _first(spark, sf_dir, fmt=HOURLY):
    return sections.heads(event_tables(spark, sf_dir, fmt))


def subject_line(spark, sf_dir, fmt=HOURLY):
    report = _first(spark, sf_dir, fmt)
    given = F.when(F.col("suite.total_count") % 2 == 0, F.concat(F.lit(" Run "), "run_id"))
    status = F.when(F.col("suite.total_count") % 5 != 0, F.col("suite.execution_status"))
    return report.select(
        "run_id",
        deliver.subject_line(F.col("run_id"), status, given).alias("subject"),
        deliver.alert_subject(F.col("run_id"), status).alias("alert_subject"),
    )


def card_text(spark, sf_dir, fmt=HOURLY):
    path = X.report_path("/reports", F.col("run_id"))
    return _first(spark, sf_dir, fmt).select(
        "run_id", deliver.card_text(F.col("suite"), path).alias("text")
    )


def card_text_link(spark, sf_dir, fmt=HOURLY):
    link = F.when(F.col("request").isNotNull(), F.concat(F.lit("https://example.com/"), "run_id"))
    return _first(spark, sf_dir, fmt).select(
        "run_id", deliver.card_text_link(F.col("suite"), link).alias("text")
    )


def chat_payload(spark, sf_dir, fmt=HOURLY):
    path = X.report_path("/reports", F.col("run_id"))
    text = deliver.card_text(F.col("suite"), path)
    return _first(spark, sf_dir, fmt).select(
        "run_id", deliver.chat_payload(F.col("suite"), text, "slack").alias("payload")
    )


def card_payload(spark, sf_dir, fmt=HOURLY):
    path = X.report_path("/reports", F.col("run_id"))
    text = deliver.card_text(F.col("suite"), path)
    return _first(spark, sf_dir, fmt).select(
        "run_id", deliver.chat_payload(F.col("suite"), text, "teams").alias("payload")
    )


def chat_outbox(spark, sf_dir, fmt=HOURLY):
    report = sections.heads(event_tables(spark, sf_dir, fmt))
    return deliver.chat_outbox(report, "https://example.com/hook", "generic", "/reports")


def _mails(spark, sf_dir, fmt=HOURLY):
    """Reports with a provider, recipients and a token that differ from run to run."""
    report = sections.assemble(event_tables(spark, sf_dir, fmt))
    n = F.col("suite.total_count")
    provider = (
        F.when(n % 4 == 0, "resend").when(n % 4 == 1, "graph").when(n % 4 == 2, "ses")
    )
    to = F.when(
        n % 3 != 0, F.concat(F.lit(" , "), F.col("suite.run_user"), F.lit(" ,,team@example.com "))
    ).otherwise(" , ")
    return report.select(
        "run_id",
        render.document(report, "plain").alias("html"),
        deliver.subject_line(F.col("run_id"), F.col("suite.execution_status")).alias("subject"),
        F.coalesce(provider, F.lit("fax")).alias("provider"),
        F.when(n % 2 == 0, "sender@example.com").otherwise("").alias("sender"),
        X.split_list(to).alias("recipients"),
        F.when(n % 5 != 0, F.md5("run_id")).alias("token"),
        X.is_true(F.when(n % 2 == 0, "true").otherwise("false")).alias("dry_run"),
    )


def email_query(provider):
    def query(spark, sf_dir, fmt=HOURLY):
        mails = _mails(spark, sf_dir, fmt)
        payload = deliver.email_payload(
            provider, F.col("sender"), F.col("subject"), F.col("html"), F.col("recipients")
        )
        return mails.select("run_id", F.md5(payload).alias("payload_md5"))

    return query


def dry_run_preview(spark, sf_dir, fmt=HOURLY):
    mails = _mails(spark, sf_dir, fmt)
    preview = deliver.email_preview(
        F.col("provider"), F.col("sender"), F.col("subject"), F.col("html"), F.col("recipients"),
        F.col("token"),
    )
    return mails.select("run_id", preview.alias("preview"))


def email_route(spark, sf_dir, fmt=HOURLY):
    mails = _mails(spark, sf_dir, fmt)
    status = deliver.email_status(F.col("provider"), F.col("recipients"), F.col("dry_run"))
    return mails.select(
        "run_id", "provider", F.size("recipients").alias("n_recipients"), status.alias("status")
    )


def email_outbox(spark, sf_dir, fmt=HOURLY):
    docs = documents.documents(event_tables(spark, sf_dir, fmt))
    rows = deliver.email_outbox(docs, "resend", "", "a@example.com, b@example.com", dry_run=False)
    return rows.withColumn("payload", F.md5("payload"))


def text_utils(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    return docs.select(
        "doc_id",
        X.one_line(text).alias("one_line"),
        X.tail(text, 400).alias("tail"),
        F.md5(X.trim_all(text)).alias("trimmed_md5"),
        X.n_chars(text).alias("n_chars"),
        X.n_bytes(text).alias("n_bytes"),
        F.octet_length(X.utf8(text)).cast("bigint").alias("n_encoded"),
        X.redact(text).alias("redacted"),
        F.md5(X.form_encode(lang=F.col("lang"), text=text)).alias("form_md5"),
        F.md5(X.markdown_breaks(text)).alias("markdown_md5"),
    )


def json_utils(spark, sf_dir):
    events = read_events(spark, sf_dir)
    noisy = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("tool 1.2\n"), F.col("props")))
    said = F.coalesce(noisy, F.lit("no answer"))
    return events.select(
        "event_id",
        X.json_part(said).alias("part"),
        X.json_field(said, "$.k").cast("int").alias("k"),
        X.report_path("/reports", F.col("event_id").cast("string")).alias("path"),
    )


# --------------------------------------------------------------- cadence


def cadence_query(name):
    def query(spark, sf_dir):
        return cadence.slots(cadence.bounds(read_events(spark, sf_dir)), name)

    return query


def snapshot_query(name):
    def query(spark, sf_dir, fmt=HOURLY):
        known = tagged(read_events(spark, sf_dir), fmt).select("run_id", "ts")
        due = cadence.slots(cadence.bounds(known), name)
        return runs.latest_at(known, due)

    return query


def debounce_updates(spark, sf_dir):
    return cadence.debounce(read_events(spark, sf_dir), "user_id", "ts", GAP_SECONDS)


def debounce_runs(spark, sf_dir):
    """All events of a type as updates of one key, at least a minute apart."""
    return cadence.debounce(read_events(spark, sf_dir), "event_type", "ts", 60)


def paired_delivery(spark, sf_dir, fmt=HOURLY):
    known = _run_times(spark, sf_dir, fmt)
    scheduled = jobs.snapshot_job(known, subscriptions(spark, sf_dir), "15min", cadence.ZONE)
    both = jobs.paired(_alert_outbox(spark, sf_dir, fmt), scheduled)
    return both.select("kind", "channel", "address", "run_id", "subject", "payload", "status")


# ------------------------------------------------------------------ spec


def report_layout(spark, sf_dir, fmt=HOURLY):
    return spec.live_layout(event_tables(spark, sf_dir, fmt))


def report_definition(spark, sf_dir, fmt=HOURLY):
    return spec.report_definition(event_tables(spark, sf_dir, fmt))


def upsert_definitions(spark, sf_dir, fmt=HOURLY):
    """Definitions of runs with a request, updated and completed from the runs with a breach."""
    tables = event_tables(spark, sf_dir, fmt)
    existing = tables.run_request.select(
        F.col("run_id").alias("id"), F.col("task_id").alias("name"), F.lit(0).alias("version")
    )
    updates = tables.threshold_breach.groupBy(F.col("run_id").alias("id")).agg(
        F.max("threshold_query_description").alias("name"),
        F.count("*").cast("int").alias("version"),
    )
    return T.upsert(existing, updates, ["id"])


def upsert_buckets(spark, sf_dir, fmt=HOURLY):
    """Definitions stored in buckets, upserted twice; only the buckets of the updates are written."""
    path = work_path(spark, "definitions")
    tables = event_tables(spark, sf_dir, fmt)
    existing = tables.run_request.select(
        F.col("run_id").alias("id"), F.col("task_id").alias("name"), F.lit(0).alias("version")
    )
    updates = tables.threshold_breach.groupBy(F.col("run_id").alias("id")).agg(
        F.max("threshold_query_description").alias("name"), F.count("*").cast("int").alias("version")
    )
    T.save_buckets(existing, path, ["id"])
    T.upsert_buckets(spark, path, updates, ["id"])
    T.upsert_buckets(spark, path, updates.withColumn("version", F.col("version") + 10), ["id"])
    return T.read_buckets(spark, path)


def once_sent(spark, sf_dir, fmt=HOURLY):
    """The one-time send, run on the runs of the first days, again, and again on all runs."""
    work = work_path(spark, "once")
    known = _run_times(spark, sf_dir, fmt)
    first = known.agg(F.min("ts")).first()[0]
    early = known.where(F.col("ts") < F.lit(first) + F.expr("interval 3 days"))
    subs = subscriptions(spark, sf_dir).where("rule_id = '15min'").withColumn("rule_id", F.lit("launch"))
    for seen in (early, early, known):
        jobs.once_job(seen, subs, "launch", f"{work}/ledger", f"{work}/outbox", cadence.ZONE)
    return spark.read.parquet(f"{work}/outbox").select("channel", "address", "run_id", "payload")


# ------------------------------------------------------------- streaming


def _event_stream(spark, sf_dir):
    schema = read_events(spark, sf_dir).schema
    return C.file_changes(spark, sf_dir, "events.parquet", schema)


def stream_outbox(spark, sf_dir, fmt=HOURLY):
    """Alert mails from the stream of updates, read back from the outbox."""
    work = work_path(spark, "alerts")
    stream = tagged(_event_stream(spark, sf_dir), fmt).select("run_id")
    on_batch = SJ.alert_batches(
        lambda: event_tables(spark, sf_dir, fmt),
        rules(spark),
        subscriptions(spark, sf_dir),
        SJ.alert_state_table(f"{work}/state"),
        f"{work}/outbox",
    )
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    return SS.read_outbox(spark, f"{work}/outbox")


def stream_alerts_again(spark, sf_dir, fmt=HOURLY):
    """Alert mails from five micro-batches, in which older runs are updated after newer ones."""
    return _all_sent(spark, sf_dir, fmt, (0, 1, 0, 2, 3))


def stream_alerts_once(spark, sf_dir, fmt=HOURLY):
    """All rows that five micro-batches sent: runs that are updated again are mailed once.

    Ranges arrive in their order at first, since a run is mailed by what is known when it comes.
    """
    return _all_sent(spark, sf_dir, fmt, (0, 1, 0, 2, 3), latest=False)


def _all_sent(spark, sf_dir, fmt, steps, latest=True):
    work = work_path(spark, "alerts")
    tables = event_tables(spark, sf_dir, fmt)
    runs_ = tables.suite_status.select("run_id").distinct()
    # Four ranges of run ids; their limits do not matter.
    ranged = cut(runs_.repartitionByRange(4, "run_id").withColumn("q", F.spark_partition_id()))
    on_batch = SJ.alert_batches(
        lambda: tables,
        rules(spark),
        subscriptions(spark, sf_dir),
        SJ.alert_state_table(f"{work}/state"),
        f"{work}/outbox",
    )
    for q in steps:
        ranged.where(F.col("q") == q).select("run_id").write.mode("append").parquet(f"{work}/updates")
        stream = C.file_changes(spark, f"{work}/updates", "*.parquet", "run_id string")
        SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    if latest:
        return SS.read_outbox(spark, f"{work}/outbox")
    return spark.read.parquet(f"{work}/outbox").drop("batch")


def stream_any_table(spark, sf_dir, fmt=HOURLY):
    """Runs that an update of any of three tables touched, over three micro-batches."""
    work = work_path(spark, "changes")
    tables = event_tables(spark, sf_dir, fmt)
    names = ["suite_status", "failed_check", "threshold_breach"]
    for name in names:
        T.append(tables.table(name).limit(0), f"{work}/tables/{name}")
    found = f"{work}/touched"
    for i, name in enumerate(names):
        T.append(tables.table(name), f"{work}/tables/{name}")
        stream = C.table_changes(spark, f"{work}/tables", names)
        on_batch = lambda batch, n: SS.write_batch(
            batch.groupBy("table", "run_id").agg(F.count("*").alias("n")), found, n
        )
        SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(found).groupBy("table", "run_id").agg(F.sum("n").alias("n")).select(
        F.col("table").alias("source"), "run_id", "n"
    )


def jobs_run_again(spark, sf_dir, fmt=HOURLY):
    """The chat and email jobs of the latest run, each run twice: what the outbox holds."""
    work = work_path(spark, "jobs")
    tables = event_tables(spark, sf_dir, fmt)
    mail = EmailParams(recipients="a@example.com", provider="ses", dry_run="false")
    for _ in range(2):
        jobs.chat_job(tables, ChatParams(webhook_url="https://example.com/h"), f"{work}/r", f"{work}/chat")
        jobs.email_job(tables, mail, f"{work}/r", f"{work}/mail")
    columns = ["delivery_id", "kind", "channel", "address", "run_id", "subject", "status"]
    chat = spark.read.parquet(f"{work}/chat").select(*columns)
    return chat.unionByName(spark.read.parquet(f"{work}/mail").select(*columns))


def run_by_id(spark, sf_dir, fmt=HOURLY):
    """The failed checks of one run, named by its id: the earliest with a breach."""
    tables = event_tables(spark, sf_dir, fmt)
    run = sections.runs_with(tables, "threshold").agg(F.min("run_id")).first()[0]
    return tables.of_run(run or "none").failed_check


def views_as_sql(spark, sf_dir, fmt=HOURLY):
    """The named datasets, as views that SQL reads."""
    T.register_views(event_tables(spark, sf_dir, fmt), "v_")
    return spark.sql(
        "SELECT s.run_id, s.suite_category, l.run_id IS NOT NULL AS is_latest, f.n AS n_failed"
        " FROM v_suite_status s LEFT JOIN v_latest_run_summary l"
        " ON l.run_id = s.run_id AND l.suite_category = s.suite_category"
        " LEFT JOIN (SELECT run_id, suite_category, count(*) AS n FROM v_failed_check GROUP BY ALL) f"
        " ON f.run_id = s.run_id AND f.suite_category = s.suite_category"
    )


def snapshot_half_minutes(spark, sf_dir, fmt=HOURLY):
    """The latest run every 30 seconds."""
    known = _run_times(spark, sf_dir, fmt)
    due = cadence.slots(cadence.bounds(known), cadence.Cadence("half", step="30 seconds"))
    return runs.latest_at(known, due)


def slots_half_hour_zone(spark, sf_dir):
    """Hourly slots of a zone that is half an hour off."""
    limits = cadence.bounds(read_events(spark, sf_dir))
    return cadence.slots(limits, "hourly", "Asia/Kolkata")


def transitions_numeric(spark, sf_dir):
    """State changes in the order of ids of different lengths: the order keys as runs."""
    state = _numeric_states(spark, sf_dir)
    return alerts.transitions(state, order="numeric")


def _numeric_states(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(
        F.lit("r").alias("rule_id"),
        F.col("o_orderpriority").alias("suite_category"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        (F.col("o_orderstatus") == "F").alias("fired"),
    )


def stream_reports(spark, sf_dir, fmt=HOURLY):
    """Chat messages from the stream of updates, read back from the outbox."""
    work = work_path(spark, "chat")
    stream = tagged(_event_stream(spark, sf_dir), fmt).select("run_id")
    on_batch = SJ.report_batches(
        lambda: event_tables(spark, sf_dir, fmt),
        f"{work}/reports",
        f"{work}/outbox",
        "https://example.com/hook",
        "generic",
    )
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    out = SS.read_outbox(spark, f"{work}/outbox")
    # The path of the report is that of the work folder.
    return out.select("run_id", "channel", "address", "subject", "status")


def stream_emails(spark, sf_dir, fmt=HOURLY):
    """Emails from the stream of updates, read back from the outbox."""
    work = work_path(spark, "emails")
    stream = tagged(_event_stream(spark, sf_dir), fmt).select("run_id")
    on_batch = SJ.email_batches(
        lambda: event_tables(spark, sf_dir, fmt),
        f"{work}/reports",
        f"{work}/outbox",
        EmailParams(recipients="a@example.com, b@example.com", dry_run="false"),
    )
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    return SS.read_outbox(spark, f"{work}/outbox").withColumn("payload", F.md5("payload"))


def stream_debounce(spark, sf_dir):
    work = work_path(spark, "fires")
    state = SJ.fire_state_table(f"{work}/state", "user_id", LongType())
    on_batch = SJ.debounce_batches("user_id", "ts", GAP_SECONDS, state, f"{work}/fires")
    stream = _event_stream(spark, sf_dir).select("user_id", "ts")
    SJ.start(stream, on_batch, f"{work}/checkpoint", once=True).awaitTermination()
    return SJ.read_fires(spark, f"{work}/fires", "user_id")


QUERIES: dict[str, Query] = {
    "latest_run_summary": latest_run_summary,
    "latest_run_top1": latest_run_top1,
    "latest_numeric_vs_lexical": latest_numeric_vs_lexical,
    "latest_numeric": latest_numeric,
    "run_param_default": run_param_default,
    "section_request": section_query("request"),
    "section_suite": section_query("suite"),
    "section_failed": section_query("failed"),
    "section_threshold": section_query("threshold"),
    "section_request_labels": section_query("request", labels=True),
    "failed_of_breached_runs": failed_of_breached_runs,
    "breaches_of_failed_runs": breaches_of_failed_runs,
    "assemble_counts": assemble_counts,
    "assemble_pages": assemble_pages,
    "assemble_all_rows": assemble_all_rows,
    "first_row_per_run": first_row_per_run,
    "first_row_by_window": first_row_by_window,
    "incomplete_runs": incomplete_runs,
    "runs_without_request": runs_without_request,
    "runs_with_breach": runs_with_breach,
    "counter_mismatch": counter_mismatch,
    "render_rows": render_rows,
    "render_full": render_query("full"),
    "render_compact": render_query("compact"),
    "render_plain": render_query("plain"),
    "render_all_rows": render_query("compact", "all"),
    "strip_borders": strip_borders_query,
    "report_files": report_files,
    "report_files_hot": report_files_hot,
    "report_files_hot_all": report_files_hot_all,
    "report_parts": report_parts,
    "email_hot_run": email_hot_run,
    "report_links": report_links,
    "stored_tables": stored_tables,
    "alert_eval": alert_eval,
    "alert_run_verdict": alert_run_verdict,
    "alert_transitions": alert_transitions,
    "alert_transitions_sliced": alert_transitions_sliced,
    "alert_notifications": alert_notifications,
    "subscribers": subscribers,
    "subscription_records": subscription_records,
    "alert_fanout": alert_fanout,
    "alert_outbox": alert_outbox,
    "alert_mails_again": alert_mails_again,
    "alert_bodies": alert_bodies,
    "runs_by_bucket": runs_by_bucket,
    "alert_job_rearmed": alert_job_rearmed,
    "alert_latest": alert_latest,
    "parse_recipients": parse_recipients,
    "subject_line": subject_line,
    "card_text": card_text,
    "card_text_link": card_text_link,
    "chat_payload": chat_payload,
    "card_payload": card_payload,
    "chat_outbox": chat_outbox,
    "email_payload_graph": email_query("graph"),
    "email_payload_ses": email_query("ses"),
    "email_payload_resend": email_query("resend"),
    "dry_run_preview": dry_run_preview,
    "email_route": email_route,
    "email_outbox": email_outbox,
    "text_utils": text_utils,
    "json_utils": json_utils,
    "cadence_15min": cadence_query("15min"),
    "cadence_hourly": cadence_query("hourly"),
    "cadence_daily": cadence_query("daily"),
    "cadence_weekdays": cadence_query("weekdays"),
    "cadence_weekly": cadence_query("weekly"),
    "cadence_once": cadence_query("once"),
    "snapshot_asof": snapshot_query("15min"),
    "snapshot_weekdays": snapshot_query("weekdays"),
    "debounce_updates": debounce_updates,
    "debounce_runs": debounce_runs,
    "paired_delivery": paired_delivery,
    "report_layout": report_layout,
    "report_definition": report_definition,
    "upsert_definitions": upsert_definitions,
    "upsert_buckets": upsert_buckets,
    "once_sent": once_sent,
    "stream_outbox": stream_outbox,
    "stream_alerts_again": stream_alerts_again,
    "stream_alerts_once": stream_alerts_once,
    "stream_any_table": stream_any_table,
    "jobs_run_again": jobs_run_again,
    "run_by_id": run_by_id,
    "views_as_sql": views_as_sql,
    "snapshot_half_minutes": snapshot_half_minutes,
    "slots_half_hour_zone": slots_half_hour_zone,
    "transitions_numeric": transitions_numeric,
    "stream_notifications": stream_notifications,
    "stream_mails_again": stream_mails_again,
    "stream_reports": stream_reports,
    "stream_emails": stream_emails,
    "stream_debounce": stream_debounce,
}
