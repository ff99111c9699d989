"""Report tables derived from an event table, as input for tests and benchmarks.

A run is a span of time (an hour by default), a suite is an event type, and an event
with a value above 100 is a failed check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.sources.tables import ReportTables

HOURLY = "yyyyMMddHH"
PER_MINUTE = "yyyyMMddHHmm"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tagged(events: DataFrame, run_format: str = HOURLY) -> DataFrame:
    return events.select(
        "*",
        F.date_format("ts", run_format).alias("run_id"),
        F.upper("event_type").alias("suite_category"),
        (F.col("value") > 100).alias("bad"),
    )


def tables_from_events(events: DataFrame, run_format: str = HOURLY) -> ReportTables:
    e = tagged(events, run_format)
    return ReportTables(
        run_request=_requests(e),
        suite_status=_suites(e),
        failed_check=_failed(e),
        threshold_breach=_breaches(e),
    )


def event_tables(spark: SparkSession, sf_dir: str, run_format: str = HOURLY) -> ReportTables:
    return tables_from_events(read_events(spark, sf_dir), run_format)


def _suites(e: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("bad"))
    elapsed = F.expr(
        "date_format(timestamp_ntz'2000-01-01 00:00:00' "
        "+ make_dt_interval(0, 0, 0, timestampdiff(SECOND, first_ts, last_ts)), 'HH:mm:ss')"
    )
    grouped = e.groupBy("run_id", "suite_category").agg(
        F.count("*").cast("int").alias("total_count"),
        bad.cast("int").alias("failure_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("user_id").alias("user_id"),
    )
    failed = F.col("failure_count") > 0
    return grouped.select(
        "run_id",
        "suite_category",
        F.when(failed, "FAILED").otherwise("PASSED").alias("execution_status"),
        F.when(failed, "FAIL").otherwise("PASS").alias("status"),
        "total_count",
        (F.col("total_count") - F.col("failure_count")).cast("int").alias("success_count"),
        "failure_count",
        elapsed.alias("elapsed_time"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("run_user"),
    )


def _requests(e: DataFrame) -> DataFrame:
    grouped = e.groupBy("run_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("event_id").alias("event_id"),
        F.min("ts").alias("ts"),
    )
    day = F.col("ts").cast("date")
    return grouped.where(F.col("event_id") % 10 != 0).select(
        "run_id",
        F.concat(F.lit("S-"), "user_id").alias("super_client_name"),
        F.date_format(day, "yyyy-MM-dd").alias("request_run_date"),
        F.upper(F.md5(F.substring("run_id", 1, 8))).alias("parent_request_id"),
        F.upper(F.md5("run_id")).alias("request_id"),
        F.concat(F.lit("UW-"), "event_id").alias("task_id"),
        F.date_format(F.date_add(day, 1), "yyyy-MM-dd").alias("forecast_start_date"),
        F.lit("LOB").alias("lob"),
        F.lit("NA").alias("app_id"),
    )


def _failed(e: DataFrame) -> DataFrame:
    return e.where("bad").select(
        "run_id",
        "suite_category",
        F.concat(F.lit("TQ"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("test_code"),
        F.col("event_type").alias("tags"),
        F.concat("props", F.lit(" <"), "event_id", F.lit("> & 'late'")).alias("test_description"),
        F.when(F.col("event_id") % 7 == 0, "Query Statement Failed")
        .otherwise("FAIL")
        .alias("execution_status"),
    )


def _breaches(e: DataFrame) -> DataFrame:
    return (
        e.groupBy("run_id", "suite_category")
        .agg(F.max("value").alias("top"))
        .where("top > 200")
        .select(
            "run_id",
            F.concat(F.lit("Outlier present in "), "suite_category").alias(
                "threshold_query_description"
            ),
        )
    )
