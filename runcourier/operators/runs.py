"""Which run is meant: the latest, a named one, or the one known at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.functions.text import trim_all
from runcourier.schema import RUN_ORDERS, one_of
from runcourier.sources.tables import ReportTables


def latest_run(suite_status: DataFrame, order: str = "lexical") -> DataFrame:
    """The latest run id as a table of one row (null when there is none).

    Run ids are text, so the default order is that of text: ``'999'`` is later than
    ``'2088075'``. With ``order='numeric'`` they are compared as numbers and ids that are
    no numbers are left out.
    """
    one_of(order, RUN_ORDERS, "order")
    if order == "lexical":
        return suite_status.agg(F.max("run_id").alias("run_id"))
    number = F.col("run_id").try_cast("decimal(38,0)")
    return suite_status.agg(F.max_by("run_id", number).alias("run_id"))


def latest_id(suite_status: DataFrame, order: str = "lexical") -> Column:
    """The latest run id as a scalar subquery, to be used inside a filter."""
    return latest_run(suite_status, order).scalar()


def run_key(order: str = "lexical", run: str = "run_id") -> Column:
    """What runs are ordered by. As numbers, ids that are no numbers come first, as text."""
    one_of(order, RUN_ORDERS, "order")
    number = F.lit(None) if order == "lexical" else F.col(run).try_cast("decimal(38,0)")
    return F.struct(number.cast("decimal(38,0)").alias("n"), F.col(run).alias("t"))


def top_run(suite_status: DataFrame) -> DataFrame:
    """The latest run id by a top-1 sort; empty when there is no run."""
    return suite_status.select("run_id").orderBy(F.desc("run_id")).limit(1)


def run_status(tables: ReportTables) -> DataFrame:
    """The execution status of every run, the smallest of its suites."""
    return tables.suite_status.groupBy("run_id").agg(
        F.min("execution_status").alias("execution_status")
    )


def resolve(param: str | None | Column, suite_status: DataFrame, order: str = "lexical") -> Column:
    """The run id a job parameter stands for: blank, all space and null mean the latest."""
    latest = latest_id(suite_status, order)
    if isinstance(param, Column):
        return F.coalesce(F.nullif(trim_all(param), F.lit("")), latest)
    named = (param or "").strip()
    return F.lit(named) if named else latest


def latest_at(
    runs: DataFrame,
    slots: DataFrame,
    ts: str = "ts",
    slot: str = "slot",
    order: str = "lexical",
) -> DataFrame:
    """For every slot, the latest run among the runs known at that time.

    ``runs`` has ``run_id`` and the time it became known. Every run goes to the first slot at or
    after its time: one of the same hour, found in that hour's list of slots, or the first one of a
    later hour. Runs of a slot are reduced to the latest, combined before the shuffle. The windows
    then work on hours and on slots, never on runs.
    """
    hour = lambda c: F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")
    marks = slots.select(F.col(slot).alias("_t")).distinct()
    by_hour = marks.groupBy(hour("_t").alias("_h")).agg(F.collect_list("_t").alias("_slots"))
    known = runs.select(F.col(ts).cast("timestamp_ntz").alias("_ts"), "run_id").where("_ts is not null")
    known = known.withColumn("_h", hour("_ts"))
    hours = known.select("_h").distinct().join(by_hour, "_h", "full_outer")
    later = Window.orderBy("_h").rowsBetween(1, Window.unboundedFollowing)
    hours = hours.withColumn("_next", F.min(F.array_min("_slots")).over(later))
    placed = known.join(hours, "_h").select(
        "run_id",
        F.coalesce(
            F.array_min(F.filter("_slots", lambda s: s >= F.col("_ts"))), F.col("_next")
        ).alias("_t"),
    )
    run = F.struct(run_key(order).alias("k"), "run_id")
    per_slot = placed.where("_t is not null").groupBy("_t").agg(F.max(run).alias("_run"))
    # The running maximum takes in all rows of the same slot.
    running = F.max("_run").over(Window.orderBy("_t"))
    at = marks.join(per_slot, "_t", "left").select("_t", running.alias("_latest"))
    return slots.join(at.select(F.col("_t").alias(slot), F.col("_latest.run_id").alias("run_id")), slot, "left")
