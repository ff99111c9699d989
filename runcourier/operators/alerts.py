"""Threshold alerts: rules on run counters, run verdicts, state changes, re-arming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.functions.ordered import WINDOW_ROWS, previous, running_sum
from runcourier.operators.runs import run_key
from runcourier.schema import ALERT_OPS, COUNTERS
from runcourier.session import join_config


def metrics(suite_status: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counters of a suite as rows of ``(metric, value)``."""
    ids = ["run_id", "suite_category", *keep]
    return suite_status.unpivot(ids, list(COUNTERS), "metric", "value")


def evaluate(suite_status: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every rule on every suite row. A missing value does not fire. ``keep``: columns to carry on."""
    joined = join_config(metrics(suite_status, keep), rules, "metric")
    above = F.coalesce(F.col("value").cast("double") > F.col("threshold"), F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("unknown alert operator: "), F.col("op")))
    fired = F.when(F.col("op").isin(*ALERT_OPS), above).otherwise(unknown.cast("boolean"))
    return joined.select(
        "rule_id", "run_id", "suite_category", "metric", "value", "threshold", "rearm_seconds",
        fired.alias("fired"),
        *keep,
    )


def run_verdicts(evaluated: DataFrame) -> DataFrame:
    """A rule fires for a run when it fires for any of its suites."""
    return evaluated.groupBy("rule_id", "run_id").agg(
        F.bool_or("fired").alias("fired"),
        F.count_if("fired").alias("n_fired"),
        F.sum("value").alias("total_value"),
    )


def states(evaluated: DataFrame) -> DataFrame:
    """One state per rule, suite and run."""
    return evaluated.groupBy("rule_id", "suite_category", "run_id").agg(
        F.bool_or("fired").alias("fired")
    )


def largest_suite(suite_status: DataFrame) -> int:
    """Rows of the most frequent suite: a bound for the states of a rule on one suite.

    Reads one column of the table and combines it before the shuffle.
    """
    return suite_status.groupBy("suite_category").count().agg(F.max("count")).first()[0] or 0


def with_previous(
    state: DataFrame,
    initial: DataFrame | None = None,
    window_rows: int = WINDOW_ROWS,
    rows_per_key: int | None = None,
    order: str = "lexical",
) -> DataFrame:
    """Each state with the one of the run before, as ``fired_before``.

    Runs are in the order of their ids, as text or as numbers (``order``).

    ``initial`` gives the state before the first run, as ``(rule_id, suite_category,
    fired)``; without it every rule starts as OK.
    """
    keys = ["rule_id", "suite_category"]
    keyed = state.withColumn("_key", run_key(order))
    seen = previous(keyed, keys, ["_key"], "fired", window_rows, rows_per_key)
    start = F.lit(False)
    if initial is not None:
        before = initial.select(*keys, F.col("fired").alias("_initial"))
        seen = seen.join(before, keys, "left")
        start = F.coalesce("_initial", F.lit(False))
    was = F.coalesce("previous_fired", start)
    return seen.select(*keys, "run_id", "fired", was.alias("fired_before"))


def changes(seen: DataFrame) -> DataFrame:
    """The state changes among states that know the one before them."""
    change = F.when(F.col("fired"), "TRIGGERED").otherwise("RESOLVED")
    return seen.where(F.col("fired") != F.col("fired_before")).select(
        "rule_id", "suite_category", "run_id", "fired", change.alias("change")
    )


def transitions(
    state: DataFrame,
    initial: DataFrame | None = None,
    window_rows: int = WINDOW_ROWS,
    rows_per_key: int | None = None,
    order: str = "lexical",
) -> DataFrame:
    """State changes of a rule on a suite, in the order of the runs.

    A triggered alert does not fire again before it went back to OK.
    """
    return changes(with_previous(state, initial, window_rows, rows_per_key, order))


def _again():
    """The walk is a local function, so that tasks receive it without installing the package."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The stretch at hand, and the second from which on it notifies again.
        stretch, due = None, 0
        for batch in batches:
            keys = list(zip(batch["rule_id"], batch["suite_category"], batch["stretch"]))
            seconds, rearm = batch["second"].to_numpy(), batch["rearm_seconds"].to_numpy()
            out, i = [], 0
            while i < len(keys):
                end = i + 1
                if keys[i] != stretch:
                    stretch, due = keys[i], seconds[i] + rearm[i]
                while end < len(keys) and keys[end] == stretch:
                    end += 1
                at = i + int(seconds[i:end].searchsorted(due))
                while at < end:
                    out.append(at)
                    due = seconds[at] + rearm[at]
                    at += max(1, int(seconds[at:end].searchsorted(due)))
                i = end
            yield batch.iloc[out][["rule_id", "suite_category", "run_id", "second"]]

    return walk


def notifications(
    evaluated: DataFrame,
    run_times: DataFrame,
    window_rows: int = WINDOW_ROWS,
    order: str = "lexical",
) -> DataFrame:
    """When a rule notifies: on a state change, and again every ``rearm_seconds`` while it lasts.

    With ``rearm_seconds = 0`` only the change counts. Every run has its state; runs are in the
    order of their times, in seconds, and of their ids within a second. ``run_times`` has one
    ``ts`` per ``run_id``; runs without one come last and can trigger, but never again.

    Stretches of fired runs are walked one by one, with one row for each second of a stretch:
    a suite that fails for years is bounded by the seconds of that time. All before the walk is
    cut into ranges where a suite has more than ``window_rows`` runs.
    """
    at = run_times.select("run_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    keys = ["rule_id", "suite_category"]
    per_run = evaluated.groupBy(*keys, "run_id").agg(
        F.bool_or("fired").alias("fired"), F.max("rearm_seconds").alias("rearm_seconds")
    )
    timed = per_run.join(at, "run_id", "left").withColumn("_key", run_key(order))
    timed = timed.withColumn("_late", F.col("second").isNull())
    place = ["_late", "second", "_key"]
    largest = timed.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    seen = previous(timed, keys, place, "fired", window_rows, largest)
    first = F.col("fired") & ~F.coalesce("previous_fired", F.lit(False))
    seen = seen.withColumn("_first", first.cast("int")).where("fired")
    first_rows = seen.where("_first = 1").select(*keys, "run_id", "second", F.lit("FIRST").alias("reason"))

    lasting = seen.where("rearm_seconds > 0 and not _late")
    lasting = running_sum(lasting, keys, place, "_first", "stretch", window_rows, largest)
    reduced = lasting.groupBy(*keys, "stretch", "second").agg(
        F.min_by("run_id", F.struct("_key")).alias("run_id"),
        F.max("rearm_seconds").alias("rearm_seconds"),
    )
    ordered = reduced.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "second")
    again = ordered.mapInPandas(
        _again(), "rule_id string, suite_category string, run_id string, second bigint"
    )
    fires = first_rows.unionByName(again.withColumn("reason", F.lit("AGAIN")))
    return fires.select(
        *keys,
        "run_id",
        F.timestamp_seconds("second").cast("timestamp_ntz").alias("fire_ts"),
        "reason",
    )
