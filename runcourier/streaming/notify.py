"""Live alerts that notify again: state and timers per rule and suite.

A stream of judged runs is followed per rule and suite. A change to triggered notifies at once; while
the alert stays triggered it notifies again at a run ``rearm_seconds`` after the last notification, and
by a timer when that long no run came at all. One small value per key is held, and may expire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runcourier.operators.alerts import evaluate
from runcourier.operators.deliver import alert_outbox, fan_out
from runcourier.operators.runs import run_key, run_status
from runcourier.sources.tables import ReportTables
from runcourier.streaming.state import write_batch

_STATE = "fired boolean, due bigint, rearm bigint, run_id string, second bigint, number string"
_FIRES = "rule_id string, suite_category string, run_id string, second bigint, reason string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(second: int | None, number: str | None, run_id: str) -> tuple:
    """Order of runs: by time, by number where there is one, by text; runs without a time come last."""
    return second is None, second or 0, int(number) if number is not None else -1, run_id


class _Notifier(StatefulProcessor):
    def __init__(self, timers: bool, ttl_seconds: int | None):
        self.timers, self.ttl = timers, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.ttl * 1000 if self.ttl else None
        self.alert = handle.getValueState("alert", _STATE, ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Narrow rows: one for each run of this key in the batch.
        runs: dict[str, list] = {}
        for frame in rows:
            for run, fired, rearm, second, number in zip(
                frame["run_id"], frame["fired"], frame["rearm_seconds"], frame["second"], frame["number"]
            ):
                second = None if pd.isna(second) else int(second)
                number = None if pd.isna(number) else str(number)
                known = runs.setdefault(run, [False, 0, second, number])
                known[0] = known[0] or bool(fired)
                known[1] = max(known[1], int(rearm))
        fired, due, last, state = False, None, None, None
        if self.alert.exists():
            fired, due, _, run, second, number = self.alert.get()
            last = _place(second, number, run)
        found = []
        ordered = sorted((_place(second, number, run), run, f, r) for run, (f, r, second, number) in runs.items())
        for place, run, now, rearm in ordered:
            # An alert shows the newest run; what came before it changes nothing any more.
            if last is not None and place <= last:
                continue
            second = None if place[0] else place[1]
            reason = None
            if now and not fired:
                reason = "FIRST"
            elif now and rearm > 0 and due is not None and second is not None and second >= due:
                reason = "AGAIN"
            if reason:
                found.append((*key, run, second, reason))
                due = second + rearm if second is not None and rearm > 0 else None
            fired, last = now, place
            state = fired, due, rearm, run, second, runs[run][3]
        if state:
            self.alert.update(state)
            if self.timers and not fired:
                self._forget()
            elif self.timers and found:
                self._remind(timerValues, state[2])
        yield pd.DataFrame(found, columns=["rule_id", "suite_category", "run_id", "second", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.alert.exists():
            fired, _, rearm, run, second, number = self.alert.get()
            if fired and rearm > 0:
                now = timerValues.getCurrentProcessingTimeInMs() // 1000
                found.append((*key, run, now, "AGAIN"))
                self.alert.update((fired, now + rearm, rearm, run, second, number))
                self._remind(timerValues, rearm)
        yield pd.DataFrame(found, columns=["rule_id", "suite_category", "run_id", "second", "reason"])

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, (tuple, list)) else at)

    def _remind(self, timerValues, rearm: int) -> None:
        self._forget()
        if rearm > 0:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + rearm * 1000)

    def close(self) -> None:
        pass


def notification_stream(
    suites: DataFrame,
    rules: DataFrame,
    timers: bool = True,
    ttl_seconds: int | None = None,
    order: str = "lexical",
) -> DataFrame:
    """Notifications of a stream of suite rows with ``ts``, the time of their run.

    Result as that of ``alerts.notifications``. Runs are judged in the order of their times and, within a
    second, of their ids, also if they share a micro-batch; a run that is not newer than the last one of
    its suite is not judged (``jobs.alert_batches`` follows updates of older runs). A key forgets its
    alert ``ttl_seconds`` after its last run, and starts as OK again.
    """
    suites.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    judged = evaluate(suites, rules, keep=("ts",)).select(
        "rule_id",
        "suite_category",
        "run_id",
        "fired",
        F.col("rearm_seconds").cast("bigint").alias("rearm_seconds"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"),
        run_key(order)["n"].cast("string").alias("number"),
    )
    fires = judged.groupBy("rule_id", "suite_category").transformWithStateInPandas(
        _Notifier(timers, ttl_seconds), _FIRES, "Append", "ProcessingTime"
    )
    return fires.select(
        "rule_id",
        "suite_category",
        "run_id",
        F.timestamp_seconds("second").cast("timestamp_ntz").alias("fire_ts"),
        "reason",
    )


def notification_batches(
    tables: Callable[[], ReportTables], subscriptions: DataFrame, outbox: str
) -> Callable[[DataFrame, int], None]:
    """Mails about the notifications of each micro-batch, first ones and repeated ones."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        fires = batch.persist()
        try:
            status = run_status(tables().of_runs(fires.select("run_id").distinct()))
            write_batch(alert_outbox(fan_out(fires, subscriptions), status), outbox, batch_id)
        finally:
            fires.unpersist()

    return on_batch
