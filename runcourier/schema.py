"""Table schemas, section columns and the enumerated option values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RUN_REQUEST = T.StructType(
    _strings(
        "run_id", "super_client_name", "request_run_date", "parent_request_id", "request_id",
        "task_id", "forecast_start_date", "lob", "app_id",
    )
)
SUITE_STATUS = T.StructType(
    _strings("run_id", "suite_category", "execution_status", "status")
    + [T.StructField(n, T.IntegerType()) for n in ("total_count", "success_count", "failure_count")]
    + _strings("elapsed_time", "run_user")
)
FAILED_CHECK = T.StructType(
    _strings(
        "run_id", "suite_category", "test_code", "tags", "test_description", "execution_status"
    )
)
THRESHOLD_BREACH = T.StructType(_strings("run_id", "threshold_query_description"))

TABLE_SCHEMAS = {
    "run_request": RUN_REQUEST,
    "suite_status": SUITE_STATUS,
    "failed_check": FAILED_CHECK,
    "threshold_breach": THRESHOLD_BREACH,
}

ALERT_RULE = T.StructType(
    _strings("rule_id", "metric", "op")
    + [T.StructField("threshold", T.DoubleType()), T.StructField("rearm_seconds", T.IntegerType())]
)
SUBSCRIPTION = T.StructType(
    _strings("rule_id", "kind", "address") + [T.StructField("paused", T.BooleanType())]
)


@dataclass(frozen=True)
class Field:
    """One report column. ``label`` holds one entry per display line."""

    name: str
    label: tuple[str, ...]
    is_link: bool = False

    @property
    def title(self) -> str:
        return " ".join(self.label)


@dataclass(frozen=True)
class Section:
    name: str
    table: str
    title: str
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


# Section titles, column order and column labels of the report.
SECTIONS: dict[str, Section] = {
    "request": Section(
        "request",
        "run_request",
        "Request Summary",
        (
            Field("super_client_name", ("Super Client", "Name")),
            Field("request_run_date", ("Request Run", "Date")),
            Field("parent_request_id", ("Parent Request Id",)),
            Field("request_id", ("Request Id",)),
            Field("task_id", ("Task", "Id")),
            Field("forecast_start_date", ("Forecast Start", "Date")),
            Field("lob", ("LOB",)),
            Field("app_id", ("App", "ID")),
        ),
    ),
    "suite": Section(
        "suite",
        "suite_status",
        "Execution Suite Status Summary",
        (
            Field("run_id", ("Run ID",)),
            Field("suite_category", ("Suite Category",)),
            Field("execution_status", ("Execution Status",)),
            Field("status", ("Status",)),
            Field("total_count", ("Total Count",)),
            Field("success_count", ("Success Count",)),
            Field("failure_count", ("Failure Count",)),
            Field("elapsed_time", ("Elapsed Time",)),
            Field("run_user", ("Run User",), is_link=True),
        ),
    ),
    "failed": Section(
        "failed",
        "failed_check",
        "Execution Failed Query Summary Status",
        (
            Field("run_id", ("Run ID",)),
            Field("suite_category", ("Suite Category",)),
            Field("test_code", ("Test", "Code")),
            Field("tags", ("Tags",)),
            Field("test_description", ("Test Description",)),
            Field("execution_status", ("Execution Status",)),
        ),
    ),
    "threshold": Section(
        "threshold",
        "threshold_breach",
        "Threshold Summary Status",
        (Field("threshold_query_description", ("Threshold Query Description",)),),
    ),
}

# The allowed option values.
CHAT_FORMATS = ("slack", "teams", "generic")
EMAIL_PROVIDERS = ("resend", "graph", "ses")
RUN_ORDERS = ("lexical", "numeric")
ALERT_OPS = ("GREATER_THAN",)
COUNTERS = ("total_count", "success_count", "failure_count")


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value
