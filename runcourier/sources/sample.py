"""A small embedded run for previews; all values are invented."""

from __future__ import annotations

from pyspark.sql import SparkSession

from runcourier.sources.tables import ReportTables, inline_tables

RUN_ID = "4100200"
SUITE = "NIGHTLY_REGRESSION"


def sample_tables(spark: SparkSession) -> ReportTables:
    """One run with one request, one suite, three failed checks and two breaches."""
    return inline_tables(
        spark,
        run_request=[
            (RUN_ID, "S-77", "2030-02-03", "PARENT-1", "REQ-1", "UW-12", "2030-03-01", "LOB", "NA")
        ],
        suite_status=[
            (RUN_ID, SUITE, "FAILED", "FAIL", 20, 17, 3, "00:10:05", "owner@example.com")
        ],
        failed_check=[
            (RUN_ID, SUITE, "TQ001", "INPUT", "Row count <= 10 & not null", "FAIL"),
            (RUN_ID, SUITE, "TQ002", "OUTPUT", "Key 'id' is unique", "FAIL"),
            (RUN_ID, SUITE, "TQ003", "OUTPUT", 'Column "a" exists', "Query Statement Failed"),
        ],
        threshold_breach=[(RUN_ID, "Outlier present in A"), (RUN_ID, "Outlier present in B")],
    )
