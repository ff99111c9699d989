"""Benchmark: wall seconds of the headline queries, as one line of JSON.

Report queries work on one run per minute (38,859 runs at sf0.1). Each query runs once to
warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contract.queries import QUERIES, rules  # noqa: E402
from runcourier.operators.alerts import evaluate, run_verdicts  # noqa: E402
from runcourier.operators.sections import section  # noqa: E402
from runcourier.plans.jobs import reports  # noqa: E402
from runcourier.session import local_session, work_path  # noqa: E402
from runcourier.sources.event_runs import PER_MINUTE, event_tables  # noqa: E402
from runcourier.sources.tables import load_tables, save_tables  # noqa: E402

PER_RUN = (
    "latest_run_summary",
    "assemble_counts",
    "assemble_pages",
    "first_row_per_run",
    "incomplete_runs",
    "render_full",
    "render_compact",
    "render_plain",
    "render_all_rows",
    "strip_borders",
    "alert_eval",
    "alert_run_verdict",
    "alert_transitions",
    "alert_notifications",
    "alert_outbox",
    "card_text",
    "card_payload",
    "email_payload_graph",
    "dry_run_preview",
    "snapshot_asof",
    "upsert_definitions",
    "stored_tables",
    "stream_outbox",
)
OTHERS = ("parse_recipients", "text_utils", "json_utils", "debounce_updates", "debounce_runs")


def on_stored_tables(spark, sf_dir: str) -> dict:
    """The same work on stored report tables, without deriving them from events."""
    folder = work_path(spark, "bench")
    save_tables(event_tables(spark, sf_dir, PER_MINUTE), folder)
    tables = load_tables(spark, folder)
    return {
        "tables_render_full": lambda: reports(tables, "full"),
        "tables_render_compact": lambda: reports(tables, "compact"),
        "tables_run_verdict": lambda: run_verdicts(evaluate(tables.suite_status, rules(spark))),
        "tables_latest_failed": lambda: section(tables, "failed"),
    }


def timed(fn) -> float:
    start = time.perf_counter()
    fn().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, "bench")
    runs = {n: (lambda q=QUERIES[n]: q(spark, sf_dir, PER_MINUTE)) for n in PER_RUN}
    runs |= {n: (lambda q=QUERIES[n]: q(spark, sf_dir)) for n in OTHERS}
    runs |= on_stored_tables(spark, sf_dir)
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or runs:
        run = runs[name]
        timed(run)
        seconds[name] = round(statistics.median(timed(run) for _ in range(repeats)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
