"""Sections of a run, and the report record assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.functions.paging import content_hash, repeat_copies, to_pages, weight
from runcourier.operators.runs import resolve
from runcourier.schema import SECTIONS, one_of
from runcourier.sources.tables import ReportTables


def section(
    tables: ReportTables,
    name: str,
    run_id: str | None = None,
    labels: bool = False,
    order: str = "lexical",
) -> DataFrame:
    """All rows of a section for one run (blank: the latest), optionally with display labels.

    The latest run is always taken from ``suite_status``, so a section without rows for
    it is empty.
    """
    spec = SECTIONS[name]
    run = resolve(run_id, tables.suite_status, order)
    rows = tables.table(spec.table).where(F.col("run_id") == run)
    columns = [F.col(f.name).alias(f.title) if labels else F.col(f.name) for f in spec.fields]
    return rows.select(*columns)


def first_rows(tables: ReportTables, name: str) -> DataFrame:
    """One row per run: the smallest by all section columns."""
    rows = tables.section(name)
    columns = [c for c in rows.columns if c != "run_id"]
    smallest = F.min(F.struct(*columns)).alias("row")
    return rows.groupBy("run_id").agg(smallest).select("run_id", "row.*")


def first_rows_by_window(tables: ReportTables, name: str) -> DataFrame:
    """The same as ``first_rows``, as a window. Spark limits each group before the shuffle."""
    rows = tables.section(name)
    order = Window.partitionBy("run_id").orderBy(*[c for c in rows.columns if c != "run_id"])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tagged_rows(tables: ReportTables, names: list[str]) -> DataFrame:
    """Rows of several sections in one table, each record in the column of its section.

    A row without a run id belongs to no run.
    """
    parts = []
    for name in names:
        spec = SECTIONS[name]
        columns = spec.columns
        parts.append(
            tables.section(name)
            .where("run_id is not null")
            .select(
                "run_id",
                F.struct(*columns).alias(name),
                weight(columns).alias("row_weight"),
                content_hash(columns).alias("row_hash"),
            )
        )
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def section_sizes(tables: ReportTables, names: list[str]) -> DataFrame:
    """Characters of the rows of some sections once they are rendered, for each run."""
    rows = tagged_rows(tables, names)
    return rows.groupBy("run_id").agg(F.sum("row_weight").alias("weight"))


def assemble(
    tables: ReportTables, mode: str = "first", page_chars: int | None = None
) -> DataFrame:
    """One report record per run: request, suite, failed checks and breaches.

    Runs are those of ``suite_status``; the other sections may be missing. ``mode='first'``
    gives one request and one suite per run, ``mode='all'`` gives all of them as arrays.
    Arrays are in the order of their columns.

    The sections are united and grouped once, so nothing is joined and a run with many
    rows in several sections does not multiply them.

    A record holds its whole run. Reports of any size come from ``operators.documents``, which uses
    this for runs that fit one row. With ``page_chars``, runs larger than that are dealt out to pages,
    each a record of its own; see ``functions.paging``.
    """
    one_of(mode, ("first", "all"), "mode")
    rows = tagged_rows(tables, list(SECTIONS))
    pinned: Column = F.lit(False)
    listed_sections = list(SECTIONS)
    if mode == "first":
        pinned = F.col("request").isNotNull() | F.col("suite").isNotNull()
        listed_sections = ["failed", "threshold"]

    def tops(runs: DataFrame) -> DataFrame:
        own = tables.of_runs(runs)
        if mode == "all":
            return own.suite_status.select("run_id").distinct()
        return heads(own).select("run_id", "request", "suite")

    if page_chars is None:
        paged, copied = rows.withColumns({"page_no": F.lit(0), "n_pages": F.lit(1)}), False
    else:
        # Only sections whose rows are listed can make a run large.
        sizes = section_sizes(tables, listed_sections)
        paged, copied = to_pages(rows, sizes, "run_id", page_chars, pinned, tops)

    def listed(name: str) -> Column:
        if not copied:
            return F.sort_array(F.collect_list(name))
        entry = F.when(
            F.col(name).isNotNull(), F.struct(F.col(name).alias("row"), F.col("copies"))
        )
        # The sort is outermost, since inside a higher-order function it is not compiled.
        return F.sort_array(repeat_copies(F.collect_list(entry)))

    head = (lambda n: F.min(n)) if mode == "first" else listed
    grouped = paged.groupBy("run_id", "page_no", "n_pages").agg(
        head("request").alias("request"),
        head("suite").alias("suite"),
        listed("failed").alias("failed"),
        listed("threshold").alias("thresholds"),
        F.count("suite").alias("_suites"),
    )
    # Large runs are known to have a suite, also when it is not on this page.
    return grouped.where((F.col("n_pages") > 1) | (F.col("_suites") > 0)).drop("_suites")


def heads(tables: ReportTables) -> DataFrame:
    """Report records without the listed sections: request and suite of every run.

    Enough for subjects and cards, and the failed checks are not read for it.
    """
    return (
        tagged_rows(tables, ["request", "suite"])
        .groupBy("run_id")
        .agg(
            F.min("request").alias("request"),
            F.min("suite").alias("suite"),
            F.count("suite").alias("_suites"),
        )
        .where("_suites > 0")
        .select(
            "run_id", F.lit(0).alias("page_no"), F.lit(1).alias("n_pages"), "request", "suite"
        )
    )


def incomplete_runs(tables: ReportTables) -> DataFrame:
    """Runs that lack one of the sections, with a flag for each section."""
    marks = []
    for name, spec in SECTIONS.items():
        marks.append(tables.table(spec.table).select("run_id", F.lit(name).alias("section")))
    rows = marks[0]
    for other in marks[1:]:
        rows = rows.unionByName(other)
    flags = [
        F.coalesce(F.bool_or(F.col("section") == n), F.lit(False)).alias(f"has_{n}")
        for n in SECTIONS
    ]
    every = F.lit(True)
    for n in SECTIONS:
        every = every & F.col(f"has_{n}")
    return rows.groupBy("run_id").agg(*flags).where(~every)


def runs_without(tables: ReportTables, name: str) -> DataFrame:
    """Runs of ``suite_status`` that have no row in a section."""
    runs = tables.suite_status.select("run_id").distinct()
    present = tables.table(SECTIONS[name].table).select("run_id").distinct()
    return runs.join(present, "run_id", "left_anti")


def runs_with(tables: ReportTables, name: str) -> DataFrame:
    runs = tables.suite_status.select("run_id").distinct()
    present = tables.table(SECTIONS[name].table).select("run_id").distinct()
    return runs.join(present, "run_id", "left_semi")


def counter_mismatch(suite_status: DataFrame) -> DataFrame:
    """Suites whose counters do not add up; a missing counter counts as a mismatch."""
    total = F.col("success_count") + F.col("failure_count")
    return suite_status.where(~F.coalesce(F.col("total_count") == total, F.lit(False)))
