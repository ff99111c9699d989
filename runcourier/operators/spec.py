"""The report definition: datasets, columns and vertical layout, as tables and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runcourier.schema import SECTIONS
from runcourier.sources.tables import ReportTables

WIDTH = 12

# Widget names and heights from top to bottom.
WIDGETS = (
    ("text", "title", None, 1),
    ("text", "subtitle", None, 1),
    ("text", "h_req", "request", 1),
    ("table", "t_req", "request", 3),
    ("text", "h_suite", "suite", 1),
    ("table", "t_suite", "suite", 3),
    ("text", "h_failed", "failed", 1),
    ("table", "t_failed", "failed", 4),
    ("text", "h_thr", "threshold", 1),
    ("table", "t_thr", "threshold", 3),
)


def section_spec(spark: SparkSession) -> DataFrame:
    """The columns of all sections, in display order."""
    rows = [
        (s.name, i, f.name, f.title, f.is_link)
        for s in SECTIONS.values()
        for i, f in enumerate(s.fields)
    ]
    return spark.createDataFrame(
        rows, "section string, ordinal int, field string, label string, is_link boolean"
    )


def layout_spec(
    spark: SparkSession,
    title: str = "Regression Report",
    subtitle: str = "Latest run, read from the report tables.",
) -> DataFrame:
    """Widgets with their position; each one starts below the heights above it."""
    rows = []
    for i, (kind, name, section, height) in enumerate(WIDGETS):
        if section is None:
            text = f"## {title}" if name == "title" else subtitle
        elif kind == "text":
            text = f"### {SECTIONS[section].title}"
        else:
            text = None
        dataset = f"{section}_ds" if kind == "table" else None
        rows.append((i, kind, name, dataset, text, height))
    widgets = spark.createDataFrame(
        rows,
        "ordinal int, kind string, name string, dataset string, text string, height int",
    )
    # A spec has a handful of rows, so the window over all of them is no concern.
    above = F.sum("height").over(
        Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    )
    return widgets.select(
        "*",
        F.lit(0).alias("x"),
        F.coalesce(above, F.lit(0)).cast("int").alias("y"),
        F.lit(WIDTH).alias("width"),
    )


def datasets(tables: str = "") -> list[tuple[str, str, str]]:
    """Name, title and query of each dataset; all show the latest run."""
    latest = f"(SELECT max(run_id) FROM {tables}suite_status)"
    return [
        (
            f"{s.name}_ds",
            s.title,
            f"SELECT {', '.join(s.columns)} FROM {tables}{s.table} WHERE run_id = {latest}",
        )
        for s in SECTIONS.values()
    ]


def dataset_rows(tables: ReportTables) -> DataFrame:
    """Row count of each dataset for the latest run, zero included."""
    latest = tables.suite_status.agg(F.max("run_id")).scalar()
    parts = [
        tables.table(s.table)
        .where(F.col("run_id") == latest)
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(f"{s.name}_ds").alias("dataset"), "n_rows")
        for s in SECTIONS.values()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def live_layout(tables: ReportTables) -> DataFrame:
    """The layout with the number of rows each table widget shows for the latest run."""
    spark = tables.suite_status.sparkSession
    return layout_spec(spark).join(dataset_rows(tables), "dataset", "left")


def report_definition(tables: ReportTables, title: str = "Regression Report") -> DataFrame:
    """The whole definition as one JSON document."""
    spark = tables.suite_status.sparkSession
    fields = (
        section_spec(spark)
        .groupBy("section")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "field", "label"))).alias("columns"))
        .select(
            F.concat("section", F.lit("_ds")).alias("dataset"),
            F.transform(
                "columns",
                lambda c: F.struct(c["field"].alias("fieldName"), c["label"].alias("displayName")),
            ).alias("columns"),
        )
    )
    widget = F.struct(
        "ordinal",
        F.struct("name", "kind", "text", "dataset", "columns", "n_rows").alias("widget"),
        F.struct("x", "y", "width", "height").alias("position"),
    )
    page = (
        live_layout(tables)
        .join(fields, "dataset", "left")
        .agg(F.sort_array(F.collect_list(widget)).alias("layout"))
    )
    sets = spark.createDataFrame(
        [(i, *d) for i, d in enumerate(datasets())], "i int, name string, title string, q string"
    ).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("i", "name", "title", "q"))),
            lambda d: F.struct(
                d["name"].alias("name"),
                d["title"].alias("displayName"),
                F.array(d["q"]).alias("queryLines"),
            ),
        ).alias("datasets")
    )
    layout = F.transform(
        "layout",
        lambda w: F.struct(w["widget"].alias("widget"), w["position"].alias("position")),
    )
    pages = page.select(
        F.array(
            F.struct(
                F.lit("report").alias("name"), F.lit(title).alias("displayName"),
                layout.alias("layout"),
            )
        ).alias("pages")
    )
    document = F.to_json(
        F.struct(F.col("datasets"), F.col("pages")), {"ignoreNullFields": "false"}
    )
    # Both sides are single rows.
    return sets.select("datasets", pages.scalar().alias("pages")).select(document.alias("json"))
