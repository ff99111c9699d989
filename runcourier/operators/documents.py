"""One document per run, whatever its size.

A usual run is a record whose sections are sorted arrays, and its document is one row. A run whose
document is longer than a part is put together in two levels and comes in several rows, its parts, which
in their order are exactly the document that one row would hold:

1. its rows are ordered by ranges of (run, section, row). Equal rows are counted before that and travel
   with their number, in pieces, so that ranges can divide them;
2. each range is concatenated by itself into parts of a bounded size. The places of parts in the
   document are prefix sums, within a range over its parts and then over the sizes of ranges. No task
   sees more of a run than the few ranges that share its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.functions.html import PROFILES, Profile, blank_row, table_row
from runcourier.functions.paging import held
from runcourier.operators.render import document
from runcourier.operators.sections import assemble, heads, section_sizes, tagged_rows
from runcourier.schema import SECTIONS, one_of
from runcourier.session import cut, is_small, join_config
from runcourier.sources.tables import ReportTables

# Characters of a part, about.
PART_CHARS = 4_000_000
# Characters of a range.
RANGE_CHARS = 32_000_000

COLUMNS = ["run_id", "part_no", "n_parts", "offset", "n_chars", "n_bytes", "suite", "html"]


def documents(
    tables: ReportTables,
    profile: str = "compact",
    mode: str = "first",
    null_text: str = "",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Documents of all runs of ``suite_status``, as parts.

    ``part_no`` counts from 0 to ``n_parts`` - 1; ``offset`` is the number of bytes before a part. Size
    (``n_chars``, ``n_bytes``) and ``suite`` (the first of the run) are those of the whole document.
    """
    one_of(profile, tuple(PROFILES), "profile")
    one_of(mode, ("first", "all"), "mode")
    listed = ["failed", "threshold"] if mode == "first" else list(SECTIONS)
    sizes = section_sizes(tables, listed)
    large, n = held(sizes.where(F.col("weight") > part_chars).select("run_id", "weight"))
    if not n:
        return _whole(tables, profile, mode, null_text)
    ids = large.select("run_id")
    usual = tables.without_runs(ids)
    parts = _in_parts(tables.of_runs(ids), large, profile, mode, null_text, part_chars)
    return _whole(usual, profile, mode, null_text).unionByName(parts)


def _whole(tables: ReportTables, profile: str, mode: str, null_text: str) -> DataFrame:
    """Documents in one row each."""
    report = assemble(tables, mode)
    suite = F.col("suite") if mode == "first" else F.get("suite", F.lit(0))
    made = report.select(
        "run_id", suite.alias("suite"), document(report, profile, null_text).alias("html")
    )
    return made.select(
        "run_id",
        F.lit(0).alias("part_no"),
        F.lit(1).alias("n_parts"),
        F.lit(0).cast("bigint").alias("offset"),
        F.length("html").cast("bigint").alias("n_chars"),
        F.octet_length("html").cast("bigint").alias("n_bytes"),
        "suite",
        "html",
    )


def _fixed(mode: str, profile: Profile, null_text: str) -> Column:
    """The text before the rows of each section and behind the last, as an array of (section, html).

    In the first mode the one row of request and suite is part of it.
    """
    parts, close = [], profile.head
    for i, (name, spec) in enumerate(SECTIONS.items()):
        text = F.lit(close + (profile.between if i else "") + profile.section_open(spec))
        if mode == "first" and name in ("request", "suite"):
            row = table_row(F.col(name), spec, profile, null_text)
            blank = F.lit(blank_row(spec, profile))
            text = F.concat(text, F.when(F.col(name).isNull(), blank).otherwise(row))
        parts.append(F.struct(F.lit(i).alias("section"), text.alias("text")))
        close = profile.section_close()
    parts.append(F.struct(F.lit(len(SECTIONS)).alias("section"), F.lit(close + profile.foot).alias("text")))
    return F.array(*parts)


def _in_parts(
    tables: ReportTables, large: DataFrame, profile: str, mode: str, null_text: str, part_chars: int
) -> DataFrame:
    p = PROFILES[profile]
    listed = ["failed", "threshold"] if mode == "first" else list(SECTIONS)
    tops = cut(heads(tables).select("run_id", "request", "suite"))
    # Runs without a suite have no document.
    weight = large.join(tops.select("run_id"), "run_id", "left_semi").agg(F.sum("weight")).first()[0] or 0
    fixed = tops.select("run_id", F.explode(_fixed(mode, p, null_text)).alias("f")).select(
        "run_id", F.col("f.section").alias("section"), F.col("f.text").alias("text")
    )
    rows = join_config(tagged_rows(tables, listed), tops.select("run_id"), "run_id", salt_on=["row_hash"])
    counted = rows.groupBy("run_id", *listed, "row_weight").agg(F.count("*").alias("_n"))
    per_piece = F.greatest(F.lit(1), F.floor(F.lit(part_chars // 8) / F.col("row_weight"))).cast("bigint")
    last = F.floor((F.col("_n") - 1) / per_piece).cast("bigint")
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    number = F.coalesce(
        *[F.when(F.col(name).isNotNull(), list(SECTIONS).index(name)) for name in listed]
    )
    pieces = pieces.select(
        "run_id",
        number.alias("section"),
        *listed,
        "piece",
        F.least(per_piece, F.col("_n") - F.col("piece") * per_piece).cast("int").alias("copies"),
    )
    placed = pieces.unionByName(fixed, allowMissingColumns=True)
    # Fixed text comes before the rows of its section.
    order = ["section", *listed, "piece"]
    ranges = max(
        int(tables.suite_status.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-int(weight) // RANGE_CHARS),
    )
    # The number of a range is only meaningful for one execution, hence the cut.
    ranged = cut(
        placed.repartitionByRange(ranges, "run_id", *order).withColumn("_range", F.spark_partition_id())
    )
    html = F.col("text")
    for name in listed:
        row = F.repeat(table_row(F.col(name), SECTIONS[name], p, null_text), F.col("copies"))
        html = F.when(F.col(name).isNotNull(), row).otherwise(html)
    group = Window.partitionBy("_range", "run_id")
    own = group.orderBy(*order)
    # A number of partitions that is named is kept, while adaptive execution would gather ranges by their
    # size before they are written out, which says little of their texts.
    inside = ranged.repartition(ranges, "_range").withColumn("html", html)
    before = F.sum(F.length("html")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("_i", F.row_number().over(own)).withColumn(
        "_part", F.floor(F.coalesce(before, F.lit(0)) / part_chars)
    )
    entries = F.array_sort(F.collect_list(F.struct("_i", "html")))
    parts = inside.groupBy("_range", "run_id", "_part").agg(F.array_join(entries["html"], "").alias("html"))
    in_range = group.orderBy("_part")
    bytes_before = F.sum(F.octet_length("html")).over(in_range.rowsBetween(Window.unboundedPreceding, -1))
    parts = cut(
        parts.select(
            "run_id",
            "_range",
            "html",
            (F.row_number().over(in_range) - 1).alias("_no"),
            F.coalesce(bytes_before, F.lit(0)).alias("_at"),
        )
    )
    sizes = parts.groupBy("run_id", "_range").agg(
        F.count("*").alias("_n"),
        F.sum(F.length("html")).alias("_c"),
        F.sum(F.octet_length("html")).alias("_b"),
    )
    run = Window.partitionBy("run_id")
    earlier = run.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.select(
        "run_id",
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_parts_before"),
        F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.sum("_n").over(run).cast("int").alias("n_parts"),
        F.sum("_c").over(run).alias("n_chars"),
        F.sum("_b").over(run).alias("n_bytes"),
    )
    # The suite joins the numbers, since the parts of a run would meet in one task.
    numbered = cut(numbered.join(tops.select("run_id", "suite"), "run_id"))
    # A row for each range, so that parts stay where they are.
    near = F.broadcast(numbered) if is_small(numbered) else numbered
    joined = parts.join(near, ["run_id", "_range"])
    joined = joined.withColumn("part_no", (F.col("_parts_before") + F.col("_no")).cast("int"))
    return joined.withColumn("offset", F.col("_bytes_before") + F.col("_at")).select(*COLUMNS)
