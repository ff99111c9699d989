"""Split groups that are too large for one row into pages.

A report is one row per run, which is fine until one run holds a large part of all rows.
Such a run is spread over pages of a bounded size. Every row lands on exactly one page, so
the pages of a run together are the whole report. Runs below the limit have page 0 only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.session import BROADCAST_ROWS, cut

# Characters a cell is charged for the marks around it.
CELL_CHARGE = 128

# Copies of one row are dealt out in pieces of this part of a page.
PIECES_PER_PAGE = 8

# Longest list of large groups the driver holds.
DRIVER_ROWS = 10_000


def weight(columns: list[str]) -> Column:
    """Size of a row in characters once it is rendered."""
    texts = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns]
    total = F.lit(CELL_CHARGE * len(columns))
    for t in texts:
        total = total + t
    return total.cast("bigint")


def content_hash(columns: list[str]) -> Column:
    """A number that depends on the values of a row only."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """A list that several branches use: a short one on the driver, a long one stored."""
    head = df.limit(DRIVER_ROWS + 1).collect()
    if len(head) <= DRIVER_ROWS:
        return df.sparkSession.createDataFrame(head, df.schema), len(head)
    stored = cut(df)
    return stored, stored.count()


def to_pages(
    rows: DataFrame,
    sizes: DataFrame,
    key: str,
    limit: int,
    pinned: Column,
    heads: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, bool]:
    """Add ``page_no``, ``n_pages`` and ``copies`` to ``rows``.

    ``rows`` carries ``row_weight`` and ``row_hash``, ``sizes`` the ``weight`` of each key.
    Rows of large groups are counted before anything is shuffled by page, so a row that
    occurs very often travels once per page with its number of copies.

    ``pinned`` rows are not dealt out; the caller reduces them without collecting them.
    ``heads`` turns a list of large groups into one row per group that is to be shown, with
    the columns that stand on every page. Groups it leaves out are left out here.

    Usually no group is large; then no join is added. The flag tells whether ``copies`` can
    differ from 1.
    """
    pages = F.ceil(F.col("weight") / F.lit(limit)).cast("int")
    large, n = held(sizes.where(F.col("weight") > limit).select(key, pages.alias("n_pages")))
    first = [F.lit(0).alias("page_no"), F.lit(1).alias("n_pages"), F.lit(1).alias("copies")]
    if n == 0:
        return rows.select("*", *first), False

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    tops, _ = held(heads(large.select(key)).join(large, key))
    columns = rows.columns
    usual = rows.join(near(large.select(key)), key, "left_anti").select("*", *first)
    inside = rows.where(~pinned).join(near(tops.select(key, "n_pages")), key)
    counted = inside.groupBy(*columns, "n_pages").agg(F.count("*").alias("_n"))
    # Pieces well below the page size keep the pages even.
    per_piece = F.greatest(
        F.lit(1), F.floor(F.lit(limit // PIECES_PER_PAGE) / F.col("row_weight"))
    ).cast("bigint")
    last = F.floor((F.col("_n") - 1) / per_piece).cast("bigint")
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spread = pieces.select(
        *columns,
        F.pmod(F.col("row_hash") + F.col("_piece"), F.col("n_pages").cast("bigint"))
        .cast("int")
        .alias("page_no"),
        "n_pages",
        F.least(per_piece, F.col("_n") - F.col("_piece") * per_piece).cast("int").alias("copies"),
    )
    # Every page exists, also one that no row was hashed to.
    filled = [
        F.col(c) if c in tops.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c)
        for c in columns
    ]
    frame = tops.withColumn("page_no", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)))
    frame = frame.select(*filled, "page_no", "n_pages", F.lit(0).alias("copies"))
    return usual.unionByName(spread).unionByName(frame), True


def repeat_copies(items: Column) -> Column:
    """Write out an array of ``(row, copies)`` as an array of rows."""
    return F.flatten(F.transform(items, lambda x: F.array_repeat(x["row"], x["copies"])))
