"""The preceding row of a key, however many rows the key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.session import cut

# A key with more rows than this is not handed to one window task.
WINDOW_ROWS = 5_000_000


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    window_rows: int = WINDOW_ROWS,
    rows_per_key: int | None = None,
) -> DataFrame:
    """Add ``previous_<value>``: the value of the row before, by ``order`` within ``keys``.

    ``order`` is unique within a key. When every key is small this is a plain ``lag``.
    Otherwise the rows are cut into ranges of (keys, order), each range is processed by
    itself, and the last value of each range is handed on to the next one. A caller that
    knows a bound for the rows of a key passes ``rows_per_key`` and saves the counting.
    """
    name = f"previous_{value}"
    if rows_per_key is None:
        rows_per_key = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if rows_per_key <= window_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.lag(value).over(w))

    # The slice number is only meaningful for one execution, hence the cut.
    sliced = cut(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    # Wrapped, so that a null value differs from a missing row.
    wrapped: Column = F.struct(F.col(value).alias("v"))
    inside = sliced.withColumn(
        "_before", F.lag(wrapped).over(Window.partitionBy("_slice", *keys).orderBy(*order))
    )
    lasts = sliced.groupBy("_slice", *keys).agg(
        F.max_by(wrapped, F.struct(*order)).alias("_last")
    )
    carried = lasts.select(
        "_slice",
        *keys,
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
    )
    joined = inside.join(carried, ["_slice", *keys], "left")
    return joined.select(
        *[F.col(c) for c in df.columns], F.coalesce("_before", "_carried")["v"].alias(name)
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    name: str,
    window_rows: int = WINDOW_ROWS,
    rows_per_key: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row, by ``order`` within ``keys``.

    Cut into ranges beyond ``window_rows``, like ``previous``.
    """
    if rows_per_key is None:
        rows_per_key = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if rows_per_key <= window_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    sliced = cut(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    own = Window.partitionBy("_slice", *keys).orderBy(*order)
    inside = sliced.withColumn(
        "_own", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_slice", *keys).agg(F.sum(value).alias("_total"))
    carried = totals.select(
        "_slice", *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried")
    )
    joined = inside.join(carried, ["_slice", *keys])
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_own") + F.col("_carried")).alias(name))
