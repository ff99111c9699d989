"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in built-in functions only.

Every source gets a share of the words of all documents by its weight, but at most ``cap`` times its
own words; what is above is shared among the others by weight, until none is above. A source takes
all its documents as often as its target holds whole epochs; the rest of the target is filled with
documents in the order of an exponential key, -ln(u) / quality, with u from a hash of the id. The
words before a document in that order decide: it is taken if the rest reaches beyond its middle.

The order within a source isn't made in one task. A key falls into one of ``slices`` ranges of its
source; words are summed by range first (the ranges before a document), then by a window within the
range. So a source with most of the rows is spread like any other.

Null texts have size 0 and are taken 0 times; null sources are a source, the last one. Rows
without an id draw by their text and their number among equal rows. Repeated rows are documents of
their own. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#$%&*|"


def quality(text: Column) -> Column:
    """A weight between 0.1 and 1: less for texts with many symbols."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.lit(1.0) - F.lit(0.9) * symbols / n).otherwise(F.lit(1.0))


def uniform(name: Column, seed: str) -> Column:
    """A number above 0 and below 1 that depends on the name alone."""
    text = F.concat(F.lit(seed), name)
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Columns ``target``, ``epochs`` and ``rest`` for rows of (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), place))
    rows = rows.withColumn("_most", F.col("source_size") * F.lit(float(cap)))
    # Sources reach their cap in the order of cap over weight. The level is what a weight of 1 gets
    # once all sources before are at their cap; the highest of these is where none is above.
    filling = Window.orderBy(
        F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(
        F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last()
    ).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(filling), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_w").over(onward))
    level = F.max("_level").over(everything)
    rows = rows.withColumn("target", F.least(F.col("_most"), F.col("_w") * level))
    epochs = F.floor(F.col("target") / F.col("source_size"))
    rows = rows.withColumn(
        "epochs", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0)).cast("long")
    )
    return rows.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    slices: int = 4096,
    seed: str = "",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        quality(text).alias("_quality"),
        F.when(F.col(id_col).isNull(), F.md5(text.cast("binary"))).alias("_name"),
    )
    # Equal rows without an id are counted, and then numbered, so that each draws by itself.
    alike = rows.where("doc_id is null").groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))
    alike = alike.select(*rows.columns, number.alias("_k"))
    named = rows.where("doc_id is not null").withColumn("_name", F.col("doc_id").cast("string"))
    nameless = alike.withColumn("_name", F.concat("_name", F.lit("#"), "_k")).drop("_k")
    rows = named.unionByName(nameless)
    key = -F.log(uniform(F.col("_name"), seed)) / F.col("_quality")
    rows = rows.select("doc_id", "source", "size", key.alias("_key"))
    spread = F.floor((1 - F.exp(-F.col("_key"))) * slices).cast("int")
    rows = cut(rows.withColumn("_slice", spread))
    slice_sizes = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_in_slice"))
    by_source = slice_sizes.groupBy("source").agg(F.sum("_in_slice").alias("source_size"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = slice_sizes.select(
        F.col("source").alias("_source"),
        F.col("_slice").alias("_number"),
        F.coalesce(F.sum("_in_slice").over(before), F.lit(0)).alias("_before"),
    )
    own = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size")
    own = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(
        plan, rows.source.eqNullSafe(plan._source) & (rows._slice == plan._number), "inner"
    ).drop("_source")
    goals = targets(by_source, weights, cap)
    rows = rows.join(goals, rows.source.eqNullSafe(goals._source), "inner")
    middle = F.col("_before") + F.col("_within") + F.col("size") / F.lit(2.0)
    times = F.col("epochs") + F.when(middle < F.col("rest"), 1).otherwise(0)
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (times * F.col("size")).cast("long").alias("taken"),
    )
