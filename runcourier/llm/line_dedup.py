"""Lines that many documents share, found by ranges of hashes, as compressed keep bitmaps.

Built-in functions only. A line's key is the line without space and 0x09 to 0x0D at both ends, A-Z
lower-cased; it travels as 128 bits of hash.

1. the range of its hash says which partition a line goes to. Hashes are even, so no ranges have to be
   sampled; only keys with a large part of all lines would fill a partition. A top-k sketch of all lines
   finds them, and their lines are dealt over several partitions by document;
2. partitions are sorted by hash, document and position. The first line of a key in a document tells a
   new document, and their number is that of the documents with this key; the counts of dealt keys are
   added up over their partitions (a row for each key and partition);
3. the positions of lines that go are sent to their documents, and become runs of kept lines.

Texts are not part of any of this; ``without_lines`` cuts them by the bitmaps.

A document is a row; rows with the same id and text are one document, and each gets its result. Null and
empty texts are one empty line. Rows without an id are told apart by their texts. Empty keys are found
nowhere, so blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runcourier.llm.common import row_key
from runcourier.session import cut

# What is stripped and what is lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Keys that the sketch reports at most, and counters it holds in a task.
MOST_HOT, COUNTERS = 10_000, 20_000

KEEP = "array<struct<first: int, count: int>>"


def line_key(line: Column) -> Column:
    key = F.btrim(line, F.lit(SPACES))
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, d, t, lines): the document of a row and its lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("d"),
        F.hash(text).alias("t"),
        F.split(text, "\n", -1).alias("lines"),
    )


def _hot(spark: SparkSession, lines: DataFrame, parts: int) -> list:
    """Rows (h, deals): hashes with more than half a partition of lines, and over how many to deal them."""
    most = min(2 * parts, MOST_HOT)
    top = F.expr(f"approx_top_k(h, {most}, {COUNTERS})").alias("top")
    row = lines.agg(top, F.count("*").alias("n")).first()
    if not row["n"]:
        return []
    found = [(r["item"], -(-2 * r["count"] * parts // row["n"])) for r in row["top"]]
    return [(h, min(parts, deals)) for h, deals in found if deals > 1]


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document that loses lines: ``d``, ``t``, ``n_lines``, ``n_dropped`` and ``keep``.

    All lines go whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or
    more. ``keep`` has the runs of lines that stay, as first line (from 0) and count. ``d`` and ``t`` tell
    the document, see ``without_lines``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, id_col, text_col)
    rows = rows.select("d", "t", F.size("lines").alias("n_lines"), "lines")
    lines = rows.select("d", "t", "n_lines", F.posexplode("lines").alias("pos", "line"))
    key = line_key(F.col("line"))
    keys = lines.select("d", "t", "n_lines", "pos", key.alias("key"))
    keys = keys.where(F.char_length("key") >= max(1, min_chars))
    hashed = keys.select(
        "d", "t", "n_lines", "pos",
        F.xxhash64("key").alias("h"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
    )
    hot = _hot(spark, hashed.select("h"), parts)
    # Equal parts of the hashes, the smallest first.
    width = 2**62 // parts + 1
    place = F.expr(f"(shiftright(h, 2) + {2**61}) div {width}")
    dealt: Column = F.lit(False)
    if hot:
        # At most MOST_HOT rows.
        deals = spark.createDataFrame(hot, "h long, deals int")
        hashed = hashed.join(F.broadcast(deals), "h", "left")
        dealt = F.col("deals").isNotNull()
        deal = F.coalesce(F.pmod(F.xxhash64("d", "t"), F.col("deals").cast("bigint")), F.lit(0))
        place = F.pmod(place + deal, F.lit(parts))
    columns = ["d", "t", "n_lines", "pos", "h", "h2"]
    placed = hashed.select(*columns, dealt.alias("dealt"), place.cast("int").alias("range"))
    ranged = placed.repartitionById(parts, F.col("range"))
    same = Window.partitionBy("range", "h", "h2")
    document = F.struct("d", "t")
    first = ~F.lag(document).over(same.orderBy("d", "t", "pos")).eqNullSafe(document)
    counted = ranged.withColumn("first", first).withColumn("n_docs", F.count_if("first").over(same))
    found = counted.where(F.col("dealt") | (F.col("n_docs") >= min_docs))
    if hot:
        found = cut(found)
        totals = found.where("dealt and first").groupBy("h", "h2").agg(F.count("*").alias("total"))
        enough = totals.where(F.col("total") >= min_docs).select("h", "h2", F.lit(True).alias("enough"))
        found = found.join(F.broadcast(enough), ["h", "h2"], "left").where("not dealt or enough")
    # Neighbouring lines that go are one run.
    of_doc = Window.partitionBy("d", "t").orderBy("pos")
    gone = found.select("d", "t", "n_lines", "pos").withColumn("before", F.lag("pos").over(of_doc))
    # Repeated rows send a position several times.
    gone = gone.where("before is null or before <> pos")
    gone = gone.withColumn("run", F.col("pos") - F.row_number().over(of_doc))
    runs = gone.groupBy("d", "t", "n_lines", "run").agg(
        F.min("pos").alias("first"), F.count("*").cast("int").alias("count")
    )
    by_doc = runs.groupBy("d", "t", "n_lines").agg(
        F.sort_array(F.collect_list(F.struct("first", "count"))).alias("gone"),
        F.sum("count").alias("n_dropped"),
    )

    def behind(i: Column) -> Column:
        run = F.get("gone", i)
        return F.coalesce(run["first"] + run["count"], F.lit(0))

    def stays(run: Column, i: Column) -> Column:
        start = behind(i - 1)
        return F.struct(start.alias("first"), (run["first"] - start).alias("count"))

    end = behind(F.size("gone") - 1)
    last = F.struct(end.alias("first"), (F.col("n_lines") - end).alias("count"))
    kept = F.filter(F.concat(F.transform("gone", stays), F.array(last)), lambda run: run["count"] > 0)
    return by_doc.select("d", "t", "n_lines", "n_dropped", kept.cast(KEEP).alias("keep"))


def without_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped`` and ``kept``, the text that is left.

    Documents without a bitmap keep all lines.
    """
    # The lines are split before the join, so that the runs below cut an array that is there.
    rows = _keyed(docs, id_col, text_col)
    maps = bitmaps.select("d", "t", "n_dropped", "keep")
    joined = rows.join(maps, ["d", "t"], "left")
    runs = F.transform("keep", lambda run: F.slice("lines", run["first"] + 1, run["count"]))
    left = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.flatten(runs))
    return joined.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.array_join(left, "\n").alias("kept"),
    )
