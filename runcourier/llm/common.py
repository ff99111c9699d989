"""What several operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.session import cut, work_path

# Rows of text that Python sees at once.
BATCH_ROWS = 500
# At most this many ids are shipped to every executor (8 bytes each).
BROADCAST_IDS = 2_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts may be long, so hand them to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % modulus


def semi_ids(big: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids``. The ids are shipped only if counted as few."""
    ids = ids.select(key)
    if ids.count() <= bound:
        return big.join(F.broadcast(ids), key, "left_semi")
    return big.join(ids, key, "left_semi")


def anti_ids(big: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``big`` whose ``key`` is not in ``ids``; a null key never is."""
    ids = cut(ids.select(key).distinct())
    if ids.count() <= bound:
        return big.join(F.broadcast(ids), key, "left_anti").select(big.columns)
    return big.join(ids, key, "left_anti").select(big.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a compressed table in the shared folder."""
    folder = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fewer(df: DataFrame, rows: int, rows_per_part: int = 100_000) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more partitions than they need."""
    return df.coalesce(max(4, -(-rows // rows_per_part)))


def slim(df: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """The rows, written once, in no more partitions than they need: a step on a few rows of many
    partitions costs a file for each."""
    df = cut(df)
    return fewer(df, df.count(), rows_per_part)


def release(spark: SparkSession) -> None:
    """Shuffles, checkpoints and broadcasts that nothing refers to are dropped now.

    Spark drops them after the driver has collected its garbage. By itself that happens when its heap is
    full, so a loop of many small plans grows the driver to its limit, and keeps the files of all its steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Ids from here on stand for rows without an id.
NO_ID = 1 << 62


def row_key(id_col: str, text_col: str) -> Column:
    """The id, or for a null id a number from the text, above all ids."""
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 2)
    return F.coalesce(F.col(id_col).cast("long"), stand_in)


def without_nodes(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents whose key isn't a ``node`` of ``found``."""
    key = "_node"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return anti_ids(keyed, found.select(F.col("node").alias(key)), key).select(*docs.columns)


def key_id(key: Column) -> Column:
    return F.when(key < NO_ID, key)
