"""The four report tables: load, create or replace, append, upsert, and slices of them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from runcourier.functions.files import MD5_START, md5_piece
from runcourier.functions.paging import held
from runcourier.schema import SECTIONS, TABLE_SCHEMAS
from runcourier.session import cut, is_small

# Buckets of a table that is upserted.
BUCKETS = 64
# Buckets of report tables by run, and the name of their partition column.
RUN_BUCKETS, RUN_BUCKET = 256, "run_bucket"
# Bytes of a file that is read as one row, and of the pieces of longer ones (a multiple of 64).
ROW_BYTES, PIECE_BYTES = 32 << 20, 256 << 20


def run_bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(RUN_BUCKETS)).cast("int")


@dataclass(frozen=True)
class ReportTables:
    """The tables that reports are made of, linked by ``run_id``."""

    run_request: DataFrame
    suite_status: DataFrame
    failed_check: DataFrame
    threshold_breach: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def section(self, name: str) -> DataFrame:
        """The columns of one section with the run id in front; duplicates are kept."""
        section = SECTIONS[name]
        columns = [c for c in section.columns if c != "run_id"]
        return self.table(section.table).select("run_id", *columns)

    def changed(self, fn: Callable[[DataFrame], DataFrame]) -> ReportTables:
        """All four tables, each changed in the same way."""
        return replace(self, **{n: fn(self.table(n)) for n in TABLE_SCHEMAS})

    def of_run(self, run_id: str | Column) -> ReportTables:
        """All four tables cut to one run; the filter reaches the scans, and prunes run buckets."""
        value = F.lit(run_id) if isinstance(run_id, str) else run_id

        def cut_to(df: DataFrame) -> DataFrame:
            if RUN_BUCKET in df.columns:
                df = df.where(F.col(RUN_BUCKET) == run_bucket(value)).drop(RUN_BUCKET)
            return df.where(F.col("run_id") == value)

        return self.changed(cut_to)

    def of_runs(self, run_ids: DataFrame) -> ReportTables:
        """All four tables cut to a list of runs (one column ``run_id``, unique).

        Tables in run buckets are read in the buckets of the list only, as a filter on partitions.
        """
        small = is_small(run_ids)
        keys = F.broadcast(run_ids) if small else run_ids
        touched: list[int] = []
        if RUN_BUCKET in self.suite_status.columns:
            # RUN_BUCKETS numbers at most.
            rows = run_ids.select(run_bucket(F.col("run_id")).alias("b")).distinct().collect()
            touched = [r["b"] for r in rows if r["b"] is not None]

        def cut_to(df: DataFrame) -> DataFrame:
            if RUN_BUCKET in df.columns:
                df = df.where(F.col(RUN_BUCKET).isin(touched)).drop(RUN_BUCKET)
            return df.join(keys, "run_id", "left_semi")

        return self.changed(cut_to)

    def without_runs(self, run_ids: DataFrame) -> ReportTables:
        """All four tables without the rows of a list of runs (one column ``run_id``, unique)."""
        keys = F.broadcast(run_ids) if is_small(run_ids) else run_ids
        return self.changed(lambda df: df.join(keys, "run_id", "left_anti"))


def base_dir(default: str | None = None) -> str:
    """The folder of the tables, which the environment may override."""
    path = os.environ.get("RUNCOURIER_TABLES", default)
    if not path:
        raise ValueError("name a table folder, or set RUNCOURIER_TABLES")
    return path


def load_tables(spark: SparkSession, folder: str | None = None) -> ReportTables:
    """Read the four tables from parquet below ``folder``."""
    root = folder or base_dir()
    return ReportTables(
        **{n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in TABLE_SCHEMAS.items()}
    )


def load_catalog_tables(spark: SparkSession, database: str) -> ReportTables:
    """Use four tables of the catalog."""
    return ReportTables(**{n: spark.table(f"{database}.{n}") for n in TABLE_SCHEMAS})


def inline_rows(spark: SparkSession, schema: StructType, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def inline_tables(spark: SparkSession, **rows: Sequence[tuple]) -> ReportTables:
    """Report tables from literal rows; a table that is left out is empty."""
    return ReportTables(
        **{n: inline_rows(spark, s, rows.get(n, ())) for n, s in TABLE_SCHEMAS.items()}
    )


def by_run(df: DataFrame) -> DataFrame:
    """Rows of a run next to each other, so that a run slice skips most row groups.

    A rebalance, not a repartition: adaptive execution splits a run that is too large for
    one task and merges small ones.
    """
    return df.hint("rebalance", "run_id").sortWithinPartitions("run_id")


def create_or_replace(df: DataFrame, path: str) -> None:
    """Write a table anew. Running it again gives the same table."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_tables(tables: ReportTables, folder: str, clustered: bool = True) -> None:
    for name in TABLE_SCHEMAS:
        df = tables.table(name)
        create_or_replace(by_run(df) if clustered else df, f"{folder}/{name}")


def save_run_tables(tables: ReportTables, folder: str, mode: str = "overwrite") -> None:
    """Store the tables in buckets by run, so that a list of runs reads its buckets only.

    A hot run is split over files by the rebalance; ``mode="append"`` adds rows.
    """
    for name in TABLE_SCHEMAS:
        rows = tables.table(name).withColumn(RUN_BUCKET, run_bucket(F.col("run_id")))
        rows = rows.hint("rebalance", RUN_BUCKET).sortWithinPartitions(RUN_BUCKET, "run_id")
        rows.write.mode(mode).partitionBy(RUN_BUCKET).parquet(f"{folder}/{name}")


def load_run_tables(spark: SparkSession, folder: str) -> ReportTables:
    """Read tables that ``save_run_tables`` wrote; slices by run are pruned by bucket."""
    return ReportTables(
        **{
            n: spark.read.schema(StructType([*s.fields, StructField(RUN_BUCKET, IntegerType())])).parquet(
                f"{folder}/{n}"
            )
            for n, s in TABLE_SCHEMAS.items()
        }
    )


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update rows in place by key, add those that are new. ``updates`` is unique by key."""
    keys = list(keys)
    fields = [c for c in existing.columns if c not in keys]
    new = updates.select(*keys, F.struct(*[F.col(c) for c in fields]).alias("_new"))
    old = existing.select(*keys, F.struct(*[F.col(c) for c in fields]).alias("_old"))
    merged = old.join(new, keys, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    return merged.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in fields])


def upsert_into(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str]) -> None:
    """Upsert into a stored table. The merged rows are materialised before the overwrite."""
    merged = cut(upsert(spark.read.parquet(path), updates, keys))
    create_or_replace(merged, path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def save_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a table in buckets of its keys, for ``upsert_buckets``."""
    rows = df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket")
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table, with whatever a stopped upsert left staged."""
    finish_upsert(spark, path)
    return spark.read.parquet(path).drop("_bucket")


def upsert_buckets(
    spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], buckets: int = BUCKETS
) -> None:
    """Upsert into a table in buckets; only the buckets of the updates are read and written.

    The merged buckets are staged beside the table and put in its place once they are complete. If that
    is stopped in between, the next upsert or reader does it again, from the staged copy.
    """
    finish_upsert(spark, path)
    new = cut(updates.withColumn("_bucket", _bucket(keys, buckets)))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # ``buckets`` numbers at most
    if touched:
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
        merged = upsert(old, new.select(old.columns), [*keys, "_bucket"]).select(old.columns)
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.staged")
        finish_upsert(spark, path)


def finish_upsert(spark: SparkSession, path: str) -> None:
    """Put staged buckets in the place of the old ones, if there are any and they are complete."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    store = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.staged/_SUCCESS")):
        rows = spark.read.schema(spark.read.parquet(path).schema).parquet(f"{path}.staged")
        writer = rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket")
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
        store.delete(staged, True)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with its path as the file system names it and its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.url_decode(F.input_file_name()).alias("path"), F.col("value").alias("text")
    )


def whole_md5(
    spark: SparkSession, path: str, row_bytes: int = ROW_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """One row per file, with its path as the file system names it and the MD5 of its whole text.

    The text of a file up to ``row_bytes`` is one row. Longer files, which no row may hold, are read in
    pieces: a task reads one piece, from the state of the MD5 behind the piece before. The next pieces of
    all files are read at the same time.
    """
    texts = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= row_bytes)
    rows = texts.select(F.url_decode(F.input_file_name()).alias("path"), F.md5("value").alias("md5"))
    named = F.url_decode(F.input_file_name()).alias("path")
    files = spark.read.format("binaryFile").load(path).select(named, F.col("path").alias("file"), "length")
    long, n = held(files.where(F.col("length") > row_bytes))
    if not n:
        return rows

    def read(start: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(
                    state=[
                        md5_piece(file, state, start, min(start + piece_bytes, size), size)
                        for file, size, state in batch[["file", "length", "state"]].itertuples(index=False)
                    ]
                )

        return step

    last = F.floor((F.col("length") - 1) / piece_bytes)
    ending = {r["last"]: r["count"] for r in long.groupBy(last.alias("last")).count().collect()}
    states = long.withColumn("state", F.lit(MD5_START))
    for i in range(max(ending) + 1):
        going = sum(count for at, count in ending.items() if at >= i)
        next_ = states.where(last >= i).repartition(going, "path")
        next_ = next_.mapInPandas(read(i * piece_bytes), states.schema)
        states = cut(next_.unionByName(states.where(last < i)))
    return rows.unionByName(states.select("path", F.lower(F.hex("state")).alias("md5")))


def register_views(tables: ReportTables, prefix: str = "") -> list[str]:
    """Publish the tables and the latest run's summary as named datasets for SQL."""
    names = []
    for name in TABLE_SCHEMAS:
        tables.table(name).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    spark = tables.suite_status.sparkSession
    suite = prefix + "suite_status"
    spark.sql(
        f"SELECT * FROM {suite} WHERE run_id = (SELECT max(run_id) FROM {suite})"
    ).createOrReplaceTempView(prefix + "latest_run_summary")
    return names + [prefix + "latest_run_summary"]
