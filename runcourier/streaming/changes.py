"""Table updates as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.schema import TABLE_SCHEMAS


def table_changes(
    spark: SparkSession, folder: str, tables: list[str] | None = None, max_files: int = 1000
) -> DataFrame:
    """New rows of any of the listed tables, as ``(table, run_id)``."""
    streams = []
    for name in tables or ["suite_status"]:
        rows = (
            spark.readStream.schema(TABLE_SCHEMAS[name])
            .option("maxFilesPerTrigger", max_files)
            .parquet(f"{folder}/{name}")
        )
        streams.append(rows.select(F.lit(name).alias("table"), "run_id"))
    union = streams[0]
    for other in streams[1:]:
        union = union.unionByName(other)
    return union


def file_changes(
    spark: SparkSession, folder: str, pattern: str, schema, max_files: int = 1000
) -> DataFrame:
    """New rows of the parquet files in a folder whose names match ``pattern``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )
