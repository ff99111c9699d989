"""State of a streaming job and its output, as versioned tables in shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the output of a micro-batch; a repeated batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    """The outbox with the rows that the latest batch of each delivery wrote.

    A subscriber who is listed twice has two rows, as in a batch job. Which batch is the latest is
    found on narrow rows; the messages themselves are only filtered. Outboxes of batch jobs, which
    have no batches, are returned as they are.
    """
    rows = spark.read.parquet(path)
    if "batch" not in rows.columns:
        return rows
    latest = rows.groupBy("delivery_id").agg(F.max("batch").alias("batch"))
    kept = rows.join(latest, ["delivery_id", "batch"], "left_semi")
    return kept.select([c for c in rows.columns if c != "batch"])


@dataclass(frozen=True)
class StateTable:
    """The latest values per key. Each batch adds the keys it changed.

    Reading before a batch never depends on what that batch wrote, so a batch that is
    repeated after a failure sees the same state. Every ``compact_every`` batches the
    state is written as a whole, which bounds the number of versions to read.
    """

    path: str
    keys: tuple[str, ...]
    schema: StructType
    compact_every: int = 20

    def _merge(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        versioned = StructType([*self.schema.fields, StructField("_version", IntegerType())])
        rows = spark.read.schema(versioned).parquet(*paths)
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        latest = F.max_by(F.struct(*values), F.col("_version")).alias("v")
        return rows.groupBy(*self.keys).agg(latest).select(*self.keys, "v.*")

    def read(self, spark: SparkSession, before: int) -> DataFrame:
        """The state as it was before batch ``before``."""
        base = before - before % self.compact_every
        if base > 0 and base == before:
            self._compact(spark, base)
        paths = [f"{self.path}/full={base}"] if base > 0 else []
        paths += [f"{self.path}/delta={b}" for b in range(base, before)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return self._merge(spark, paths)

    def _compact(self, spark: SparkSession, base: int) -> None:
        start = base - self.compact_every
        paths = [f"{self.path}/full={start}"] if start > 0 else []
        paths += [f"{self.path}/delta={b}" for b in range(start, base)]
        whole = self._merge(spark, paths).withColumn("_version", F.lit(-1))
        whole.write.mode("overwrite").parquet(f"{self.path}/full={base}")

    def write(self, changed: DataFrame, batch_id: int) -> None:
        rows = changed.select(*self.schema.names).withColumn("_version", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
