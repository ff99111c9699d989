"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.schema import one_of


def local_session(cpus: int | str = 8, app: str = "runcourier", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="runcourier-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


# At most this many rows are ever shipped to every executor.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    # A count is spread over all tasks; a limit would gather its rows in one.
    return df.count() <= rows


def join_config(
    big: DataFrame,
    config: DataFrame,
    on: str,
    how: str = "inner",
    salt_on: list[str] | None = None,
    salts: int = 64,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts with a configuration table that is expected to be small.

    The configuration side is counted first. While it fits it is broadcast, so the
    facts are not shuffled and one hot key does no harm. Beyond that, the facts of a
    key are spread over ``salts`` groups by ``salt_on`` and the configuration is
    repeated for each group. ``how`` is ``inner`` or ``left``: the repeated rows would show
    several times in any other join.
    """
    one_of(how, ("inner", "left"), "how")
    if is_small(config, rows):
        return big.join(F.broadcast(config), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*(salt_on or big.columns)), F.lit(salts)))
    spread = config.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = spread.withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted.join(spread, [on, "_salt"], how).drop("_salt")
