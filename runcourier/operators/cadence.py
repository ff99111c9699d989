"""Delivery times: recurring slots in a time zone, one-time sends, debounced updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.schema import one_of


@dataclass(frozen=True)
class Cadence:
    """``step`` for slots within a day, ``local_time`` for one slot on each listed weekday."""

    name: str
    step: str | None = None
    local_time: str | None = None
    weekdays: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    once: bool = False


# The cadences on offer. Weekdays count from Sunday = 1.
CADENCES = {
    c.name: c
    for c in (
        Cadence("15min", step="15 minutes"),
        Cadence("hourly", step="1 hour"),
        Cadence("daily", local_time="07:00"),
        Cadence("weekdays", local_time="07:00", weekdays=(2, 3, 4, 5, 6)),
        Cadence("weekly", local_time="07:00", weekdays=(2,)),
        Cadence("once", local_time="14:55", once=True),
    )
}
ZONE = "America/New_York"


def bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the first midnight and the midnight after the last timestamp."""
    first = F.date_trunc("day", F.min(ts)).cast("timestamp_ntz")
    last = F.date_trunc("day", F.max(ts)).cast("timestamp_ntz")
    return df.agg(first.alias("lo"), (last + F.expr("interval 1 day")).alias("hi"))


def slots(limits: DataFrame, cadence: str | Cadence, zone: str = ZONE) -> DataFrame:
    """The delivery slots of a cadence between ``lo`` and ``hi``, both included, in UTC.

    Times of day are meant in ``zone``, so they move in UTC when the zone changes its
    offset. Steps run from local midnight on; where the clock is set back, they go on.
    """
    if isinstance(cadence, str):
        one_of(cadence, tuple(CADENCES), "cadence")
        cadence = CADENCES[cadence]
    if cadence.step:
        # Offsets of zones are whole quarters of an hour, so the steps of the local clock are
        # among the common divisor's on the UTC clock.
        step = int(pd.Timedelta(cadence.step).total_seconds())
        fine = math.gcd(step, 900)
        every = limits.select(F.explode(F.expr(f"sequence(lo, hi, interval {fine} seconds)")).alias("slot"))
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("slot"))
        second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
        return every.where(second % step == 0)
    # One day of margin on both sides covers every zone offset.
    days = F.expr("sequence(date_sub(date(lo), 1), date_add(date(hi), 1), interval 1 day)")
    local = limits.select("lo", "hi", F.explode(days).alias("day")).where(
        F.dayofweek("day").isin(*cadence.weekdays)
    )
    clock = F.expr(f"day + interval '{cadence.local_time}' hour to minute").cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), clock)
    found = local.select("lo", "hi", utc.alias("slot")).where("slot between lo and hi")
    if cadence.once:
        return found.agg(F.min("slot").alias("slot")).where("slot is not null")
    return found.select("slot")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


_FIRST_SCHEMA = "_key string, _bucket bigint, _first_fire bigint"


def _first_fires(gap: int):
    """For each bucket of updates, the first fire of the dense stretch it belongs to."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fire, last = object(), 0, 0
        for batch in batches:
            found = []
            for k, lo, hi, known in zip(
                batch["_key"], batch["_lo"], batch["_hi"], batch["_last_fire"], strict=True
            ):
                if k != key:
                    known = None if pd.isna(known) else int(known)
                    if known is None:
                        fire = lo
                    else:
                        fire = known if lo <= known else max(lo, known + gap)
                    key = k
                elif lo - last > gap:
                    covering = fire + -(-max(0, last - fire) // gap) * gap
                    fire = max(lo, covering + gap)
                last = hi
                found.append(fire)
            yield pd.DataFrame(
                {"_key": batch["_key"], "_bucket": batch["_bucket"], "_first_fire": found}
            )

    return walk


def debounce(
    updates: DataFrame,
    key: str,
    ts: str,
    gap_seconds: int,
    last_fires: DataFrame | None = None,
) -> DataFrame:
    """Fires at least ``gap_seconds`` apart per key, each covering the updates before it.

    The first update of a key fires at once. A later update at ``t`` fires at the later of
    ``t`` and the last fire plus the gap, unless a fire at or after ``t`` is already set,
    in which case it joins that fire. Result: ``(key, fire_ts, n_updates)``.

    While updates follow each other within the gap, fires are exactly one gap apart, so
    only the first fire of such a stretch has to be found in sequence. For that the
    updates are reduced to one row per key and span of one gap; a very busy key is bounded
    by the length of the time range. ``last_fires`` (``key``, ``last_fire``) continues an
    earlier computation.
    """
    gap = gap_seconds * 1_000_000
    named = updates.select(F.col(key).cast("string").alias("_key"), _micros(F.col(ts)).alias("_t"))
    counted = (
        named.where("_t is not null")
        .groupBy("_key", "_t")
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.expr(f"(_t - pmod(_t, {gap})) div {gap}"))
    )
    # The count is not needed here, but with it both uses share one shuffle of the updates.
    spans = counted.groupBy("_key", "_bucket").agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.sum("_n").alias("_n")
    )
    if last_fires is None:
        spans = spans.withColumn("_last_fire", F.lit(None).cast("double"))
    else:
        known = last_fires.select(
            F.col(key).cast("string").alias("_key"),
            _micros(F.col("last_fire")).alias("_last_fire"),
        )
        spans = spans.join(known, "_key", "left")
    ordered = spans.repartition("_key").sortWithinPartitions("_key", "_bucket")
    firsts = ordered.mapInPandas(_first_fires(gap), _FIRST_SCHEMA)
    steps = F.expr(f"greatest(_t - _first_fire + {gap - 1}, 0) div {gap}")
    # Equal also when both keys are null.
    stretch = firsts.select(
        F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), "_first_fire"
    )
    same = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    fires = counted.join(stretch, same).select(
        "_key", "_n", (F.col("_first_fire") + steps * gap).alias("_fire")
    )
    return fires.groupBy("_key", "_fire").agg(F.sum("_n").alias("n_updates")).select(
        F.col("_key").cast(updates.schema[key].dataType).alias(key),
        F.timestamp_micros("_fire").cast("timestamp_ntz").alias("fire_ts"),
        "n_updates",
    )
