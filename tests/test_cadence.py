import random
from collections import Counter
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from runcourier.operators.cadence import CADENCES, Cadence, bounds, debounce, slots

T0 = datetime(2024, 3, 1)


def limits_of(spark, lo, hi):
    df = spark.createDataFrame([(lo,), (hi,)], "t timestamp")
    return bounds(df.select(F.col("t").cast("timestamp_ntz").alias("ts")))


@pytest.mark.parametrize("name,days", [("daily", range(7)), ("weekdays", range(5)), ("weekly", [0])])
def test_local_slots_over_a_clock_change(spark, name, days):
    zone = ZoneInfo("America/New_York")
    lo, hi = datetime(2024, 2, 25, 3), datetime(2024, 4, 3, 8)
    got = [r.slot for r in slots(limits_of(spark, lo, hi), name).orderBy("slot").collect()]
    want, day = [], datetime(2024, 2, 24)
    while day <= datetime(2024, 4, 5):
        if day.weekday() in days:
            at = day.replace(hour=7, tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
            if datetime(2024, 2, 25) <= at <= datetime(2024, 4, 4):
                want.append(at)
        day += timedelta(days=1)
    assert got == want
    assert {s.hour for s in got} == {11, 12}


def test_steps_and_once(spark):
    limits = limits_of(spark, datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 6))
    assert slots(limits, "15min").count() == 97
    assert slots(limits, "hourly").count() == 25
    assert [r.slot for r in slots(limits, "once").collect()] == [datetime(2024, 1, 1, 19, 55)]
    sunday = Cadence("sunday", local_time="00:30", weekdays=(1,))
    assert slots(limits, sunday).collect() == []
    with pytest.raises(ValueError):
        slots(limits, "yearly")
    assert set(CADENCES) == {"15min", "hourly", "daily", "weekdays", "weekly", "once"}


def by_hand(updates, gap):
    """Fires of sorted updates, one after the other."""
    out = Counter()
    last = {}
    for key, t in sorted(updates):
        if key not in last:
            last[key] = t
        elif t > last[key]:
            last[key] = max(t, last[key] + gap)
        out[key, last[key]] += 1
    return out


def run_debounce(spark, updates, gap, known=None):
    df = spark.createDataFrame(
        [(k, T0 + timedelta(seconds=t)) for k, t in updates], "k string, t timestamp"
    )
    return {
        (r.k, (r.fire_ts - T0).total_seconds()): r.n_updates
        for r in debounce(df, "k", "t", gap, known).collect()
    }


@pytest.mark.parametrize("seed", range(4))
def test_debounce_against_a_walk(spark, seed):
    rng = random.Random(seed)
    updates = []
    for key, n, spread in (("hot", 600, 3000), ("a", 40, 2000), ("b", 40, 400), ("c", 1, 10)):
        updates += [(key, rng.randrange(spread * 4) / 4) for _ in range(n)]
    # Gaps just below, at and above the limits that matter.
    updates += [("edge", t) for t in (0, 60, 120, 180.25, 240.25, 361, 421, 481.5, 600, 720, 839.75)]
    gap = rng.choice([7, 30, 60, 90])
    assert run_debounce(spark, updates, gap) == by_hand(updates, gap)


def test_debounce_properties(spark):
    updates = [("k", float(i * 13 % 997)) for i in range(500)]
    got = run_debounce(spark, updates, 20)
    fires = sorted(f for _, f in got)
    assert all(b - a >= 20 for a, b in zip(fires, fires[1:]))
    assert sum(got.values()) == 500


def test_debounce_before_1970(spark):
    updates = [("k", t - 2_000_000_000.0) for t in (0, 5, 30, 31, 90)]
    assert run_debounce(spark, updates, 30) == by_hand(updates, 30)


def test_debounce_goes_on_from_an_earlier_fire(spark):
    rng = random.Random(3)
    updates = sorted((k, rng.randrange(4000) / 4) for k in "ab" for _ in range(80))
    early = [u for u in updates if u[1] < 400]
    late = [u for u in updates if u[1] >= 400]
    first = run_debounce(spark, early, 25)
    last = {}
    for k, f in first:
        last[k] = max(last.get(k, 0), f)
    known = spark.createDataFrame(
        [(k, T0 + timedelta(seconds=f)) for k, f in last.items()], "k string, last_fire timestamp"
    )
    both = Counter(first) + Counter(run_debounce(spark, late, 25, known))
    assert both == by_hand(updates, 25)
