"""Folds in order over hot keys: admission and the decision cache against one event at a time."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, rates, routing

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def admitted(times, most, width):
    held, out = deque(), []
    for t in times:
        while held and held[0] <= t - width:
            held.popleft()
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out


@pytest.mark.parametrize("most", [0, 1, 2, 7, 100])
@pytest.mark.parametrize("gap", [0, 1, 3, 40])
def test_sliding_is_the_fold(most, gap):
    r = random.Random(most * 10 + gap)
    times = np.cumsum([r.choice([0, gap, gap, 2 * gap, 50]) for _ in range(2000)]).astype(np.int64)
    judge, got = ordered.Sliding(most, 100), []
    for part in np.array_split(times, [1, 2, 700, 701, 1500]):
        got += judge.run(part).tolist()
    assert got == admitted(times.tolist(), most, 100)


def test_one_busy_user(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PACK", 500)
    n = 100_000
    events = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 37).cast("string"))).alias("u"), F.timestamp_micros(F.lit(int(T0.timestamp() * 1e6)) + F.pmod(F.xxhash64("id"), F.lit(10**10))).alias("ts"))
    rows = sorted((r["u"], r["ts"].timestamp(), r["id"]) for r in events.collect())
    want = {}
    for u in {x[0] for x in rows}:
        own = [(round(t * 1e6), i) for k, t, i in rows if k == u]
        want |= dict(zip((i for _, i in own), admitted([t for t, _ in own], 5, 60_000_000)))
    got = rates.admit(events, "u", "ts", "id", 5, 60)
    assert {r["id"]: r["admitted"] for r in got.collect()} == want
    # The busy user's events are sorted and unpacked by many tasks.
    spread = events.repartitionByRange(4, "u", "ts", "id").where("u = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1


def cache(requests, most, width):
    entries, out = {}, []
    for t, key in requests:
        made = entries.get(key)
        if made is not None and t - made > width:
            del entries[key]
            made = None
        out.append(made is not None)
        if made is None:
            entries[key] = t
            while len(entries) > most:
                del entries[next(iter(entries))]
    return out


def test_cache_is_the_fold(spark):
    r, rows, t, settings = random.Random(8), [], 0, 0
    for n in range(12_000):
        t += r.choice([0, 1, 1, 2, 3600 if r.random() < 0.01 else 1])
        settings += r.random() < 0.0005
        rows.append((n, f"k{r.randrange(5000) if r.random() < 0.6 else r.randrange(40)}", T0 + timedelta(seconds=t), settings, str(r.randrange(2))))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, settings long, scope string")
    for most in (routing.CACHE_ENTRIES, 50):
        want = {}
        for s in "01":
            own = [x for x in rows if x[4] == s]
            want |= dict(zip((x[0] for x in own), cache([((x[2] - T0).total_seconds(), (x[1], x[3])) for x in own], most, 6 * 3600)))
        got = routing.cached(df, F.col("k"), "ts", "id", most=most, fingerprint=F.col("settings"), scope=F.col("scope"))
        assert {x["id"]: x["hit"] for x in got.collect()} == want
    assert len({(x[1], x[3]) for x in rows if x[4] == "0"}) > 2000, "the larger cache must run over"


def test_an_entry_lives_to_its_last_second(spark):
    rows = [(0, "a", T0), (1, "a", T0 + timedelta(hours=6)), (2, "a", T0 + timedelta(hours=6, microseconds=1)), (3, "a", None)]
    got = routing.cached(spark.createDataFrame(rows, "id long, k string, ts timestamp"), F.col("k"), "ts", "id")
    assert {x["id"]: x["hit"] for x in got.collect()} == {0: False, 1: True, 2: False}
