"""Streams with state against the batch and the folds: state meets across micro-batches and survives a restart."""

import random

import pytest
from pyspark.sql import functions as F
from test_live import LOG, POSTS, fold, plain, references_fold, reply_log, timeline
from test_streams import SAID, T0, timedelta

from millrace.operators import folds, live
from millrace.streaming import live as L

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def batches(df, path, order, cuts):
    """One file for each stretch of ``order``, so one micro-batch each."""
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df if lo is None else df.where(F.col(order) >= lo)
        (part if hi is None else part.where(F.col(order) < hi)).coalesce(1).write.mode("append").parquet(str(path))


def finish(spark, df, out, checkpoint):
    q = df.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(out)).collect()


def read(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_campaigns_across_batches_and_a_restart(rocks, tmp_path):
    spark, life = rocks, live.Life(most=8)
    rows = timeline(240, 12, 0.3, 2)
    df = spark.createDataFrame(rows, POSTS)
    want = {k[1]: (v[0], v[3], v[3] >= 2) for k, v in fold(plain(rows), life).items()}
    start = lambda: L.live_campaigns(read(spark, df, tmp_path / "in"), life, F.col("scope"))
    batches(df.where("seq < 160"), tmp_path / "in", "seq", [60, 110])
    finish(spark, start(), tmp_path / "out", tmp_path / "checkpoint")
    # The rest arrives after a restart: the state comes from the checkpoint.
    batches(df.where("seq >= 160"), tmp_path / "in", "seq", [200])
    got = finish(spark, start(), tmp_path / "out", tmp_path / "checkpoint")
    assert {r["seq"]: (r["leader"], r["accounts"], r["hit"]) for r in got} == want
    crossed = {r["seq"] for r in got if r["leader"] < 160 <= r["seq"] and r["similarity"] < 1}
    assert crossed, "near texts must meet across the restart"


def test_recent_window(rocks, tmp_path):
    spark = rocks
    rows = [(i, h, t, k, n, T0 + timedelta(seconds=60 * n)) for n, (i, h, t, k) in enumerate(SAID)]
    df = spark.createDataFrame(rows, "id long, handle string, text string, thread_id long, seq long, ts timestamp")
    batches(df, tmp_path / "in", "seq", [3, 5])
    got = {r["seq"]: list(r["window"]) for r in finish(spark, L.recent_window(read(spark, df, tmp_path / "in"), 3, F.col("thread_id")), tmp_path / "a", tmp_path / "ca")}
    assert got[4] == [2, 3] and got[5] == [3, 5]
    got = {r["seq"]: list(r["window"]) for r in finish(spark, L.recent_window(read(spark, df, tmp_path / "in"), 3), tmp_path / "b", tmp_path / "cb")}
    assert got == {0: [], 1: [1], 2: [1, 2], 3: [2, 3], 4: [3, 4], 5: [4, 5], 6: [5, 2], 7: [2, 6]}


def test_references_with_late_bands(rocks, tmp_path):
    spark, s = rocks, folds.Folding(window=12, most_references=5)
    events = reply_log(90, 9)
    rows = [(n, k, seq, i, t, "h", x, b) for n, (k, seq, i, t, x, b) in enumerate(events)]
    df = spark.createDataFrame(rows, LOG)
    batches(df, tmp_path / "in", "at", [50, 51, 130])
    got = finish(spark, L.asked_references(read(spark, df, tmp_path / "in"), s), tmp_path / "out", tmp_path / "c")
    assert {r["seq"]: (r["references"], r["median_similarity"]) for r in got} == references_fold(events, s)


def test_changed_content(rocks, tmp_path):
    spark, r = rocks, random.Random(3)
    rows, epoch = [], 0
    for n in range(60):
        epoch += r.random() < 0.1
        rows.append((n, r.randrange(6), "h", r.choice(["a", "b"]), epoch if r.random() < 0.9 else max(0, epoch - 1)))
    df = spark.createDataFrame(rows, "seq long, id long, handle string, text string, epoch long")
    last, want = {}, set()
    for n, i, _, t, e in rows:
        if i not in last or e > last[i][0] or (e == last[i][0] and t != last[i][1]):
            last[i] = (e, t)
            want.add(n)
    batches(df, tmp_path / "in", "seq", [20, 33])
    got = finish(spark, L.changed_content(read(spark, df, tmp_path / "in"), F.col("epoch")), tmp_path / "out", tmp_path / "c")
    assert {x["seq"] for x in got} == want and len(got) == len(want)
