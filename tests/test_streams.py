from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.emotion import emotion
from millrace.operators.folds import thread_fold
from millrace.streaming import campaigns as S

T0 = datetime(2024, 1, 1)
#: id, handle, text, thread
SAID = [(1, "a", "哈哈哈", 7), (2, "b", "太好了", 7), (3, "c", "a longer remark about the sea", 7), (4, "a", "gm", 8), (5, "b", "同意", 7), (2, "b", "太好了", 7), (6, "d", "a longer remark about the sea!", 8), (7, "d", "a longer remark about the sea", 8)]


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(i, h, t, k, n, T0 + timedelta(seconds=60 * n)) for n, (i, h, t, k) in enumerate(SAID)]
    df = spark.createDataFrame(rows, "id long, handle string, text string, thread_id long, seq long, ts timestamp")
    for n in (0, 1):  # two files, so two micro-batches
        df.where(F.col("seq") >= 4 if n else F.col("seq") < 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, spark, name):
    df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    return spark.table(name).collect()


def test_thread_folds(spark, stream):
    df, open_ = stream
    got = {(r["seq"], r["group_size"], r["duplicate_of"], r["folded"]) for r in run(S.thread_folds(open_()), spark, "folds")}
    batch = thread_fold(df.withColumns({"class": emotion(F.col("text")), "context": F.lit("reply"), "thread_root": F.lit(False)}))
    assert got == {(r["seq"], r["group_size"], r["duplicate_of"], r["folded"]) for r in batch.collect()} and len(got) == 5


def test_first_sightings(spark, stream):
    _, open_ = stream
    assert len(run(S.first_sightings(open_()), spark, "seen")) == 7


def test_admitted(spark, stream):
    _, open_ = stream
    got = {r["seq"]: r["admitted"] for r in run(S.admitted(open_(), "handle", 1, 300), spark, "admitted")}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}


def test_retro_hits(spark, stream):
    _, open_ = stream
    assert sorted(r["id"] for r in run(S.retro_hits(open_()), spark, "retro")) == [3, 6, 7]


def test_sinks(spark, stream, tmp_path):
    df, open_ = stream
    decided = open_().withColumns({"band": F.when(F.col("id") % 2 == 0, "block").otherwise("hide"), "category": F.lit("scam"), "reasons": F.array(F.lit("x")), "context": F.lit("reply"), "execute": F.lit(True), "kind": F.lit("block")})
    heard = []

    def notify(text):
        heard.append(text)
        raise OSError("gone")

    for name, sink in (("registry", S.write_registry(decided, f"{tmp_path}/r", f"{tmp_path}/rc")), ("counters", S.write_counters(decided, f"{tmp_path}/c", f"{tmp_path}/cc")), ("audit", S.write_audit(decided, f"{tmp_path}/a", f"{tmp_path}/ac", notify))):
        sink.queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    assert {r["handle"]: r["hits"] for r in S.read_registry(spark, f"{tmp_path}/r").collect()} == {"a": 1, "b": 2, "d": 1}
    assert len(heard) == 8 and spark.read.parquet(f"{tmp_path}/a").count() == 8
    S.compact(spark, f"{tmp_path}/a", f"{tmp_path}/kept", 3)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [5, 6, 7]
    assert len(run(S.first_actions(decided), spark, "actions")) == 4
