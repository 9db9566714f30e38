"""The registry store under failures, and the sink that sends from the tasks."""

import os
from datetime import datetime, timedelta

import pytest

from millrace.operators.report import audit_events
from millrace.streaming.store import RegistryStore, notifier

T0 = datetime(2024, 1, 1)
DECIDED = "id long, seq long, handle string, ts timestamp, band string, reasons array<string>, context string, category string, text string"


def decisions(n):
    return [(i, i, f"h{i % 5}", T0 + timedelta(minutes=i), ("block", "hide", "block")[i % 3], [f"r{i % 11}", "r0"], "reply", "scam", "some text") for i in range(n)]


def expected(rows):
    out = {}
    for i, _, h, ts, band, reasons, *_ in rows:
        if band == "block":
            e = out.setdefault(h, {"hits": 0, "first": ts, "reasons": [], "posts": []})
            e["hits"] += 1
            e["last"] = ts
            for x in reasons:
                if x not in e["reasons"]:
                    e["reasons"].append(x)
            e["posts"].append(str(i))
    return {h: (e["hits"], e["first"], e["last"], e["reasons"][:8], e["posts"][-10:]) for h, e in out.items()}


def got(df):
    return {r["handle"]: (r["hits"], r["first_seen"], r["last_seen"], list(r["reasons"]), list(r["post_ids"])) for r in df.collect()}


@pytest.fixture()
def opened(spark, tmp_path):
    rows = decisions(120)
    df = spark.createDataFrame(rows, DECIDED)
    for lo in range(0, 120, 20):
        df.where(f"seq >= {lo} and seq < {lo + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("where", ["delta", "merge", "switch", "after"])
def test_killed_and_started_again(spark, opened, tmp_path, where, monkeypatch):
    rows, open_ = opened
    store = RegistryStore(spark, str(tmp_path / "registry"), most=2)
    calls = {"n": 0}

    def breaking(real, before):
        def run(*a, **k):
            calls["n"] += 1
            if calls["n"] == 3 and before:
                raise OSError("killed")
            out = real(*a, **k)
            if calls["n"] == 3:
                raise OSError("killed")
            return out

        return run

    # Killed before the delta is written, after the merge but before the switch, at the switch, and after it.
    name, before = {"delta": ("manifest", False), "merge": ("_switch", True), "switch": ("_switch", True), "after": ("_switch", False)}[where]
    with monkeypatch.context() as m:
        m.setattr(store, name, breaking(getattr(store, name), before))
        q = store.write_stream(open_(), str(tmp_path / "c")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination(120)
    if where != "after":
        assert sum(x[0] for x in got(store.read()).values()) < sum(x[0] for x in expected(rows).values())
    store.write_stream(open_(), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert got(store.read()) == expected(rows)


def test_versions_are_pinned(spark, opened, tmp_path):
    rows, open_ = opened
    store = RegistryStore(spark, str(tmp_path / "registry"), most=2)
    assert store.read().count() == 0 and store.versions() == []
    store.write_stream(open_(), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(store.versions()) == 6 and len(store.manifest()[2]) <= 2
    sizes = [sum(x[0] for x in got(store.read(v)).values()) for v in store.versions()]
    assert sizes == sorted(sizes) and len(set(sizes)) == 6
    store.upsert(spark.createDataFrame(rows, DECIDED), 3)  # an old batch comes again
    assert got(store.read()) == expected(rows)
    assert store.vacuum(keep=1) and store.versions() == [6] and got(store.read()) == expected(rows)
    assert store.vacuum(keep=1) == []


def test_rows_are_sent_by_the_tasks(spark, opened, tmp_path):
    rows, open_ = opened
    heard, counts = str(tmp_path / "heard"), str(tmp_path / "counts")

    def notify(event):
        if event.split(",")[0] == '{"seq": 7':
            raise OSError("gone")
        with open(heard, "a") as f:
            f.write(f"{os.getpid()} {event}\n")

    def done(sent, failed, batch):
        with open(counts, "a") as f:
            f.write(f"{sent} {failed}\n")

    spark.dataSource.register(notifier("heard", notify, done))
    audit_events(open_()).writeStream.format("heard").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    sent = [x.split(" ", 1) for x in open(heard).read().splitlines()]
    assert len(sent) == 119 and str(os.getpid()) not in {p for p, _ in sent}
    numbers = [tuple(map(int, x.split())) for x in open(counts).read().splitlines()]
    assert sum(a for a, _ in numbers) == 119 and sum(b for _, b in numbers) == 1
    audit_events(spark.createDataFrame(rows[:5], DECIDED).repartition(3)).write.format("heard").mode("append").save()
    assert len(open(heard).read().splitlines()) == 124
