"""Structured Streaming forms: campaigns of equal texts, de-duplication, folds, limits, and the sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import farm_key
from millrace.operators.emotion import emotion
from millrace.operators.report import KEPT, audit_events, retained
from millrace.streaming.store import RegistryStore


def campaign_sessions(posts: DataFrame, watermark: str = "10 minutes", idle: str = "1799 seconds 999999 microseconds") -> DataFrame:
    """Accounts per key and session of a stream of posts (ts, handle, text); an idle gap of exactly 30 minutes splits."""
    keyed = posts.withColumn("farm_key", farm_key(F.col("text"))).where("farm_key is not null").withWatermark("ts", watermark)
    return keyed.groupBy(F.session_window("ts", idle), "farm_key").agg(F.size(F.collect_set("handle")).alias("accounts"), F.count("*").alias("posts"))


def first_sightings(posts: DataFrame, watermark: str = "6 hours", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each post once, however often it is observed within the watermark: also a cache of decisions of that life."""
    return posts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def first_actions(planned: DataFrame) -> DataFrame:
    """Each account action once for a handle and kind."""
    return planned.where("execute").dropDuplicates(["handle", "kind"])


def _stateful(rows: DataFrame, key: str, output: str, state: str, fold: Callable, idle: str | None = None) -> DataFrame:
    """``fold(key, rows in order of seq, state or None)`` gives rows and the new state.

    Idle keys are forgotten where ``idle`` is set; such a query runs until it is stopped, since time alone can end a key.
    """
    millis = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        out, new = fold(k[0], pd.concat(list(batches)).sort_values("seq", kind="stable"), held.get if held.exists else None)
        held.update(new)
        if millis is not None:
            held.setTimeoutDuration(millis)
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, output, state, "append", timeout)


def thread_folds(replies: DataFrame, idle: str | None = None) -> DataFrame:
    """Folds of a stream of replies (thread_id, seq, id, handle, text): what is kept of a thread is its first low reply and how many there were."""
    low = replies.withColumn("class", emotion(F.col("text"))).where("class is not null and thread_id is not null").select("thread_id", "seq", "id", "handle", F.col("class").alias("feeling"))

    def fold(thread, rows: pd.DataFrame, state):
        first, handle, n = state if state is not None else (None, None, 0)
        out = []
        for r in rows.itertuples():
            n += 1
            if first is None:
                first, handle = int(r.id), r.handle
            out.append((thread, r.seq, r.id, r.feeling, n, None if n == 1 else first, None if n == 1 else handle, n > 1))
        return pd.DataFrame(out, columns=["thread_id", "seq", "id", "class", "group_size", "duplicate_of", "duplicate_of_handle", "folded"]).astype({"duplicate_of": "Int64"}), (first, handle, n)

    output = "thread_id long, seq long, id long, class string, group_size long, duplicate_of long, duplicate_of_handle string, folded boolean"
    return _stateful(low, "thread_id", output, "first long, handle string, n long", fold, idle)


def admitted(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """Events (key, seq, ts) that a sliding limit admits; a key's state holds at most ``limit`` times."""
    rows = events.select(F.col(key).cast("string").alias("key"), "seq", F.unix_micros("ts").alias("at"))

    def fold(k, rows: pd.DataFrame, state):
        held, out = list(state[0]) if state is not None else [], []
        for r in rows.itertuples():
            held = [x for x in held if x > r.at - seconds * 1_000_000]
            out.append((k, r.seq, len(held) < limit))
            if out[-1][2]:
                held.append(int(r.at))
        return pd.DataFrame(out, columns=["key", "seq", "admitted"]), (held,)

    return _stateful(rows, "key", "key string, seq long, admitted boolean", "held array<long>", fold)


def retro_hits(posts: DataFrame, least: int = 2, idle: str | None = None) -> DataFrame:
    """Ids of posts of campaigns, earlier ones as soon as a campaign has ``least`` accounts: an update of what was shown.

    Posts wait in the state only until then; afterwards it holds the accounts that made the campaign.
    """
    keyed = posts.withColumn("farm_key", farm_key(F.col("text"))).where("farm_key is not null").select("farm_key", "seq", "id", "handle")

    def fold(key, rows: pd.DataFrame, state):
        accounts, waiting = (list(state[0]), list(state[1])) if state is not None else ([], [])
        out = []
        for r in rows.itertuples():
            if r.handle not in accounts and len(accounts) < least:
                accounts.append(r.handle)
            waiting.append(int(r.id))
            if len(accounts) >= least:
                out += [(key, x) for x in waiting]
                waiting = []
        return pd.DataFrame(out, columns=["farm_key", "id"]), (accounts, waiting)

    return _stateful(keyed, "farm_key", "farm_key string, id long", "accounts array<string>, waiting array<long>", fold, idle)


def write_registry(decided: DataFrame, path: str, checkpoint: str):
    """Merges the blocked accounts of every micro-batch into the registry at ``path``, each batch once."""
    return RegistryStore(decided.sparkSession, path).write_stream(decided, checkpoint)


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The registry as of its last version, or the one named."""
    return RegistryStore(spark, path).read(version)


def write_counters(decided: DataFrame, path: str, checkpoint: str):
    """Decisions by band of every micro-batch, under its number; ``report.added_up`` sums them."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.groupBy("band").agg(F.count("*").alias("decisions")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return decided.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)


def write_audit(decided: DataFrame, path: str, checkpoint: str, notify: Callable[[str], None] | None = None, most: int = KEPT):
    """Appends audit events of every micro-batch; ``notify`` gets its latest ``most`` as JSON texts, and what it raises is passed over."""

    def append(batch: DataFrame, number: int) -> None:
        events = audit_events(batch)
        events.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if notify is not None:
            for r in events.orderBy(F.desc("seq")).limit(most).select(F.to_json(F.struct("*")).alias("event")).collect():
                try:
                    notify(r["event"])
                except Exception:  # noqa: BLE001  a receiver that fails must not stop the stream
                    continue

    return decided.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def compact(spark: SparkSession, path: str, out: str, most: int = KEPT) -> None:
    """Writes the latest ``most`` audit events of all batches to a new place."""
    retained([spark.read.parquet(path).drop("batch")], "seq", most).write.parquet(out)
