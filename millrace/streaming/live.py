"""The campaign tracker and the recent window on streams: the definitions of the batch, with their state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from millrace.functions.text import farm_text
from millrace.operators.live import Life, Tracker, keyed
from millrace.operators.overlaps import Trigrams
from millrace.operators.recent import Recent, entry_key
from millrace.settings import Folding

#: Fixed value: a post counts while its band isn't known or is this one.
VISIBLE = "ignore"


class CampaignProcessor(StatefulProcessor):
    """Clusters alive of one scope and their accounts.  Timers of event time clear what nothing has joined for a life.

    A post that comes late counts as of the latest one before it, as when posts are judged on arrival.
    """

    def __init__(self, life: Life):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "seq long", "place long, at long, farm_key string, accounts int, samples string")
        self.accounts = handle.getMapState("accounts", "seq long, account string", "at long")
        self.now = handle.getValueState("now", "at long, founded long")

    def _alive(self) -> dict[int, list]:
        """place, at, text, accounts and samples by founder, in the order of founding."""
        rows = [(k[0], list(v)) for k, v in self.clusters.iterator()]
        return dict(sorted(rows, key=lambda x: x[1][0]))

    def _forget(self, gone: set[int]) -> None:
        for seq in gone:
            self.clusters.removeKey((seq,))
        if gone:
            for k in [k for k in self.accounts.keys() if k[0] in gone]:
                self.accounts.removeKey(tuple(k))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        posts = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        alive = self._alive()
        now, founded = self.now.get() if self.now.exists() else (0, 0)
        tracker = Tracker(self.life, [(v[2], v[1], k) for k, v in alive.items()])
        out = []
        for at, seq, handle, text in zip(posts["at"].tolist(), posts["seq"].tolist(), posts["handle"], posts["farm_key"]):
            now = max(now, at)
            leader, likeness, n = tracker.record(now, seq, text)
            if leader == seq:
                founded += 1
                alive[seq] = [founded, now, text, 0, "[]"]
            mine, account = alive[leader], handle or f"#anon:{n}"
            mine[1] = now
            if not self.accounts.containsKey((leader, account)):
                self.accounts.updateValue((leader, account), (now,))
                mine[3] += 1
            samples = json.loads(mine[4])
            if text not in samples and len(samples) < self.life.samples:
                mine[4] = json.dumps([*samples, text])
            out.append((key[0], seq, leader, likeness, mine[3], mine[3] >= self.life.accounts))
        for seq in tracker.clusters:
            self.clusters.updateValue((seq,), tuple(alive[seq]))
        self._forget(set(alive) - set(tracker.clusters))
        self.now.update((now, founded))
        self.handle.registerTimer((now + self.life.micros) // 1000 + 1)
        yield pd.DataFrame(out, columns=["scope", "seq", "leader", "similarity", "accounts", "hit"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._forget({k for k, v in self._alive().items() if v[1] <= at - self.life.micros})
        yield pd.DataFrame(columns=["scope", "seq", "leader", "similarity", "accounts", "hit"])

    def close(self) -> None:
        pass


def live_campaigns(posts: DataFrame, life: Life = Life(), scope: Column | None = None, watermark: str = "10 minutes") -> DataFrame:
    """scope, seq, leader, similarity, accounts, hit of each post (seq, id, handle, text, ts) of a stream, as of its arrival.

    Needs the RocksDB state store.  ``scope`` tells trackers apart: one viewer's timeline each.
    """
    timed = keyed(posts, scope).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", watermark)
    schema = "scope string, seq long, leader long, similarity double, accounts int, hit boolean"
    return timed.groupBy("scope").transformWithStateInPandas(CampaignProcessor(life), schema, "Append", "EventTime")


def _scoped(rows: DataFrame, scope: Column | None) -> Column:
    return F.lit("") if scope is None else F.coalesce(scope.cast("string"), F.lit(""))


def _held(handle: StatefulProcessorHandle, value: str):
    return handle.getMapState("entries", "key string", value)


class WindowProcessor(StatefulProcessor):
    """What was seen last: for each observation the ids that the window holds before it, oldest first."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = _held(handle, "place long, id long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        posts = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        seen, n, out = Recent(self.size, dict(sorted(before.items(), key=lambda x: x[1][0]))), self.count.get()[0] if self.count.exists() else 0, []
        for seq, id_, own in zip(posts["seq"].tolist(), posts["id"].tolist(), posts["key"]):
            n += 1
            seen.push(own, (n, id_))
            out.append((key[0], seq, id_, [v[1] for k, v in seen.entries.items() if k != own]))
        for k in set(before) - set(seen.entries):
            self.entries.removeKey((k,))
        for k, v in seen.entries.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["scope", "seq", "id", "window"])

    def close(self) -> None:
        pass


def recent_window(posts: DataFrame, size: int = 60, scope: Column | None = None) -> DataFrame:
    """scope, seq, id and the ids that the recent window holds besides; a post takes one of the ``size`` places itself."""
    rows = posts.select(_scoped(posts, scope).alias("scope"), "seq", F.col("id").cast("long").alias("id"), entry_key(F.col("id"), F.col("handle"), F.col("text")).alias("key"))
    return rows.groupBy("scope").transformWithStateInPandas(WindowProcessor(size), "scope string, seq long, id long, window array<long>", "Append", "None")


class ReferenceProcessor(StatefulProcessor):
    """The recent window with bands that are filled in when decisions come, however late; asked for a reply's references."""

    def __init__(self, s: Folding):
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = _held(handle, "place long, seq long, thread_id long, normal string, band string")
        self.waiting = handle.getMapState("waiting", "seq long", "key string, thread_id long, normal string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        log = pd.concat(list(rows)).sort_values("at", kind="stable").astype({"thread_id": "Int64"})
        log = log.astype(object).where(log.notna(), None)
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        seen, n, out = Recent(self.s.window, {k: list(v) for k, v in sorted(before.items(), key=lambda x: x[1][0])}), self.count.get()[0] if self.count.exists() else 0, []
        for kind, seq, own, thread, normal, band in zip(log["kind"], log["seq"], log["key"], log["thread_id"], log["normal"], log["band"]):
            seq, thread = int(seq), None if thread is None else int(thread)
            if kind == "observe":
                n += 1
                seen.push(own, [n, seq, thread, normal, None])
                self.waiting.updateValue((seq,), (own, thread, normal))
            elif kind == "decide":
                for v in seen.entries.values():
                    if v[1] == seq and v[4] is None:
                        v[4] = band
            elif self.waiting.containsKey((seq,)):
                own, thread, normal = self.waiting.getValue((seq,))
                self.waiting.removeKey((seq,))
                refs = [v[3] for k, v in seen.entries.items() if thread is not None and v[2] == thread and k != own and v[1] != seq and v[4] in (None, VISIBLE)]
                out.append((key[0], seq, *_likeness(normal, refs[-self.s.most_references :])))
        for k in set(before) - set(seen.entries):
            self.entries.removeKey((k,))
        for k, v in seen.entries.items():
            if before.get(k) != tuple(v):
                self.entries.updateValue((k,), tuple(v))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["scope", "seq", "references", "median_similarity"])

    def close(self) -> None:
        pass


def _likeness(text: str, others: list[str]) -> tuple[int, float]:
    if not others:
        return 0, 0.0
    t, j = Trigrams([text, *others]), np.arange(1, len(others) + 1)
    alike = np.where((t.length[0] == 0) | (t.length[j] == 0), 0.0, t.common(0 * j, j) / t.smaller(0 * j, j))
    return len(others), round(float(np.median(alike)), 6)


def asked_references(events: DataFrame, s: Folding = Folding(), scope: Column | None = None) -> DataFrame:
    """``folds.asked_references`` of a stream of tagged events: scope, seq, references, median_similarity of what is asked.

    Observations wait in the state until they are asked about, which an observation is once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = events.select(_scoped(events, scope).alias("scope"), "at", "kind", "seq", "thread_id", "band", entry_key(F.col("id"), F.col("handle"), text).alias("key"), farm_text(text).alias("normal"))
    return rows.groupBy("scope").transformWithStateInPandas(ReferenceProcessor(s), "scope string, seq long, references int, median_similarity double", "Append", "None")


class ChangedProcessor(StatefulProcessor):
    """What was last seen of a post: its content's signature, and the epoch of the settings that it was judged under."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long, signature string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, passed = self.last.get() if self.last.exists() else None, []
        for epoch, signature in zip(seen["epoch"].tolist(), seen["signature"]):
            new = last is None or epoch > last[0] or (epoch == last[0] and signature != last[1])
            if new:
                last = (epoch, signature)
            passed.append(new)
        if last is not None:
            self.last.update(tuple(last))
        yield seen[passed][["key", "seq", "epoch", "signature"]]

    def close(self) -> None:
        pass


def changed_content(posts: DataFrame, epoch: Column, parts: tuple[str, ...] = ("text", "handle", "display_name", "card_text", "media_count")) -> DataFrame:
    """key, seq, epoch, signature of observations that must be judged: new or changed content, or a newer epoch of the settings.

    A post that comes again unchanged passes once more after each new epoch; one of an older epoch never does.
    """
    text = F.coalesce("text", F.lit(""))
    named = [p for p in parts if p in posts.columns]
    signature = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in named)), 256)
    rows = posts.select(entry_key(F.col("id"), F.col("handle"), text).alias("key"), "seq", epoch.cast("long").alias("epoch"), signature.alias("signature"))
    return rows.groupBy("key").transformWithStateInPandas(ChangedProcessor(), "key string, seq long, epoch long, signature string", "Append", "None")
