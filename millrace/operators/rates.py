"""Counts in sliding windows, day counters, and admission under limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import Sliding, in_order


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """How many events of the key fall into (ts - seconds, ts]."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count("*").over(w))


def day_counts(events: DataFrame, kind: str, ts: str) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day"), kind).agg(F.count("*").alias("n"))


def running_day_counts(events: DataFrame, kind: str, ts: str, order: str) -> DataFrame:
    """Each event's number among those of its kind and day, as a counter that starts anew each day."""
    w = Window.partitionBy(kind, F.to_date(ts)).orderBy(ts, order)
    return events.withColumn("so_far", F.row_number().over(w))


@dataclass(frozen=True)
class Limit:
    """At most ``most`` admissions within ``seconds``, or within a UTC day where that is None."""

    most: int
    seconds: int | None = None


#: The limits of each kind of call, by the counters that it draws on.  A probe looks at the model's day but draws no minute of it.
CALLS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "model": (("model_minute", "model_day"), ("model_minute", "model_day")),
    "triage": (("triage_minute", "triage_day", "model_day"), ("triage_minute", "triage_day", "model_day")),
    "semantics": (("semantics_minute", "semantics_day", "model_minute", "model_day"), ("semantics_minute", "semantics_day", "model_minute", "model_day")),
    "media": (("media_minute",), ("media_minute",)),
    "action": (("action_hour", "action_day"), ("action_hour", "action_day")),
}
LIMITS: dict[str, Limit] = {
    "model_minute": Limit(30, 60), "model_day": Limit(800), "triage_minute": Limit(20, 60), "triage_day": Limit(600), "semantics_minute": Limit(10, 60),
    "semantics_day": Limit(300), "media_minute": Limit(60, 60), "action_hour": Limit(20, 3600), "action_day": Limit(100),
}
#: Calls of the model's day that filtering keeps for itself.
RESERVE = {"semantics": {"model_day": 50}}
DAY = 86_400_000_000


class _Counter:
    """Admissions that still count: at most ``limit.most`` times are held."""

    def __init__(self, limit: Limit) -> None:
        self.limit, self.held, self.day, self.n = limit, deque(), None, 0

    def room(self, at: int, reserve: int = 0) -> bool:
        if self.limit.seconds is None:
            if at // DAY != self.day:
                self.day, self.n = at // DAY, 0
            return self.n < self.limit.most - reserve
        while self.held and self.held[0] <= at - self.limit.seconds * 1_000_000:
            self.held.popleft()
        return len(self.held) < self.limit.most - reserve

    def take(self, at: int) -> None:
        self.n += 1
        if self.limit.seconds is not None:
            self.held.append(at)


class _Calls:
    """Counters of several limits, each kind of call drawing on some of them."""

    def __init__(self, limits: Mapping[str, Limit], calls: Mapping[str, tuple], reserve: Mapping[str, Mapping[str, int]]):
        self.counters, self.calls, self.reserve = {name: _Counter(limit) for name, limit in limits.items()}, calls, reserve

    def run(self, times: np.ndarray, asked: np.ndarray) -> np.ndarray:
        out = np.zeros(len(times), bool)
        for i, (at, call) in enumerate(zip(times.tolist(), asked)):
            checked, drawn = self.calls.get(call, ((), ()))
            held_back = self.reserve.get(call, {})
            # Every counter is asked, so that a day's turn is seen by all of them.
            out[i] = all([self.counters[c].room(at, held_back.get(c, 0)) for c in checked])
            if out[i]:
                for c in drawn:
                    self.counters[c].room(at)
                    self.counters[c].take(at)
        return out


def admit(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Which events a sliding limit admits; only admitted ones count.  Events without a time are left out."""
    return in_order(events, F.col(key), micros(ts), order, lambda: Sliding(limit, seconds * 1_000_000), name="admitted")


def admit_calls(events: DataFrame, key: str, ts: str, order: str, kind: str, limits: Mapping[str, Limit] = LIMITS) -> DataFrame:
    """Which calls of each kind the limits admit together, in order of time; semantics leave a reserve of the model's day."""
    return in_order(events, F.col(key), micros(ts), order, lambda: _Calls(limits, CALLS, RESERVE), F.col(kind), "admitted")
