"""Folds over each key's events in order, where one key may hold most of them.

Events are range-sorted by key and time, so a busy key spans many tasks, and packed: a row holds up to ``PACK`` events of a
key.  Only the packs' times (and what was asked, where the fold needs it) go through the key's one pass, in which a judge
works on a pack at a time and holds a bounded state; its verdicts go back to the packs, which all tasks unpack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.cut import kept

PACK = 8192


class Judge(Protocol):
    def run(self, times: np.ndarray, asked: np.ndarray | None) -> np.ndarray:
        """Whether each event is good; times in microseconds, in order, pack after pack of one key."""


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number, held = TaskContext.get().partitionId() << 32, None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        keys = b["k"].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(b)]
        cuts = sorted({*edges, *(x for lo, hi in zip(edges, edges[1:]) for x in range(lo, hi, PACK))})
        # The last pack may go on in the next batch.
        held = b.iloc[cuts[-2] :]
        if len(cuts) > 2:
            yield _rows(b, cuts[:-1], number)
            number += len(cuts) - 2
    if held is not None:
        yield _rows(held, [0, len(held)], number)


def _rows(b: pd.DataFrame, cuts: list[int], number: int) -> pd.DataFrame:
    part = lambda c: [b[c].to_numpy()[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
    asked = part("asked")
    return pd.DataFrame({"k": [x[0] for x in part("k")], "pack": range(number, number + len(cuts) - 1), "times": part("at"), "orders": part("o"), "asked": [x.tolist() if x[0] is not None else None for x in asked]})


def in_order(events: DataFrame, key: Column, at: Column, order: str, judge: Callable[[], Judge], asked: Column | None = None, name: str = "good") -> DataFrame:
    """``order`` and ``name`` of every event that has a time: what the key's judge finds, in order of time, then ``order``."""
    rows = events.select(F.coalesce(key.cast("string"), F.lit("")).alias("k"), at.alias("at"), F.col(order).cast("long").alias("o"), (F.lit(None) if asked is None else F.coalesce(asked.cast("string"), F.lit(""))).cast("string").alias("asked"))
    dealt = rows.where("at is not null").repartitionByRange("k", "at", "o").sortWithinPartitions("k", "at", "o")
    packs = kept(dealt.mapInPandas(_packed, "k string, pack long, times array<long>, orders array<long>, asked array<string>"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, None
        for b in batches:
            out = []
            for k, times, what in zip(b["k"], b["times"], b["asked"]):
                if k != current:
                    current, own = k, judge()
                out.append(np.asarray(own.run(np.asarray(times, np.int64), what), bool))
            yield pd.DataFrame({"pack": b["pack"], "good": out})

    verdicts = packs.select("k", "pack", "times", "asked").repartition("k").sortWithinPartitions("k", "pack").mapInPandas(judged, "pack long, good array<boolean>")
    both = packs.select("pack", "orders").join(verdicts, "pack")
    return both.select(F.inline(F.arrays_zip("orders", "good"))).select(F.col("orders").alias(order), F.col("good").alias(name))


class Sliding:
    """At most ``most`` good events within ``micros``; only good ones count.  Whole runs are judged at once, refused ones skipped."""

    def __init__(self, most: int, micros: int):
        self.most, self.micros, self.held = most, micros, np.full(max(most, 1), np.iinfo(np.int64).min // 2)

    def run(self, times: np.ndarray, asked=None) -> np.ndarray:
        out, i, step = np.zeros(len(times), bool), 0, 64
        if not self.most:
            return out
        while i < len(times):
            part = times[i : i + step]
            line = np.concatenate([self.held, part])
            # As long as all are good, the most-th good one before an event stands as many places ahead of it.
            full = line[: len(part)] > part - self.micros
            good = int(full.argmax()) if full.any() else len(part)
            out[i : i + good] = True
            self.held = line[good : good + self.most]
            i += good
            if good < len(part):
                i, step = max(i, int(np.searchsorted(times, self.held[0] + self.micros))), 64
            else:
                step = min(2 * step, 1 << 16)
        return out


class FirstIn:
    """A cache: good is what it answers.  Entries live ``micros``, aren't renewed by use, and the first in goes first beyond ``most``."""

    def __init__(self, most: int, micros: int):
        self.most, self.micros, self.entries = most, micros, {}

    def run(self, times: np.ndarray, asked) -> np.ndarray:
        out = np.zeros(len(times), bool)
        for i, (at, what) in enumerate(zip(times.tolist(), asked)):
            made = self.entries.get(what)
            if made is not None and at - made <= self.micros:
                out[i] = True
                continue
            # What is too old is dropped when it is asked for, and its successor goes to the end.
            self.entries.pop(what, None)
            self.entries[what] = at
            while len(self.entries) > self.most:
                del self.entries[next(iter(self.entries))]
        return out
