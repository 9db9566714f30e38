"""The window of what was seen last: the latest N distinct posts, each at its latest observation, as of any moment.

Batch and stream rest on one definition, ``Recent``: a post that is seen again moves to the end with its new text, and
what falls out stays out until it is seen again.  In a batch observations are numbered and cut into stretches that are
worked on side by side.  What a stretch has to know of the past are the last N distinct posts before it: usually all of
them stand in the stretch before; where posts repeat so often that they don't, tails of 2, 4, 8, ... stretches are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Observations that a task works on together.
STRETCH = 2048


class Recent:
    """At most ``size`` entries, oldest first."""

    def __init__(self, size: int, entries: dict | None = None):
        self.size, self.entries = size, dict(entries or {})

    def push(self, key, value) -> None:
        self.entries.pop(key, None)
        self.entries[key] = value
        while len(self.entries) > self.size:
            del self.entries[next(iter(self.entries))]


def entry_key(id_: Column, handle: Column, text: Column) -> Column:
    """What tells posts apart: the id, or author and text where a post has none."""
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(id_.cast("string"), F.lit(""))), F.concat(F.lit("h:"), F.xxhash64(F.coalesce(handle, F.lit("")), F.coalesce(text, F.lit(""))).cast("string")))


def _latest(rows: DataFrame, size: int) -> DataFrame:
    """Of each stretch the last ``size`` distinct keys: at most ``size`` rows a stretch come out."""
    last = rows.groupBy("stretch", "key").agg(F.max("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("stretch").orderBy(F.desc("place")))
    return last.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def stretches(observed: DataFrame, size: int, kept: Callable[[DataFrame], DataFrame], stretch: int = STRETCH) -> DataFrame:
    """Observations (place 1, 2, ..., key, pushes and more) by ``stretch``, each with what it needs of the past in front.

    Rows with ``lead`` are of the past.  Rows that don't push only look at the window.  ``kept`` cuts the lineage.
    """
    own = observed.withColumn("stretch", F.floor((F.col("place") - 1) / stretch))
    tails = kept(_latest(own.where("pushes").select("stretch", "key", "place"), size))
    every = own.select("stretch").distinct()
    before, reach = tails.withColumn("stretch", F.col("stretch") + 1).join(every, "stretch", "left_semi"), 1
    while True:
        short = every.where(F.col("stretch") > reach).join(before.groupBy("stretch").agg(F.count("*").alias("n")), "stretch", "left").where(F.coalesce("n", F.lit(0)) < size).select("stretch")
        if short.isEmpty():
            break
        earlier = before.withColumn("stretch", F.col("stretch") + reach).join(short, "stretch", "left_semi")
        before, reach = kept(_latest(before.unionByName(earlier.select(before.columns)), size)), 2 * reach
    lead = observed.join(before.select("stretch", "place"), "place").withColumn("lead", F.lit(True))
    return own.withColumn("lead", F.lit(False)).unionByName(lead)


def over_windows(observed: DataFrame, size: int, kept: Callable[[DataFrame], DataFrame], judge: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str, stretch: int = STRETCH) -> DataFrame:
    """``judge(rows, pairs)`` for each stretch: pairs (i, j) say that row ``j`` is in the window that row ``i`` sees.

    A row that pushes takes one of the places itself and doesn't see itself; one that only looks sees all of them.
    """

    def worked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable").reset_index(drop=True)
        seen, pairs = Recent(size), []
        for i, (key, pushes, lead) in enumerate(zip(part["key"], part["pushes"], part["lead"])):
            if pushes:
                seen.push(key, i)
            if not lead:
                pairs += [(i, j) for j in seen.entries.values() if j != i]
        return judge(part, pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if len(b) and b["stretch"].iloc[-1] != held[0]["stretch"].iloc[0]:
                every = pd.concat(held)
                done = every["stretch"] != every["stretch"].iloc[-1]
                for _, part in every[done].groupby("stretch"):
                    yield worked(part)
                held = [every[~done]]
        if held:
            for _, part in pd.concat(held).groupby("stretch"):
                yield worked(part)

    # Written once: tails, stretches and their pasts all read it.
    dealt = stretches(kept(observed), size, kept, stretch).repartition("stretch")
    return dealt.sortWithinPartitions("stretch", "place").mapInPandas(run, schema)


def windows(observed: DataFrame, size: int, kept: Callable[[DataFrame], DataFrame], stretch: int = STRETCH) -> DataFrame:
    """place and the places of the window that each observation sees, oldest first."""

    def judge(rows: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
        places, found = rows["place"].tolist(), {i: [] for i in rows.index[~rows["lead"]]}
        for i, j in pairs:
            found[i].append(places[j])
        return pd.DataFrame({"place": [places[i] for i in found], "window": list(found.values())})

    return over_windows(observed.select("place", "key", "pushes"), size, kept, judge, "place long, window array<long>", stretch)
