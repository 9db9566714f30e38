"""Campaigns as they live: clusters of near texts whose leaders die when nothing joins them for a while.

A post joins the first cluster, in the order of their founding, that is alive and whose leader its text is near to, or
founds one; whatever joins keeps the cluster alive.  ``Tracker`` is that definition; batch and stream both run it.

In a batch time is cut into chunks that are folded side by side.  A chunk starts from what the hours before it leave
alive, found by replaying them; afterwards each chunk's start is compared with its predecessor's end.  Where they agree
the result is the fold's, exactly.  Chunks that differ (a campaign older than what was replayed) are folded again from
their predecessor's end, and on from there to the end of their strand or until what was found before holds again.  All
strands are folded side by side; each round doubles their length, so rounds are as few as the logarithm of the number of
chunks, and one campaign that outlives everything costs one fold by one task.  What a task holds are the clusters alive at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import farm_key, overlap, shingles
from millrace.operators.cut import kept
from millrace.operators.overlaps import Trigrams, millionths


@dataclass(frozen=True)
class Life:
    """A cluster's life after its last post, likeness, accounts of a campaign, samples shown, clusters held (None: all)."""

    seconds: int = 30 * 60
    similarity: float = 0.8
    accounts: int = 2
    samples: int = 3
    most: int | None = 300
    #: Length of a chunk and of what is replayed before it, in lives.
    chunk: int = 24
    replay: int = 4
    #: Chunks that are folded again in a row, at first.
    strand: int = 8

    @property
    def micros(self) -> int:
        return self.seconds * 1_000_000


#: Bitmaps are made anew for the clusters alive once so many trigrams of other characters have been seen.
_SEEN = 1 << 16
#: Trigrams of Latin letters and digits have columns of their own, which need no look-up.
_LATIN = np.full(128, 36, np.int64)
_LATIN[48:58], _LATIN[97:123] = np.arange(10), np.arange(10, 36)
_PLAIN = 36**3


def _grams(key: str) -> tuple[int, int, set[str]]:
    """Bitmap and number of a text's trigrams of Latin letters and digits, and its other ones; a shorter text is its own."""
    if len(key) < 3:
        return 0, 0, {key}
    point = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), "<u4")
    of = _LATIN[np.minimum(point, 127)]
    plain = (of[:-2] < 36) & (of[1:-1] < 36) & (of[2:] < 36)
    flags = np.zeros(_PLAIN, np.uint8)
    flags[((of[:-2] * 36 + of[1:-1]) * 36 + of[2:])[plain]] = 1
    return _packed(flags), int(np.count_nonzero(flags)), {key[i : i + 3] for i in np.flatnonzero(~plain)}


def _packed(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


class Tracker:
    """Clusters alive, in the order of their founding; posts come in order of time."""

    def __init__(self, life: Life, held: list[tuple[str, int, int]] = ()):
        self.life, self.bit, self.clusters, self.age, self.known = life, {}, {}, {}, {}
        for key, at, seq in held:
            self._found(key, at, seq)
        # Restored clusters age in the order of their last post, not of their founding.
        self.age = dict(sorted(self.age.items(), key=lambda x: x[1]))

    def held(self, at: int | None = None) -> list[tuple[str, int, int]]:
        """Leader's text, last post's time and founder of each cluster, without those that are dead at ``at``."""
        return [(c[0], self.age[seq], seq) for seq, c in self.clusters.items() if at is None or self.age[seq] > at - self.life.micros]

    def _bits(self, latin: int, others: set[str]) -> int:
        found = [self.bit[g] for g in others if g in self.bit]
        if not found:
            return latin
        flags = np.zeros(len(self.bit) // 8 * 8 + 8, np.uint8)
        flags[found] = 1
        return latin | _packed(flags) << _PLAIN

    def _found(self, key: str, at: int, seq: int, grams: tuple[int, int, set[str]] | None = None) -> None:
        latin, n, others = grams or _grams(key)
        if len(self.bit) > _SEEN:
            self.bit = {}
            for k, c in self.clusters.items():
                theirs, _, own = _grams(c[0])
                for g in own:
                    self.bit.setdefault(g, len(self.bit))
                self.clusters[k] = (c[0], self._bits(theirs, own), c[2])
        for g in others:
            self.bit.setdefault(g, len(self.bit))
        self.clusters[seq], self.age[seq] = (key, self._bits(latin, others), n + len(others)), at

    def _evict(self, at: int) -> None:
        dead = at - self.life.micros
        # Both are in order of time, so what is too old stands in front.
        while self.age and self.age[first := next(iter(self.age))] <= dead:
            del self.age[first], self.clusters[first]
        while self.known and self.known[text := next(iter(self.known))][1] <= dead:
            del self.known[text]
        while self.life.most is not None and len(self.clusters) > self.life.most:
            first = next(iter(self.clusters))
            del self.clusters[first], self.age[first]

    def record(self, at: int, seq: int, key: str) -> tuple[int, float, int]:
        """Founder of the post's cluster, likeness to its leader, and how many clusters are alive afterwards."""
        self._evict(at)
        # A text that has joined a cluster joins it again as long as that lives: one founded before would have been taken then.
        leader = self.known.get(key, (None,))[0]
        likeness = 1.0
        if leader not in self.clusters:
            grams = _grams(key)
            leader, likeness = self._first(key, grams)
            if leader is None:
                leader, likeness = seq, 1.0
                self._found(key, at, seq, grams)
        elif self.clusters[leader][0] != key:
            likeness = self.known[key][2]
        self.age.pop(leader, None)
        self.age[leader] = at
        self.known.pop(key, None)
        self.known[key] = (leader, at, likeness)
        return leader, likeness, len(self.clusters)

    def _first(self, key: str, grams: tuple[int, int, set[str]]) -> tuple[int | None, float]:
        latin, size, others = grams
        own, n, size = self._bits(latin, others), len(key), size + len(others)
        for seq, (text, bits, theirs) in self.clusters.items():
            if 2 * min(n, len(text)) >= max(n, len(text)):
                likeness = (own & bits).bit_count() / min(size, theirs)
                if likeness >= self.life.similarity:
                    return seq, likeness
        return None, 0.0


def keyed(posts: DataFrame, scope: Column | None = None) -> DataFrame:
    """scope, seq, id, handle, at, farm_key of posts that take part; ``scope`` tells trackers apart (one for all by default)."""
    rows = posts.select(
        (F.lit("") if scope is None else F.coalesce(scope.cast("string"), F.lit(""))).alias("scope"), "seq", "id", F.regexp_replace(F.lower(F.coalesce("handle", F.lit(""))), "^@+", "").alias("handle"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.explode(F.array_compact(F.array(farm_key(F.col("text"))))).alias("farm_key"),
    )
    return rows.where("at is not null and seq is not null")


#: ``held`` is the JSON of ``Tracker.held``; what is compared are digests of it.
_FOLDED = "kind int, scope string, chunk long, seq long, leader long, similarity double, alive int, started string, ended string, held string"


def _digest(held: str) -> str:
    return hashlib.sha256(held.encode()).hexdigest()


def _folds(rows: DataFrame, life: Life) -> DataFrame:
    """Posts' clusters (kind 0), and start and end of each chunk (kind 1), from rows dealt by scope and strand.

    phase 0 tells of a chunk that was folded before from which start (``was``), and brings what its predecessor leaves
    (``held``) where that differs; 1 are posts that are replayed, 2 the chunk's own.  What was found before holds, and is
    not given again, where the fold comes to the same start.
    """
    width = life.micros * life.chunk

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strand = chunk = tracker = started = None
        first = on = True
        out: list[tuple] = []

        def close() -> None:
            if chunk is not None and started is not None:
                held = json.dumps(tracker.held((chunk + 1) * width))
                out.append((1, strand[0], chunk, None, None, None, None, started, _digest(held), held))

        for b in batches:
            for scope, s, c, phase, at, seq, key, held, was in zip(b["scope"], b["strand"], b["chunk"], b["phase"], b["at"], b["seq"], b["farm_key"], b["held"], b["was"]):
                if (scope, s) != strand or c != chunk:
                    close()
                    if (scope, s) != strand:
                        tracker, first, on = Tracker(life), True, True
                    strand, chunk, started = (scope, s), c, None
                if phase == 0:
                    if on and not first:
                        on = _digest(json.dumps(tracker.held(c * width))) != was
                    elif on := held is not None:
                        tracker = Tracker(life, json.loads(held))
                    first = False
                    continue
                if not on:
                    continue
                if phase == 2 and started is None:
                    started = _digest(json.dumps(tracker.held(c * width)))
                found = tracker.record(at, seq, key)
                if phase == 2:
                    out.append((0, scope, c, seq, *found, None, None, None))
            if len(out) > 10_000:
                yield _frame(out)
                out.clear()
        close()
        if out:
            yield _frame(out)

    dealt = rows.repartition("scope", "strand").sortWithinPartitions("scope", "strand", "chunk", "phase", "at", "seq")
    return dealt.mapInPandas(run, _FOLDED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "scope", "chunk", "seq", "leader", "similarity", "alive", "started", "ended", "held"])
    return out.astype({"seq": "Int64", "leader": "Int64", "alive": "Int64", "similarity": "Float64"})


def memberships(rows: DataFrame, life: Life = Life()) -> DataFrame:
    """scope, seq, leader (the founder's seq), similarity, alive of each row of ``keyed``; posts are in order of at, then seq."""
    width, reach = life.micros * life.chunk, life.micros * life.replay
    none = F.lit(None).cast("string")
    own = rows.select("scope", "seq", "at", "farm_key", F.floor(F.col("at") / width).alias("chunk")).withColumns({"held": none, "was": none})
    replayed = own.where(F.col("at") >= (F.col("chunk") + 1) * width - reach).withColumns({"chunk": F.col("chunk") + 1, "phase": F.lit(1)})
    own = own.withColumn("phase", F.lit(2))
    # Chunks without posts of their own have no state; what they would pass on is dead, a chunk being longer than a life.
    found, length = kept(_folds(own.unionByName(replayed).withColumn("strand", F.col("chunk")), life)), life.strand
    while True:
        states = found.where("kind = 1")
        ends = states.select("scope", (F.col("chunk") + 1).alias("chunk"), F.col("ended").alias("before"))
        # Only digests are compared, so what is joined is small.
        both = states.select("scope", "chunk", F.col("started").alias("was")).join(ends, ["scope", "chunk"], "left")
        both = kept(both.select("scope", "chunk", "was", (F.col("was") != F.coalesce("before", F.lit(_digest("[]")))).alias("apart")))
        if both.where("apart").isEmpty():
            return found.where("kind = 0").select("scope", "seq", "leader", "similarity", "alive")
        strand = F.floor(F.col("chunk") / length).alias("strand")
        firsts = both.where("apart").groupBy("scope", strand).agg(F.min("chunk").alias("first"))
        from_first = lambda df: df.withColumn("strand", strand).join(firsts, ["scope", "strand"]).where("chunk >= first").drop("first")  # noqa: E731,B023
        # Texts of clusters alive are never broadcast.
        given = states.select("scope", (F.col("chunk") + 1).alias("chunk"), F.col("held").alias("given")).hint("merge")
        given = from_first(both).join(given, ["scope", "chunk"], "left").withColumn("held", F.when(F.col("apart"), F.coalesce("given", F.lit("[]")))).drop("given", "apart")
        given = given.withColumns({"seq": F.lit(0).cast("long"), "at": F.lit(0).cast("long"), "farm_key": F.lit(""), "phase": F.lit(0)})
        again = kept(_folds(from_first(own).unionByName(given), life))
        found = kept(found.join(again.where("kind = 1").select("scope", "chunk"), ["scope", "chunk"], "left_anti").unionByName(again))
        length *= 2


def accounts_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with their cluster and account: posts without an author count by how many clusters were alive."""
    both = rows.join(members, ["scope", "seq"])
    return both.withColumn("account", F.when(F.col("handle") == "", F.concat(F.lit("#anon:"), F.col("alive").cast("string"))).otherwise(F.col("handle")))


def clusters(members: DataFrame, life: Life = Life()) -> DataFrame:
    """scope, leader, accounts, posts, founded, last, hit_at (when it had enough accounts, else null) and samples (text and first time) of each cluster.

    ``members`` is what ``accounts_of`` gives.  Accounts and texts are reduced to their first post before anything is ranked.
    """
    by = ["scope", "leader"]
    people = members.groupBy(*by, "account").agg(F.min(F.struct("at", "seq")).alias("first"), F.count("*").alias("posts"), F.max("at").alias("last"))
    sizes = people.groupBy(by).agg(F.count("*").alias("accounts"), F.sum("posts").alias("posts"), F.min("first.at").alias("founded"), F.max("last").alias("last"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("first"))
    hits = people.withColumn("nth", nth).where(F.col("nth") <= life.accounts).where(F.col("nth") == life.accounts).select(*by, F.col("first.at").alias("hit_at"))
    texts = members.groupBy(*by, "farm_key").agg(F.min(F.struct("at", "seq")).alias("first"))
    few = texts.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("first"))).where(F.col("nth") <= life.samples)
    shown = few.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("nth", "farm_key", F.col("first.at").alias("at")))).alias("samples"))
    return sizes.join(hits, by, "left").join(shown, by)


#: Texts of a bucket that are compared all with all; the texts of a fuller one meet by their trigrams.
DENSE = 4096


def meetings(lives: DataFrame, probes: DataFrame, width: int, similarity: float, dense: int = DENSE) -> DataFrame:
    """lid, pid, similarity where a probe (pid, farm_key, at) is near to a life (lid, farm_key, lo, hi) with lo <= at < hi.

    Time is cut into buckets of ``width``; a life stands in each that it touches, a probe in its own.
    """
    spanned = lives.select(F.lit(0).alias("kind"), F.col("lid").alias("ref"), "farm_key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bucket"))
    asked = probes.select(F.lit(1).alias("kind"), F.col("pid").alias("ref"), "farm_key", F.col("at").alias("lo"), F.col("at").alias("hi"), F.floor(F.col("at") / width).alias("bucket"))
    rows = kept(spanned.unionByName(asked))
    full = kept(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > dense))
    if full.isEmpty():
        return _dense(rows, similarity)
    few, many = rows.join(full, "bucket", "left_anti"), rows.join(full, "bucket", "left_semi")
    return _dense(few, similarity).unionByName(_by_trigrams(many, similarity))


def _dense(rows: DataFrame, similarity: float) -> DataFrame:
    def near(part: pd.DataFrame) -> pd.DataFrame:
        is_life = (part["kind"] == 0).to_numpy()
        x, y = np.flatnonzero(is_life), np.flatnonzero(~is_life)
        lo, hi = part["lo"].to_numpy(), part["hi"].to_numpy()
        a, b = np.nonzero((lo[x][:, None] <= lo[y]) & (lo[y] < hi[x][:, None]))
        a, b = x[a], y[b]
        t = Trigrams(part["farm_key"].tolist())
        sized = 2 * np.minimum(t.length[a], t.length[b]) >= np.maximum(t.length[a], t.length[b])
        a, b = a[sized], b[sized]
        common, smaller = t.common(a, b), t.smaller(a, b)
        good = common / smaller >= similarity
        ref = part["ref"].to_numpy()
        return pd.DataFrame({"lid": ref[a[good]], "pid": ref[b[good]], "similarity": millionths(common[good], smaller[good]) / 1e6})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if len(b) and b["bucket"].iloc[-1] != held[0]["bucket"].iloc[0]:
                every = pd.concat(held)
                open_ = every["bucket"] == every["bucket"].iloc[-1]
                for _, part in every[~open_].groupby("bucket"):
                    yield near(part)
                held = [every[open_]]
        for _, part in pd.concat(held).groupby("bucket") if held else ():
            yield near(part)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "lid long, pid long, similarity double")


def _by_trigrams(rows: DataFrame, similarity: float) -> DataFrame:
    """The same by an equi-join: of n trigrams of the smaller text, one of the n - ceil(s n) + 1 rarest in the bucket is shared."""
    hashed = F.transform(shingles(F.col("farm_key")), lambda g: F.xxhash64(g))
    rows = kept(rows.withColumns({"grams": hashed, "length": F.length("farm_key")}).withColumn("size", F.size("grams")).drop("farm_key"))
    each = rows.select("bucket", "kind", "ref", "size", "length", "lo", "hi", F.explode("grams").alias("gram"))
    df = each.groupBy("bucket", "gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("bucket", "kind", "ref").orderBy("df", "gram"))
    each = each.join(df, ["bucket", "gram"]).withColumn("place", place)
    needed = lambda n: F.ceil(n * similarity - 1e-9)
    each = each.withColumn("early", F.col("place") <= F.col("size") - needed(F.col("size")) + 1)
    x, y = each.where("kind = 0").alias("x"), each.where("kind = 1").alias("y")
    least = F.least("x.size", "y.size")
    # The smaller text offers its rarest trigrams only; in the larger one as many as are needed must still follow.
    offered = F.when(F.col("x.size") <= F.col("y.size"), F.col("x.early") & (F.col("y.size") - F.col("y.place") + 1 >= needed(least))).otherwise(F.col("y.early") & (F.col("x.size") - F.col("x.place") + 1 >= needed(least)))
    alike = F.least("x.length", "y.length") * 2 >= F.greatest("x.length", "y.length")
    meets = (F.col("x.lo") <= F.col("y.lo")) & (F.col("y.lo") < F.col("x.hi"))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.gram") == F.col("y.gram")) & meets & alike & offered)
    pairs = pairs.select(F.col("x.bucket").alias("bucket"), F.col("x.ref").alias("lid"), F.col("y.ref").alias("pid")).distinct()
    sides = [rows.where(F.col("kind") == k).select("bucket", F.col("ref").alias(c), F.col("grams").alias(f"g_{c}")) for k, c in enumerate(("lid", "pid"))]
    joined = pairs.join(sides[0], ["bucket", "lid"]).join(sides[1], ["bucket", "pid"]).withColumn("similarity", overlap(F.col("g_lid"), F.col("g_pid")))
    return joined.where(F.col("similarity") >= similarity).select("lid", "pid", F.round("similarity", 6).alias("similarity"))


def runs(rows: DataFrame, life: Life = Life()) -> DataFrame:
    """farm_key, rid (its first post's seq), start, end of the stretches of time in which one text comes again within a life."""
    w = Window.partitionBy("scope", "digest").orderBy("at", "seq")
    each = rows.withColumn("digest", F.unhex(F.md5("farm_key"))).withColumn("cut", F.floor(F.col("at") / life.micros))
    # Within one life's length all posts of a text are one run: they are summed before they are put in order.
    cut = each.groupBy("scope", "digest", "cut").agg(F.min(F.struct("at", "seq")).alias("first"), F.max("at").alias("last"), F.min_by("farm_key", "seq").alias("farm_key"))
    cut = cut.select("scope", "digest", "farm_key", F.col("first.at").alias("at"), F.col("first.seq").alias("seq"), "last")
    fresh = F.when(F.col("at") - F.lag("last").over(w) < life.micros, 0).otherwise(1)
    cut = cut.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy("scope", "digest", "run").agg(F.min_by("farm_key", F.struct("at", "seq")).alias("farm_key"), F.min(F.struct("at", "seq")).alias("first"), F.max("last").alias("end")).select(
        "scope", "farm_key", F.col("first.seq").alias("rid"), F.col("first.at").alias("start"), "end"
    )


def near_runs(rows: DataFrame, life: Life = Life(), dense: int = DENSE) -> DataFrame:
    """a, b, similarity of runs of different texts that are near and meet: b starts while a lives, copies being one run."""
    every = kept(runs(rows, life))
    found = meetings(every.select(F.col("rid").alias("lid"), "farm_key", F.col("start").alias("lo"), (F.col("end") + life.micros).alias("hi")), every.select(F.col("rid").alias("pid"), "farm_key", F.col("start").alias("at")), life.micros, life.similarity, dense)
    a, b = every.select(F.col("rid").alias("a"), F.col("start").alias("at_a"), F.xxhash64("farm_key").alias("of_a"), F.col("scope").alias("in_a")), every.select(F.col("rid").alias("b"), F.col("start").alias("at_b"), F.xxhash64("farm_key").alias("of_b"), F.col("scope").alias("in_b"))
    both = found.select(F.col("lid").alias("a"), F.col("pid").alias("b"), "similarity").join(a, "a").join(b, "b")
    return both.where("in_a = in_b and of_a <> of_b and (at_a < at_b or (at_a = at_b and a < b))").select("a", "b", "similarity")


def retro_hits(rows: DataFrame, found: DataFrame, life: Life = Life(), dense: int = DENSE) -> DataFrame:
    """seq and accounts (the most of any) of posts that a campaign hides after the fact.

    A post is still shown for a life.  It is hidden by a post that makes or continues a campaign if its text is near to one
    of the campaign's samples so far.  Texts are compared once for each bucket of time, then met by their posts.
    """
    width = life.micros
    some = found.where("hit_at is not null").select("scope", "accounts", "last", "hit_at", F.explode("samples").alias("s"))
    # From so long before a sample's first hit up to the last post of the cluster.
    lives = kept(some.select("scope", "accounts", F.col("s.farm_key").alias("farm_key"), (F.greatest("hit_at", "s.at") - width + 1).alias("lo"), (F.col("last") + 1).alias("hi")).withColumn("lid", F.monotonically_increasing_id()))
    texts = rows.select("scope", F.floor(F.col("at") / width).alias("bucket"), F.unhex(F.md5("farm_key")).alias("digest"), "farm_key", "at")
    texts = kept(texts.groupBy("scope", "bucket", "digest").agg(F.min_by("farm_key", "at").alias("farm_key"), F.min("at").alias("lo"), F.max("at").alias("hi")).withColumn("pid", F.monotonically_increasing_id()))
    # A text takes part in its bucket wherever its posts stand there, so lives are widened to whole buckets first.
    whole = lives.select("lid", "farm_key", (F.floor(F.col("lo") / width) * width).alias("lo"), ((F.floor((F.col("hi") - 1) / width) + 1) * width).alias("hi"))
    near = meetings(whole, texts.select("pid", "farm_key", F.col("lo").alias("at")), width, life.similarity, dense)
    near = near.join(texts.select("pid", F.col("scope").alias("in_p"), "bucket", "digest"), "pid").join(lives.select("lid", "scope", "accounts", "lo", "hi"), "lid").where("in_p = scope")
    posts = rows.select("scope", "seq", "at", F.floor(F.col("at") / width).alias("bucket"), F.unhex(F.md5("farm_key")).alias("digest"))
    hit = posts.join(near.select("scope", "bucket", "digest", "accounts", "lo", "hi"), ["scope", "bucket", "digest"]).where("lo <= at and at < hi")
    return hit.groupBy("seq").agg(F.max("accounts").alias("accounts"))
