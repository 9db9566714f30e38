"""Copy-paste campaigns: the same or nearly the same normalized text from several accounts, within a window that idles out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import farm_key, overlap, shingles
from millrace.operators.cut import kept

#: Fixed values.
IDLE_SECONDS, LEAST_ACCOUNTS, SIMILARITY, SAMPLES = 30 * 60, 2, 0.8, 3


def account(handle: Column, id_: Column) -> Column:
    """An author; each post without one is an account of its own."""
    return F.when(F.coalesce(handle, F.lit("")) == "", F.concat(F.lit("#anon:"), id_.cast("string"))).otherwise(handle)


def keyed(posts: DataFrame) -> DataFrame:
    # As rows of a generator keys are worked out once, though a filter and several columns read them.
    rows = posts.select("*", F.explode(F.array_compact(F.array(farm_key(F.col("text"))))).alias("farm_key"))
    return rows.withColumn("account", account(F.col("handle"), F.col("id")))


def digested(posts: DataFrame) -> DataFrame:
    """``keyed`` with a digest of 128 bits for the key, which may be as long as the text: what is shuffled stays small."""
    return keyed(posts).withColumn("digest", F.unhex(F.md5("farm_key")))


def exact_accounts(posts: DataFrame, least: int = LEAST_ACCOUNTS) -> DataFrame:
    """Distinct accounts behind each key that several share."""
    rows = digested(posts)
    counted = rows.groupBy("digest").agg(F.count_distinct("account").alias("accounts"), F.count("*").alias("posts"), F.min("seq").alias("first_seq"), F.min_by("id", "seq").alias("id"))
    shared = counted.where(F.col("accounts") >= least)
    return rows.select("id", "farm_key").join(shared, "id").select("farm_key", "accounts", "posts", "first_seq")


def running_accounts(posts: DataFrame) -> DataFrame:
    """Accounts of a key as of each post: first sightings of an account count, in order."""
    rows = keyed(posts).select("id", "farm_key", "account", "seq")
    first = F.row_number().over(Window.partitionBy("farm_key", "account").orderBy("seq")) == 1
    so_far = Window.partitionBy("farm_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fresh", first.cast("int")).select("id", "farm_key", F.sum("fresh").over(so_far).alias("accounts"))


def sessions(events: DataFrame, key: str, account_col: str, ts: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """Clusters of a key whose gaps stay under ``idle`` seconds (an equal gap splits): start, end, events, accounts.

    Time is cut into stretches of ``idle`` seconds first: within one, all events of a key are one cluster, so they are
    aggregated before any window, and the window only sees a row for each key and stretch.
    """
    micros, width = F.unix_micros(F.col(ts).cast("timestamp")), idle * 1_000_000
    rows = events.select(F.col(key), F.col(account_col).alias("_account"), F.col(ts).alias("_ts"), micros.alias("_at"), F.floor(micros / width).alias("_cut"))
    cut = rows.groupBy(key, "_cut").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.min("_ts").alias("started"), F.max("_ts").alias("ended"), F.count("*").alias("events"))
    w = Window.partitionBy(key).orderBy("_cut")
    fresh = F.when(F.col("lo") - F.lag("hi").over(w) < width, 0).otherwise(1)
    cut = cut.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy(key, "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events"))
    people = rows.select(key, "_cut", "_account").distinct().join(cut.select(key, "_cut", "session"), [key, "_cut"])
    return whole.join(people.groupBy(key, "session").agg(F.count_distinct("_account").alias("accounts")), [key, "session"])


def retro_hits(posts: DataFrame, least: int = LEAST_ACCOUNTS) -> DataFrame:
    """Every post of a campaign, earlier ones too, once the campaign has enough accounts."""
    rows = digested(posts).select("id", "handle", "digest", "account")
    shared = rows.groupBy("digest").agg(F.count_distinct("account").alias("accounts")).where(F.col("accounts") >= least)
    return rows.join(shared, "digest").select("id", "handle", "accounts")


def near_keys(keys: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b, similarity) of (id, farm_key) that share ``similarity`` of the smaller one's trigrams, lengths within a factor of 2.

    Trigrams are put in one order, rarest first.  Of n trigrams of the smaller key ceil(s n) are shared, so at least one
    of its n - ceil(s n) + 1 rarest is: only those probe, and the other side offers only trigrams after which enough
    others follow.
    """
    hashed = F.transform(shingles(F.col("farm_key")), lambda g: F.xxhash64(g))
    rows = keys.select("id", hashed.alias("grams"), F.length("farm_key").alias("length")).withColumn("size", F.size("grams"))
    rows = kept(rows)
    each = rows.select("id", "size", "length", F.explode("grams").alias("gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram"))
    # A trigram that no other key has can't be met: it still takes one of the first places.
    alone = F.col("size") - F.count("*").over(Window.partitionBy("id"))
    each = each.join(df, "gram").withColumn("at", place + alone)
    probe = each.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    x, y = probe.alias("x"), each.alias("y")
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    alike = F.least("x.length", "y.length") * 2 >= F.greatest("x.length", "y.length")
    # Seen from their first common trigram, as many as are needed must still follow in the larger key too.
    room = F.col("y.size") - F.col("y.at") + 1 >= F.ceil(F.col("x.size") * similarity - 1e-9)
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & smaller & alike & room)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    left, right = (rows.select(F.col("id").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").withColumn("similarity", F.round(overlap(F.col("ga"), F.col("gb")), 6))
    return joined.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def near_pairs(posts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``near_keys`` of the distinct keys of posts, each by its first id."""
    return near_keys(keyed(posts).groupBy("farm_key").agg(F.min("id").alias("id")), similarity)


def leaders(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, leader) where each key joins the earliest leader it is near to, or leads itself: clusters in order of sight.

    ``keys`` has id, ``pairs`` a < b.  A key is settled once all earlier ones near to it are: it follows the first that
    leads, else it leads.  Rounds settle all such keys at once; each is two joins of what is still open.
    """
    pairs = kept(pairs.select("a", "b"))
    touched = pairs.select(F.col("b").alias("id")).distinct().withColumn("open", F.lit(True))
    state = kept(keys.select("id").join(touched, "id", "left").select("id", F.when(F.col("open").isNull(), F.col("id")).alias("leader")))
    while not state.where("leader is null").isEmpty():
        first = pairs.join(state.select(F.col("id").alias("a"), F.col("leader").alias("of_a")), "a").join(state.where("leader is null").select(F.col("id").alias("b")), "b")
        seen = first.groupBy("b").agg(F.min(F.when(F.col("of_a") == F.col("a"), F.col("a"))).alias("to"), F.min(F.when(F.col("of_a").isNull(), F.col("a"))).alias("wait"))
        # The first leader is known once nothing earlier than it is open.
        ready = seen.where("wait is null or to < wait").select(F.col("b").alias("id"), F.coalesce("to", "b").alias("new"))
        state = kept(state.join(ready, "id", "left").select("id", F.coalesce("leader", "new").alias("leader")))
    return state


def clusters(posts: DataFrame, similarity: float = SIMILARITY, samples: int = SAMPLES) -> DataFrame:
    """Clusters of near keys: leader, accounts, posts, and the first ``samples`` distinct keys seen."""
    rows = keyed(posts).select("id", "seq", "account", "farm_key")
    keys = rows.groupBy("farm_key").agg(F.min("seq").alias("id"))
    led = leaders(keys, near_keys(keys, similarity)).join(keys, "id")
    members = rows.join(led.select("farm_key", "leader"), "farm_key")
    sizes = members.groupBy("leader").agg(F.count_distinct("account").alias("accounts"), F.count("*").alias("posts"))
    rank = F.row_number().over(Window.partitionBy("leader").orderBy("id"))
    few = led.withColumn("rank", rank).where(F.col("rank") <= samples)
    shown = few.groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "farm_key"))), lambda x: x["farm_key"]).alias("samples"))
    return sizes.join(shown, "leader")


def near_retro_hits(posts: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_ACCOUNTS) -> DataFrame:
    """Posts whose key is near to one of the samples of a cluster with enough accounts: id and the cluster's accounts, the most of any."""
    rows = keyed(posts).select("id", "seq", "farm_key")
    keys = rows.groupBy("farm_key").agg(F.min("seq").alias("kid"))
    pairs = near_keys(keys.select(F.col("kid").alias("id"), "farm_key"), similarity)
    found = clusters(posts, similarity).where(F.col("accounts") >= least)
    sampled = found.select("accounts", F.explode("samples").alias("farm_key")).join(keys, "farm_key").select("kid", "accounts")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = both.join(sampled, both["a"] == sampled["kid"]).select(F.col("b").alias("kid"), "accounts")
    hit = sampled.union(near).groupBy("kid").agg(F.max("accounts").alias("accounts"))
    return rows.join(keys, "farm_key").join(hit, "kid").select("id", "accounts")
