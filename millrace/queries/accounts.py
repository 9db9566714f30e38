"""Queries over campaigns, accounts, rates and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import farm, live, rates, registry, routing
from millrace.operators.cut import kept
from millrace.queries.registered import KEYS, POSTS, SHARED, grams, query
from millrace.schema import pick, posts, table


@query(f"WITH {POSTS}, {KEYS}, {SHARED} SELECT farm_key, accounts, posts, first_seq FROM shared")
def farm_exact_accounts(spark, d):
    return farm.exact_accounts(posts(spark, d))


@query(f"WITH {POSTS}, {KEYS} SELECT id, farm_key, sum(fresh) OVER (PARTITION BY farm_key ORDER BY seq)::BIGINT AS accounts FROM (SELECT *, (row_number() OVER (PARTITION BY farm_key, handle ORDER BY seq) = 1)::INT AS fresh FROM keyed)")
def farm_running_accounts(spark, d):
    return farm.running_accounts(posts(spark, d))


@query(f"WITH {POSTS}, {KEYS}, {SHARED} SELECT id, handle, accounts FROM keyed JOIN shared USING (farm_key)")
def farm_retro_hide(spark, d):
    return farm.retro_hits(posts(spark, d))


_LIFE = "1800000000"
_RUNS = (
    f"t AS (SELECT id, farm_key, 1704067200000000 + id * 60000000 AS due FROM keyed), f AS (SELECT *, CASE WHEN due - lag(due) OVER (PARTITION BY farm_key ORDER BY due) < {_LIFE} THEN 0 ELSE 1 END AS fresh FROM t), "
    "u AS (SELECT *, sum(fresh) OVER (PARTITION BY farm_key ORDER BY due) AS run FROM f), "
    f"r AS (SELECT farm_key, min(id) AS rid, min(due) AS lo, max(due) + {_LIFE} AS hi, length(farm_key) AS n, {grams('farm_key')} AS g FROM u GROUP BY farm_key, run)"
)


@query(
    f"WITH {POSTS}, {KEYS}, {_RUNS}, p AS (SELECT x.rid AS a, y.rid AS b, len(list_intersect(x.g, y.g)) / least(len(x.g), len(y.g)) AS s FROM r x JOIN r y "
    "ON y.lo >= x.lo AND y.lo < x.hi AND x.rid < y.rid AND x.farm_key <> y.farm_key AND 2 * least(x.n, y.n) >= greatest(x.n, y.n)) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.8"
)
def farm_near_pairs(spark, d):
    """Near texts that meet: the second begins while the first may still be joined.  Copies of a text in a row are one run."""
    return live.near_runs(kept(live.keyed(posts(spark, d))))


def _campaigns(spark, d):
    rows = kept(live.keyed(posts(spark, d)))
    return rows, live.clusters(live.accounts_of(rows, live.memberships(rows)))


@query()
def farm_clusters(spark, d):
    """Clusters led by the earliest near text alive, with their accounts and samples; a fold, so held against one in the tests."""
    found = _campaigns(spark, d)[1]
    return found.select("leader", "accounts", "posts", F.size("samples").alias("samples"), F.col("hit_at").isNotNull().alias("hit"))


@query()
def farm_near_retro_hide(spark, d):
    """Posts that a campaign hides after the fact; rests on the fold of ``farm_clusters``."""
    return live.retro_hits(*_campaigns(spark, d)).withColumnRenamed("seq", "id")


@query(
    "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) "
    "SELECT event_type, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events, count(DISTINCT user_id) AS accounts FROM s GROUP BY event_type, session"
)
def farm_sessions(spark, d):
    return farm.sessions(table(spark, d, "events"), "event_type", "user_id", "ts")


_SIGHT = (
    "SELECT user_id::VARCHAR AS handle, ts, ['ignore', 'review', 'hide', 'block'][event_id % 4 + 1] AS band, event_id % 4 AS r, (event_id * 37 % 101) / 100.0::DOUBLE AS adult, (event_id * 29 % 101) / 100.0::DOUBLE AS confidence, "
    "CASE WHEN event_id % 3 <> 0 THEN ['scam', 'adult_porn', 'other'][event_id % 3 + 1] END AS category, event_type AS reason, event_id AS post_id, ['live', 'import'][event_id // 5 % 2 + 1] AS source FROM events"
)


def _sightings(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("handle"), "ts", pick(registry.BANDS, i).alias("band"), ((i * 37 % 101) / 100.0).alias("adult"), ((i * 29 % 101) / 100.0).alias("confidence"),
        F.when(i % 3 != 0, pick(("scam", "adult_porn", "other"), i)).alias("category"), F.col("event_type").alias("reason"), i.alias("post_id"), pick(("live", "import"), F.floor(i / 5)).alias("source"),
    )


_MERGED = (
    "SELECT handle, count(*) AS hits, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(band, r) AS best_band, max(adult) AS best_adult, "
    f"arg_max(category, (ts, category)) FILTER (category IS NOT NULL) AS best_category, max(confidence) AS best_confidence FROM ({_SIGHT}) GROUP BY handle"
)


@query(_MERGED)
def registry_merge(spark, d):
    return registry.merge(_sightings(spark, d))


_NEW = "post_id % 2 = 0"


@query(
    f"WITH s AS (SELECT *, {_NEW} AS new FROM ({_SIGHT})), m AS ({_MERGED}), "
    "f AS (SELECT handle, min(new::INT)::BOOLEAN AS added, arg_min(source, (new, ts, source)) AS source FROM s GROUP BY handle), "
    "a AS (SELECT handle, reason, min(ts) AS ts FROM s GROUP BY ALL), ar AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY ts, reason) AS n FROM a), "
    "r AS (SELECT handle, string_agg(reason, ',' ORDER BY ts, reason) AS reasons FROM ar WHERE n <= 8 GROUP BY handle), "
    "p AS (SELECT handle, ts, post_id, row_number() OVER (PARTITION BY handle ORDER BY ts DESC, post_id DESC) AS n FROM s), "
    "q AS (SELECT handle, string_agg(post_id::VARCHAR, ',' ORDER BY ts, post_id) AS post_ids FROM p WHERE n <= 10 GROUP BY handle) "
    "SELECT m.*, added, source, reasons, post_ids FROM m JOIN f USING (handle) LEFT JOIN r USING (handle) LEFT JOIN q USING (handle)"
)
def registry_merge_entries(spark, d):
    """Sightings of odd posts are the registry's, of even ones come in: all fields of the accounts afterwards."""
    seen = _sightings(spark, d)
    out = registry.merge_entries(seen.where("post_id % 2 <> 0"), seen.where(_NEW))
    ids = F.array_join(F.transform("post_ids", lambda x: x.cast("string")), ",")
    return out.withColumn("reasons", F.array_join("reasons", ",")).withColumn("post_ids", ids)


@query(f"SELECT best_band, count(*) AS accounts, sum(hits)::BIGINT AS hits FROM ({_MERGED}) GROUP BY best_band")
def registry_stats(spark, d):
    return registry.statistics(registry.merge(_sightings(spark, d)))


@query(f"SELECT source, count(*) AS accounts FROM (SELECT DISTINCT handle, source FROM ({_SIGHT})) GROUP BY ROLLUP (source)")
def registry_sources(spark, d):
    return registry.by_source(_sightings(spark, d).select("handle", "source").distinct())


@query(f"SELECT handle, last_seen, hits FROM ({_MERGED}) ORDER BY last_seen DESC, handle LIMIT 200")
def top_offenders(spark, d):
    return registry.merge(_sightings(spark, d)).orderBy(F.desc("last_seen"), "handle").limit(200).select("handle", "last_seen", "hits")


@query(
    f"WITH s AS (SELECT user_id::VARCHAR AS handle, event_type, min(ts) AS ts FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY ts, event_type) AS rank FROM s) "
    "SELECT handle, string_agg(event_type, ',' ORDER BY ts, event_type) AS reasons FROM r WHERE rank <= 8 GROUP BY handle"
)
def registry_reasons(spark, d):
    seen = _sightings(spark, d).withColumnRenamed("reason", "event_type")
    return registry.evidence(seen, "event_type", 8).select("handle", F.array_join("event_type", ",").alias("reasons"))


#: Import texts, one for each shape, with a number in them; what is no handle counts as invalid.
_SHAPES = ('["@User{0}", "bad-handle"]', '{{"entries": [{{"handle": "https://x.com/User{0}/status/1"}}]}}', '{{"handle": "User{0}"}}', '{{"user{0}": {{"hits": 2}}}}', "# list\n@user{0} some remark\nx.com/user{0}?ref=1")


@query(
    "WITH k AS (SELECT c_custkey AS k, 'user' || (c_custkey % 997)::VARCHAR AS handle FROM customer) "
    "SELECT k AS c_custkey, handle, CASE WHEN k % 5 = 4 THEN 2 ELSE 1 END::BIGINT AS valid, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS invalid FROM k"
)
def registry_import(spark, d):
    """Lists in every shape, one a customer: the handle that each names, and how many entries are and aren't valid."""
    k = F.col("c_custkey")
    shape = pick(tuple(s.replace("{0}", "\x01").replace("{{", "{").replace("}}", "}") for s in _SHAPES), k)
    texts = table(spark, d, "customer").select("c_custkey", F.replace(shape, F.lit("\x01"), (k % 997).cast("string")).alias("text"))
    named = registry.named_entries(texts.select("text").distinct())
    counted = named.groupBy("text").agg(F.max(F.when(F.col("valid"), F.col("handle"))).alias("handle"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    return texts.join(counted, "text").drop("text")


@query(f"SELECT handle, '{{\"handle\":\"' || handle || '\",\"hits\":' || hits::VARCHAR || ',\"best_band\":\"' || best_band || '\"}}' AS entry FROM ({_MERGED})")
def registry_export(spark, d):
    return registry.export_entries(registry.merge(_sightings(spark, d)).select("handle", "hits", "best_band"))


@query("SELECT DISTINCT handle FROM (SELECT lower(source) AS handle FROM documents WHERE doc_id % 3 = 0 UNION SELECT 'user' || (c_custkey % 50)::VARCHAR FROM customer)")
def whitelist_union(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("@"), "source").alias("handle"))
    users = table(spark, d, "customer").select(F.concat(F.lit("https://x.com/USER"), (F.col("c_custkey") % 50).cast("string")).alias("handle"))
    return registry.united([docs, users])


@query(f"SELECT handle, hits FROM ({_MERGED}) WHERE handle NOT IN (SELECT (c_custkey % 40)::VARCHAR FROM customer)")
def registry_remove(spark, d):
    gone = table(spark, d, "customer").select(F.concat(F.lit("@"), (F.col("c_custkey") % 40).cast("string")).alias("handle"))
    return registry.remove(registry.merge(_sightings(spark, d)).select("handle", "hits"), gone)


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source AS s FROM documents WHERE doc_id % 7 = 0 AND source < 'src15') w WHERE w.s = d.source)")
def whitelist_anti_join(spark, d):
    docs = table(spark, d, "documents")
    listed = docs.where("doc_id % 7 = 0 and source < 'src15'").select("source").distinct()
    return docs.join(listed, "source", "left_anti").select("doc_id", "source")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_counts(spark, d):
    return rates.sliding_counts(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "in_window")


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_counters(spark, d):
    return rates.day_counts(table(spark, d, "events"), "event_type", "ts").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS so_far FROM events")
def running_daily_counters(spark, d):
    return rates.running_day_counts(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "so_far")


@query()
def budget_admission(spark, d):
    """At most 2 admitted events per user and day-long window; recursive, so held against a fold in the tests."""
    return rates.admit(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 24 * 3600)


@query()
def call_budgets(spark, d):
    """Which calls of four kinds the limits admit together, for each user; recursive, so held against a fold in the tests."""
    calls = table(spark, d, "events").withColumn("call", pick(("model", "triage", "semantics", "media", "action"), F.col("event_id")))
    small = {k: rates.Limit(max(1, v.most // 20), v.seconds if v.seconds is None else v.seconds * 60) for k, v in rates.LIMITS.items()}
    return rates.admit_calls(calls, "user_id", "ts", "event_id", "call", small)


@query()
def decision_cache(spark, d):
    """Requests that a cache of 2,000 decisions in 32 shards answers, the settings changing every third day; held against a fold in the tests."""
    events = table(spark, d, "events")
    settings = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (3 * 86_400_000_000))
    return routing.cached(events, F.col("user_id"), "ts", "event_id", most=routing.CACHE_ENTRIES // 32, fingerprint=settings, scope=F.pmod(F.col("user_id"), F.lit(32)))


@query("SELECT event_type, count(*) AS calls, sum(k)::BIGINT AS tokens FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type")
def token_accounting(spark, d):
    parsed = table(spark, d, "events").select("event_type", F.from_json("props", "struct<k:bigint>").getField("k").alias("k"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")
