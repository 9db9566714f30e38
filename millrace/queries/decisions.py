"""Queries over decisions: the gate, actions, reports, routing and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import answers as A
from millrace.operators import folds, gate, report, routing
from millrace.plans.timeline import SETTINGS, decisions
from millrace.queries.registered import ANSWERS, KEYS, POSTS, SHARED, query
from millrace.queries.texts import SCREEN
from millrace.schema import answers, pick, posts, table
from millrace.settings import CATEGORIES

_OFF = ", ".join(f"'{c}'" for c, (g, _, _) in CATEGORIES.items() if g is None or not SETTINGS.on(g))
_HIDEABLE = ", ".join(f"'{c}'" for c, (_, h, _) in CATEGORIES.items() if h)
_ELIGIBLE = ", ".join(f"'{c}'" for c, (_, _, e) in CATEGORIES.items() if e)
#: The decision table in SQL over a relation ``z`` of answers and signals.
_GATE = (
    f"e AS (SELECT *, category NOT IN ({_OFF}) AS on_, category IN ({_HIDEABLE}) AS hide_, category IN ({_ELIGIBLE}) AS act_, adult >= 0.8 AND solicitation >= 0.8 AND confidence >= 0.95 AS dual FROM z), "
    "w AS (SELECT *, CASE WHEN on_ AND act_ AND confidence >= 0.7 AND severity >= 2 AND (adult >= 0.9 OR deceptive >= 0.85 OR (solicitation >= 0.9 AND severity >= 2.5) OR dual) THEN 1 WHEN farm_hit AND accounts >= 3 THEN 2 "
    "WHEN farm_hit AND (adult >= 0.4 OR deceptive >= 0.4 OR solicitation >= 0.6 OR score >= 1 OR coalesce(junk >= 0.4, false)) THEN 3 WHEN media_blocked AND (adult >= 0.5 OR score >= 2) THEN 4 WHEN media_suspicious AND solicitation >= 0.8 THEN 5 "
    "WHEN coalesce(vision_adult >= 0.9 AND vision_confidence >= 0.7, false) THEN 6 WHEN adult >= 0.9 AND confidence >= 0.5 THEN 7 WHEN on_ AND hide_ AND (confidence >= 0.45 OR severity >= 2) THEN 8 WHEN on_ AND hide_ AND adult >= 0.9 THEN 9 "
    "WHEN on_ AND hide_ AND confidence >= 0.3 THEN 10 WHEN review_floor THEN 11 WHEN spam_section THEN 12 WHEN strong_name_hit THEN 13 WHEN coalesce(junk >= 0.65, false) THEN 14 WHEN media_blocked AND short_with_media THEN 15 "
    "WHEN media_suspicious AND score >= 2 THEN 16 WHEN adult >= 0.5 THEN 17 WHEN degraded IS NOT NULL THEN 18 WHEN NOT on_ AND hide_ AND confidence >= 0.45 THEN 19 ELSE 20 END AS branch FROM e), "
    "v AS (SELECT *, ['block', 'hide', 'hide', 'hide', 'hide', 'hide', 'hide', 'hide', 'hide', 'review', 'review', 'review', 'review', 'review', 'review', 'review', 'review', CASE WHEN score >= 2 THEN 'review' ELSE 'ignore' END, 'ignore', 'ignore'][branch] AS band, "
    "list_filter(CASE branch WHEN 1 THEN ['category:' || category, CASE WHEN adult >= 0.9 THEN 'adult_high' END, CASE WHEN deceptive >= 0.85 THEN 'deceptive_high' END, CASE WHEN solicitation >= 0.9 AND severity >= 2.5 THEN 'solicitation_high' END, "
    "CASE WHEN dual THEN 'dual_confirmation_block' END, CASE WHEN score >= 3 THEN 'prefilter_strong' END] WHEN 2 THEN ['farm_repeat', CASE WHEN score >= 1 THEN 'prefilter_weak' END] WHEN 3 THEN ['farm_repeat', CASE WHEN score >= 1 THEN 'prefilter_weak' END] "
    "WHEN 4 THEN ['media_skin_dominant', CASE WHEN score >= 2 THEN 'prefilter_weak' END] WHEN 5 THEN ['media_skin_suspicious', 'off_platform_solicitation'] WHEN 6 THEN ['vision_model_adult'] WHEN 7 THEN ['category:' || category, 'adult_probability_high'] "
    "WHEN 8 THEN ['category:' || category, 'category_confident', CASE WHEN score >= 3 THEN 'prefilter_strong' END] WHEN 9 THEN ['category:' || category, 'adult_probability_high'] WHEN 10 THEN ['category:' || category, 'low_confidence_review'] "
    "WHEN 11 THEN ['solicit_template', CASE WHEN score >= 3 THEN 'prefilter_strong' END] WHEN 12 THEN ['x_spam_section'] WHEN 13 THEN ['profile_solicitation', CASE WHEN score >= 3 THEN 'prefilter_strong' END] WHEN 14 THEN ['junk_probe'] "
    "WHEN 15 THEN ['media_skin_dominant', 'too_short_with_media'] WHEN 16 THEN ['media_skin_suspicious', 'prefilter_weak'] WHEN 17 THEN ['low_confidence_review'] WHEN 18 THEN [degraded] WHEN 19 THEN ['category_disabled'] ELSE [] END "
    "|| [degraded, CASE WHEN media_blocked THEN 'skin_ratio_blocked' WHEN media_suspicious THEN 'skin_ratio_suspicious' END], lambda x: x IS NOT NULL) AS r FROM w), "
    "b AS (SELECT *, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS reasons FROM v)"
)
_GRID = (
    f"WITH z AS (SELECT id, handle, {ANSWERS}, id % 5 AS score, id % 23 = 0 AS farm_hit, CASE WHEN id % 23 = 0 THEN 2 + id // 23 % 2 ELSE 0 END AS accounts, id % 2 = 0 AS short_with_media, id % 43 = 0 AS strong_name_hit, "
    f"id % 47 = 0 AS review_floor, id % 37 = 0 AS spam_section, 3 - id % 8 AS budget FROM (SELECT doc_id AS id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END AS handle FROM documents)), {_GATE} "
)
_BANDS = (
    f"WITH {POSTS}, {KEYS}, {SHARED}, {SCREEN}, c AS (SELECT id, accounts FROM keyed JOIN shared USING (farm_key)), "
    f"z AS (SELECT s.*, coalesce(c.accounts, 0) AS accounts, c.accounts IS NOT NULL AS farm_hit, {ANSWERS.replace('id *', 's.id *').replace('id %', 's.id %').replace('id //', 's.id //')} FROM screened s LEFT JOIN c ON c.id = s.id WHERE skip IS NULL), {_GATE} "
)


def _grid(spark, d):
    i = F.col("id")
    handle = F.when(i % 29 == 0, "").otherwise(F.col("handle"))
    signals = {
        "score": i % 5, "farm_hit": i % 23 == 0, "accounts": F.when(i % 23 == 0, 2 + F.floor(i / 23) % 2).otherwise(0), "short_with_media": i % 2 == 0, "strong_name_hit": i % 43 == 0, "review_floor": i % 47 == 0,
        "spam_section": i % 37 == 0, "budget": 3 - i % 8,
    }
    return gate.decide(answers(posts(spark, d).select("id", handle.alias("handle"))).withColumns(signals), SETTINGS)


@query(_GRID + "SELECT id, branch, band, reasons FROM b")
def gate_grid(spark, d):
    """The decision table over a grid of answers and signals by arithmetic, which reaches every branch."""
    return _grid(spark, d).select("id", "branch", "band", F.array_join("reasons", ",").alias("reasons"))


@query(_BANDS + "SELECT id, band, reasons FROM b")
def gate_bands(spark, d):
    return decisions(spark, d).select("id", "band", F.array_join("reasons", ",").alias("reasons"))


@query(_BANDS + "SELECT band, category, count(*) AS posts FROM b GROUP BY GROUPING SETS ((band), (category), (band, category), ())")
def band_stats(spark, d):
    made = decisions(spark, d).select("band", "category")
    return made.groupingSets([["band"], ["category"], ["band", "category"], []], "band", "category").agg(F.count("*").alias("posts"))


_PLAN = (
    "p AS (SELECT *, CASE band WHEN 'hide' THEN 'mute' WHEN 'block' THEN 'block' ELSE 'none' END AS kind, CASE WHEN band NOT IN ('hide', 'block') THEN 'band_below_block' WHEN handle = '' THEN 'unknown_handle' "
    "WHEN budget <= 0 THEN 'budget_exhausted' ELSE 'armed' END AS reason FROM b)"
)


@query(_GRID + f", {_PLAN} SELECT id, kind, reason = 'armed' AS execute, reason FROM p")
def action_plan(spark, d):
    return gate.plan_action(_grid(spark, d), SETTINGS).select("id", "kind", "execute", "reason")


@query(_GRID + f", {_PLAN} SELECT handle, kind, min(id) AS id FROM p WHERE reason = 'armed' GROUP BY handle, kind")
def first_actions(spark, d):
    return gate.first_actions(gate.plan_action(_grid(spark, d), SETTINGS))


@query(_BANDS + "SELECT band, quality, toxic, count(*) AS docs FROM b JOIN labels ON labels.doc_id = b.id GROUP BY band, quality, toxic")
def label_eval(spark, d):
    labels = table(spark, d, "labels")
    made = decisions(spark, d)
    return made.join(labels, made["id"] == labels["doc_id"]).groupBy("band", "quality", "toxic").agg(F.count("*").alias("docs"))


_REASON_NAMES = ", ".join(f"'{k}': '{v}'" for k, v in report.REASON_LABELS.items())
_CATEGORY_NAMES = ", ".join(f"'category:{k}': '{v}'" for k, v in report.CATEGORY_LABELS.items())


@query(_GRID + f"SELECT id, array_to_string(list_transform(list_filter(r, lambda x, i: list_position(r, x) = i), lambda x: coalesce(MAP {{{_REASON_NAMES}, {_CATEGORY_NAMES}}}[x], x)), '; ') AS labels FROM b")
def reason_labels(spark, d):
    return _grid(spark, d).select("id", F.array_join(report.labelled(F.col("reasons")), "; ").alias("labels"))


@query(
    _GRID + "SELECT handle, count(*) AS decisions, count(*) FILTER (band = 'block') AS n_block, count(*) FILTER (band = 'hide') AS n_hide, count(*) FILTER (band = 'review') AS n_review, count(*) FILTER (band = 'ignore') AS n_ignore, "
    "count(*) FILTER (id % 6 = 0) AS skips, sum(id % 50)::BIGINT AS latency_sum, avg(id % 50) AS latency_mean FROM b GROUP BY handle"
)
def decision_counters(spark, d):
    i = F.col("id")
    return report.counters(_grid(spark, d).withColumns({"latency_ms": i % 50, "skip": F.when(i % 6 == 0, "own_tweet")}), "handle")


_STATES = (
    "t AS (SELECT *, CASE WHEN band IN ('hide', 'block') THEN 'hidden' WHEN id % 7 = 0 THEN 'alpha' WHEN id % 3 = 0 AND NOT id % 2 = 0 THEN 'emotion' WHEN id % 2 = 0 THEN 'beta_folded' ELSE 'plain' END AS display_state FROM b)"
)


def _states(spark, d):
    i = F.col("id")
    return _grid(spark, d).withColumn("display_state", folds.display_state(F.col("band"), i % 7 == 0, F.when(i % 3 == 0, "joy"), i % 2 == 0))


@query(_GRID + f", {_STATES} SELECT id, display_state FROM t")
def display_states(spark, d):
    return _states(spark, d).select("id", "display_state")


@query(_GRID + f", {_STATES} SELECT handle, count(*) AS posts, count(*) FILTER (display_state = 'hidden') AS hidden, count(*) FILTER (display_state = 'beta_folded') AS folded, count(*) FILTER (display_state = 'alpha') AS alpha, least(count(*) FILTER (display_state = 'hidden'), 999) AS badge FROM t GROUP BY handle")
def page_summary(spark, d):
    return report.summary(_states(spark, d)).withColumn("badge", report.badge(F.col("hidden")))


@query(
    _GRID + "SELECT g.id AS seq, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * g.id, '%Y-%m-%dT%H:%M:%SZ') AS iso, g.handle, left(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 160) AS preview, band, category, reasons FROM b g JOIN documents d ON d.doc_id = g.id ORDER BY seq DESC LIMIT 500"
)
def audit_log(spark, d):
    """The events that the audit log keeps: its latest 500."""
    full = posts(spark, d).select("id", "text", "context", "seq", "ts")
    events = report.audit_events(_grid(spark, d).join(full, "id"))
    kept = report.retained([events], "seq")
    return kept.select("seq", "iso", "post.handle", F.col("post.text_preview").alias("preview"), "decision.band", "decision.category", F.array_join("decision.reasons", ",").alias("reasons"))


@query(_GRID + "SELECT handle, id, band, row_number() OVER (PARTITION BY handle ORDER BY id DESC) AS rank FROM b QUALIFY rank <= 40")
def recent_decisions(spark, d):
    return report.recent(_grid(spark, d).select("handle", "id", "band"), "handle", "id")


@query("SELECT band, sum(decisions)::BIGINT AS decisions FROM (SELECT ['ignore', 'hide'][event_id % 2 + 1] AS band, ts::DATE AS day, count(*) AS decisions FROM events GROUP BY ALL) GROUP BY band")
def added_counters(spark, d):
    """Counters of daily flushes, added up."""
    e = table(spark, d, "events").select(pick(("ignore", "hide"), F.col("event_id")).alias("band"), F.to_date("ts").cast("string").alias("day"))
    return report.added_up(e.groupBy("band", "day").agg(F.count("*").alias("decisions")).drop("day"), "band")


_REPLY = (
    "'{\"adult\":{\"noul\":' || (id % 13 / 10.0)::DECIMAL(4,1)::VARCHAR || '},' || CASE WHEN id % 5 = 0 THEN '' ELSE '\"solicitation\":{\"noul\":0.5},' END || '\"category\":{\"choice\":\"' || "
    "['scam', 'nonsense', 'ordinary'][id % 3 + 1] || '\",\"confidence\":0.25},\"severity\":{\"score\":1.5}' || CASE WHEN id % 7 = 0 THEN ',\"junk\":{\"noul\":2}' ELSE '' END || '}'"
)


@query(
    f"WITH a AS (SELECT doc_id AS id FROM documents) SELECT id, CASE WHEN id % 11 = 0 THEN 0 ELSE least(id % 13 / 10.0::DOUBLE, 1) END AS adult, CASE WHEN id % 11 = 0 OR id % 5 = 0 THEN 0 ELSE 0.5::DOUBLE END AS solicitation, 0::DOUBLE AS deceptive, "
    "CASE WHEN id % 11 = 0 THEN 0 ELSE 1.5::DOUBLE END AS severity, CASE WHEN id % 11 = 0 THEN 0 ELSE 0.25::DOUBLE END AS confidence, CASE WHEN id % 11 = 0 THEN 'other' ELSE ['scam', 'other', 'ordinary'][id % 3 + 1] END AS category, "
    "CASE WHEN id % 11 <> 0 AND id % 7 = 0 THEN 1::DOUBLE END AS junk, id % 11 <> 0 AND id % 5 <> 0 AS complete FROM a"
)
def answer_parse(spark, d):
    """Replies of the model as JSON, some incomplete, some no JSON at all, as scores."""
    i = F.col("id")
    some = F.concat(
        F.lit('{"adult":{"noul":'), (i % 13 / 10.0).cast("decimal(4,1)").cast("string"), F.lit("},"), F.when(i % 5 == 0, "").otherwise('"solicitation":{"noul":0.5},'), F.lit('"category":{"choice":"'),
        pick(("scam", "nonsense", "ordinary"), i), F.lit('","confidence":0.25},"severity":{"score":1.5}'), F.when(i % 7 == 0, ',"junk":{"noul":2}').otherwise(""), F.lit("}"),
    )
    rows = posts(spark, d).select("id", F.when(i % 11 == 0, "sorry, no").otherwise(some).alias("reply"))
    return A.read_answers(rows).drop("reply")


def _scored(spark, d):
    i = F.col("id")
    flags = {"candidate": i % 3 == 0, "media_suspicious": i % 17 == 0, "vision_ok": i % 19 == 0, "farm_hit": i % 23 == 0, "repeats": i % 29 == 0, "model_budget": i % 7 != 0, "triage_budget": i % 5 != 0, "draw": (i * 41 % 101) / 101.0}
    return posts(spark, d).select("id").withColumns(flags)


_ROUTED = (
    f"WITH i AS (SELECT doc_id AS id FROM documents), a AS (SELECT id, {ANSWERS} FROM i), r AS (SELECT id, CASE WHEN (id % 3 = 0 OR id % 17 = 0 OR id % 19 = 0) AND id % 7 <> 0 THEN 'full' WHEN id % 3 = 0 OR id % 17 = 0 OR id % 19 = 0 THEN 'budget_exhausted' "
    "WHEN id % 23 <> 0 AND id % 29 <> 0 AND id * 41 % 101 / 101.0::DOUBLE >= 0.25 THEN 'not_sampled' WHEN id % 5 = 0 THEN 'triage_budget_exhausted' ELSE 'probe' END AS route FROM i), "
    "p AS (SELECT r.id, route, CASE WHEN route = 'probe' AND r.id % 31 <> 0 THEN junk END AS junk, route = 'probe' AND r.id % 31 = 0 AS lost, adult, severity, category FROM r JOIN a ON a.id = r.id), "
    "e AS (SELECT *, route = 'probe' AND coalesce(junk >= 0.75, false) AND id % 7 <> 0 AS escalated FROM p), c AS (SELECT *, route = 'full' OR escalated AS called FROM e), "
    "v AS (SELECT *, called AND id % 13 <> 0 AND id % 11 <> 0 AS valid FROM c) SELECT id, route, escalated, CASE WHEN valid THEN adult ELSE 0 END AS adult, CASE WHEN valid THEN severity ELSE 0 END AS severity, CASE WHEN valid THEN category ELSE 'other' END AS category, junk, "
    "CASE WHEN valid THEN 'model' WHEN junk IS NOT NULL THEN 'probe' END AS source, CASE WHEN route = 'budget_exhausted' THEN 'budget_exhausted' WHEN (called AND id % 13 = 0) OR lost THEN 'model_error' WHEN called AND NOT valid THEN 'schema_invalid' END AS degraded, "
    "CASE WHEN route IN ('not_sampled', 'triage_budget_exhausted') THEN route WHEN route = 'probe' AND (lost OR (escalated AND id % 13 = 0)) THEN 'probe_failed' WHEN route = 'probe' AND junk IS NULL THEN 'probe_answer_invalid' END AS note FROM v"
)


@query(_ROUTED)
def model_routing(spark, d):
    """Calls for ids divisible by 13 (full) and 31 (probe) fail; answers of ids divisible by 11 lack a required one."""
    given = answers(posts(spark, d).select("id")).drop("degraded")
    full = given.where("id % 13 <> 0").withColumn("adult", F.when(F.col("id") % 11 != 0, F.col("adult")))
    made = routing.evaluate(routing.route(_scored(spark, d)), full, given.where("id % 31 <> 0"))
    return made.drop("solicitation", "deceptive", "confidence")
