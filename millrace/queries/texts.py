"""Queries over texts: normalizers, keys, rules, names, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import answers as A
from millrace.operators import menus, prescreen
from millrace.operators.keywords import contains_join
from millrace.operators.rules import LINK_ONLY, NEWS, RULES, STRONG
from millrace.plans.timeline import SCOPE
from millrace.queries.registered import FULL, KEYS, POSTS, dense, distinct, farm, grams, lines, plain, query, quoted
from millrace.schema import full_posts, pick, posts, spread, table


@query(f"SELECT doc_id, md5({plain('text')}) AS normal FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, md5({dense('text')}) AS dense FROM documents")
def dense_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.dense_text(F.col("text"))).alias("dense"))


@query(f"SELECT doc_id, md5({farm('text')}) AS compact, md5(regexp_replace(lower(text), '[^\\x{{3400}}-\\x{{9FFF}}a-z0-9]', '', 'g')) AS feeling FROM documents")
def compact_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.farm_text(F.col("text"))).alias("compact"), F.md5(T.feeling_text(F.col("text"))).alias("feeling"))


@query(f"WITH {POSTS}, {KEYS} SELECT id, farm_key FROM keyed")
def farm_keys(spark, d):
    return posts(spark, d).select("id", T.farm_key(F.col("text")).alias("farm_key")).where("farm_key is not null")


@query(f"SELECT doc_id, len(l) - len(list_distinct(l)) > 0 AS repeats FROM (SELECT doc_id, list_filter({lines('text')}, lambda x: length(x) >= 8) AS l FROM documents)")
def repeated_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", T.repeated_line(F.col("text")).alias("repeats"))


_FNV = (
    "printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(generate_series(1, length({0})), lambda i: ascii(substring({0}, i, 1))::BIGINT)), "
    "lambda h, u: (xor(h, u) * 16777619) & 4294967295))"
)


@query(f"SELECT DISTINCT source, {_FNV.format('source')} AS hash FROM documents")
def fnv_hash(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", T.fnv1a(F.col("source")).alias("hash"))


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'id:' || doc_id::VARCHAR ELSE 'h:' || {_FNV.format('x')} END AS entry, 'bk_' || {_FNV.format('s')} AS group_key "
    f"FROM (SELECT doc_id, source || '|' || lang AS x, {farm('source')} AS s FROM documents)"
)
def entry_keys(spark, d):
    i = F.col("doc_id")
    key = T.entry_key(F.when(i % 5 != 0, i), F.col("source"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", key.alias("entry"), T.group_key(T.farm_text(F.col("source")), i).alias("group_key"))


@query(f"WITH {POSTS} SELECT id, len({grams('t')}) AS grams FROM (SELECT id, {farm('text')} AS t FROM posts)")
def shingle_count(spark, d):
    return posts(spark, d).select("id", F.size(T.shingles(T.farm_text(F.col("text")))).cast("long").alias("grams"))


@query(
    "WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, text FROM documents) SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS cut, "
    "CASE WHEN flat = '' THEN '(empty)' WHEN length(flat) > 400 THEN left(flat, 399) || '…' ELSE flat END AS line, left(flat, 30) AS preview FROM b"
)
def text_previews(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.truncate(t, 60).alias("cut"), T.one_line(t).alias("line"), T.preview(t).alias("preview"))


@query(
    f"WITH f AS (SELECT conv_id, turn, {farm('text')} AS t, lag({farm('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), "
    f"g AS (SELECT *, len(list_intersect({grams('t')}, {grams('p')})) / least(len({grams('t')}), len({grams('p')})) AS o FROM f WHERE p IS NOT NULL) "
    "SELECT conv_id, turn, round(CASE WHEN t = '' OR p = '' THEN 0 WHEN t = p THEN 1 ELSE o END, 6) AS semantic, "
    "round(CASE WHEN t = p THEN 1 WHEN t = '' OR p = '' OR least(length(t), length(p)) * 2 < greatest(length(t), length(p)) THEN 0 ELSE o END, 6) AS farm FROM g"
)
def text_similarities(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.farm_text(F.col("text")).alias("t"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("p"))
    both = c.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(T.semantic_similarity(F.col("t"), F.col("p")), 6).alias("semantic"), F.round(T.farm_similarity(F.col("t"), F.col("p")), 6).alias("farm"))


#: Accounts' names by arithmetic: plain ones, random ones, and ones with separators.
_HANDLES = ("annlee", "xkcdqwrtpz", "mira_k", "brtzklmn", "q12345678z", "ostrava", "strength", "wqrtpsdf99", "a-b", "rhythms")
_ODD = (False, True, False, True, False, False, True, True, False, True)


@query(f"SELECT p_partkey, {quoted(_HANDLES)}[p_partkey % 10 + 1] || '' AS handle, {list(_ODD)}[p_partkey % 10 + 1] OR (p_name NOT SIMILAR TO '.*[\\s_\\-.].*' AND false) AS random_name FROM part")
def random_names(spark, d):
    handle = pick(_HANDLES, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", handle.alias("handle"), T.looks_random(handle, F.col("p_name")).alias("random_name"))


_LABELS = (
    ("Block @spam", "block"), ("“Unblock @spam”", None), ("Bloquear a @ann", "block"), ("Desbloquear a @ann", None), ("Silenciar", "mute"), ("屏蔽 @x", "block"), ("取消屏蔽 @x", None), ("ブロック", "block"),
    ("ミュートを解除", None), ("Stummschalten", "mute"), ("Don't block", None), ("Share post", None), ("차단", "block"), ("차단 해제", None), ("заблокировать", "block"), ("разблокировать", None), ("Masquer @x", "mute"),
    ("Share with commuters", None), ("Blockchain news", None), ("Dejar de bloquear a @ann", None), ("Wyłącz wyciszenie", None), ("음소거", "mute"), ("음소거 해제", None), ("Dempen", "mute"), ("Dempen opheffen", None), ("حظر", "block"), ("إلغاء الحظر", None), ("ปิดเสียง", "mute"), ("เลิกบล็อก", None), ("म्यूट करें", "mute"), ("अनम्यूट करें", None), ("Stummschaltung aufheben", None),
)


@query(f"SELECT c_custkey, {quoted(a for _, a in _LABELS)}[c_custkey % {len(_LABELS)} + 1] AS action, {quoted('x' if '@' in t and not t.strip('”').endswith('@x') else None for t, _ in _LABELS)}[c_custkey % {len(_LABELS)} + 1] IS NOT NULL AS another FROM customer")
def menu_actions(spark, d):
    text = pick(tuple(t for t, _ in _LABELS), F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", menus.menu_action(text).alias("action"), menus.names_another(text, F.lit("X")).alias("another"))


def _hits_sql(place: str, strong: bool) -> str:
    """Ids of the rules of one strength that a place's texts meet, in order."""
    tests = (f"CASE WHEN regexp_matches({place}_plain, '{r.pattern.replace(chr(39), chr(39) * 2)}') OR regexp_matches({place}_dense, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN '{r.id}' END" for r in RULES if (r.weight == STRONG) == strong)
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


_FLOORS = quoted(r.id for r in RULES if r.review_floor)
_SEXUAL = quoted(r.id for r in RULES if r.sexual)
_ODD_NAME = (
    "(NOT regexp_matches({0}, '[\\s_\\-.]') AND length(regexp_replace(lower({0}), '[^a-z]', '', 'g')) >= 5 AND length(regexp_replace({0}, '[^0-9]', '', 'g')) <= 6 AND "
    "(length(regexp_replace(lower({0}), '[^aeiouy]', '', 'g')) / greatest(length(regexp_replace(lower({0}), '[^a-z]', '', 'g')), 1) < 0.22 OR "
    "list_max(list_transform(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z]', '', 'g'), '[aeiouy]+'), lambda x: length(x))) >= 5))"
)
_PLACES = ("name", "body", "extra")
SCREEN = (
    f"{FULL}, p AS (SELECT *, coalesce(display_name, '') AS name, coalesce(text, '') AS body, trim(concat_ws(' ', coalesce(card_text, ''), coalesce(alt_text, ''))) AS extra FROM full_posts), "
    f"n AS (SELECT *, {', '.join(f'{plain(x)} AS {x}_plain, {dense(x)} AS {x}_dense' for x in _PLACES)} FROM p), "
    f"h AS (SELECT *, {', '.join(f'{_hits_sql(x, True)} AS {x}_strong, {_hits_sql(x, False)} AS {x}_weak' for x in _PLACES)}, regexp_matches(body_plain, '{NEWS}') AS news_context, "
    f"{_ODD_NAME.format('handle')} OR {_ODD_NAME.format('name')} AS random_name FROM n), "
    f"f AS (SELECT *, len(list_intersect(name_strong, {_SEXUAL})) > 0 AS strong_name_hit, len(list_intersect(name_strong || extra_strong || CASE WHEN news_context THEN [] ELSE body_strong END, {_FLOORS})) > 0 AS review_floor, "
    f"3 * len(name_strong || extra_strong) + len(body_strong) * CASE WHEN news_context THEN 1 ELSE 3 END + len(name_weak || body_weak || extra_weak) + random_name::INT AS rule_score, "
    f"has_media AND (length(body_plain) < 20 OR regexp_matches(body_plain, '{LINK_ONLY}')) AS shows, list_filter({quoted(SCOPE.keywords)}, lambda k: contains(lower(name_plain || ' ' || body_plain), k))[1] AS keyword FROM h), "
    "s AS (SELECT *, CASE WHEN is_own THEN 'own_tweet' WHEN handle = '' AND name_plain = '' AND body_plain = '' AND NOT has_media THEN 'no_author' "
    f"WHEN handle IN ({', '.join(repr(x) for x in SCOPE.handles)}) THEN 'whitelisted_handle' WHEN context = 'recommended' THEN 'scope_recommended_off' "
    f"WHEN length(body_plain) < {SCOPE.least_chars} AND NOT has_media AND NOT strong_name_hit AND NOT spam_section THEN 'too_short_no_media' WHEN keyword IS NOT NULL THEN 'whitelisted_keyword:' || keyword END AS skip FROM f), "
    "screened AS (SELECT id, handle, skip, CASE WHEN skip IS NULL THEN rule_score ELSE 0 END::INT AS score, skip IS NULL AND (rule_score >= 2 OR len(name_strong || body_strong || extra_strong) > 0) AS candidate, "
    "skip IS NULL AND shows AS short_with_media, strong_name_hit, review_floor, spam_section, has_media, news_context, random_name, name_strong || body_strong || extra_strong || name_weak || body_weak || extra_weak || CASE WHEN random_name THEN ['random_name'] ELSE [] END AS ids, "
    "name_strong || name_weak AS name_ids, name_strong || body_strong || extra_strong || name_weak || body_weak || extra_weak AS found, shows FROM s)"
)


@query(f"WITH {SCREEN} SELECT rule, count(*) AS hits FROM (SELECT unnest(found) AS rule FROM screened) GROUP BY rule")
def rule_hits(spark, d):
    """How often each rule hits, in any place of any post; a small test names the rule that each phrase is meant for."""
    hit = prescreen.prescreen(full_posts(spark, d), SCOPE).select(F.explode("found").alias("h"))
    return hit.groupBy(F.col("h.id").alias("rule")).agg(F.count("*").alias("hits"))


@query(
    f"WITH {SCREEN} SELECT id, skip, score, candidate, short_with_media, strong_name_hit, review_floor, news_context, random_name, array_to_string({distinct('name_ids')}, ',') AS name_reasons, "
    f"CASE WHEN skip IS NULL THEN array_to_string({distinct('ids')} || CASE WHEN shows THEN ['short_text_with_media'] ELSE [] END || CASE WHEN has_media AND NOT candidate THEN ['has_media_weak_text'] ELSE [] END, ',') ELSE '' END AS reasons FROM screened"
)
def prescreen_scores(spark, d):
    out = prescreen.prescreen(full_posts(spark, d), SCOPE)
    flags = ("short_with_media", "strong_name_hit", "review_floor", "news_context", "random_name")
    return out.select("id", "skip", "score", "candidate", *flags, F.array_join("name_reasons", ",").alias("name_reasons"), F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SCREEN} SELECT coalesce(skip, 'none') AS skip, count(*) AS posts FROM screened GROUP BY ALL")
def prescreen_skips(spark, d):
    return prescreen.prescreen(full_posts(spark, d), SCOPE).groupBy(F.coalesce("skip", F.lit("none")).alias("skip")).agg(F.count("*").alias("posts"))


@query(
    f"WITH {FULL}, s AS (SELECT id, concat_ws(chr(10), 'POST TEXT:', CASE WHEN trim(text) = '' THEN '(no text)' ELSE trim(text) END, '', 'AUTHOR:', 'handle=@' || CASE WHEN handle = '' THEN 'unknown' ELSE handle END, "
    "CASE WHEN display_name <> '' THEN 'display_name=' || display_name END, '', 'CONTEXT:', 'platform=x.com; position=' || context || '; has_media=' || CASE WHEN media_count > 0 THEN 'yes' ELSE 'no' END || '; media_count=' || media_count::VARCHAR, "
    "'media_alt_text=' || alt_text, 'link_card_text=' || card_text, 'quoted_post_text=' || quoted_text, 'declared_language=' || lang) AS state FROM full_posts) "
    f"SELECT id, CASE WHEN length(state) > {A.STATE_CHARS} THEN left(state, {A.STATE_CHARS - 1}) || '…' ELSE state END AS state FROM s"
)
def state_render(spark, d):
    rows = full_posts(spark, d)
    return rows.select("id", A.state_text(rows).alias("state"))


@query("SELECT d.doc_id, min(k.item_id) AS item_id FROM documents d JOIN (SELECT item_id, lower(left(text, 30)) AS k FROM benchmark) k ON contains(lower(d.text), k.k) GROUP BY d.doc_id")
def keyword_theta_join(spark, d):
    """The first keyword (the beginning of a benchmark item) that each document holds."""
    docs, words = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark")
    return contains_join(docs.select("doc_id", F.lower("text").alias("t")), words.select(F.lower(F.left("text", F.lit(30))).alias("k"), "item_id"))
