"""The table of queries, and the pieces of SQL that several of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.schema import NAMES, PHRASES, SAID, SHORTS
from millrace.settings import CATEGORIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def picked(values, n: str) -> str:
    return f"{quoted(values)}[({n}) % {len(values)} + 1]"


LETTERS = r"[^\x{3400}-\x{9FFF}\x{3040}-\x{30FF}a-z0-9]"


def farm(x: str) -> str:
    return f"regexp_replace(lower({x}), '{LETTERS}', '', 'g')"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def dense(x: str) -> str:
    return f"lower(regexp_replace({x}, '{LETTERS}', '', 'g'))"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[\\n\\r!?;\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}\\x{{FF1B}}]+'), lambda x: {farm('x')}), lambda x: x <> '')"


def grams(x: str) -> str:
    return f"CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_distinct(list_transform(generate_series(1, length({x}) - 2), lambda i: substring({x}, i, 3))) END"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


POSTS = "posts AS (SELECT doc_id AS id, source AS handle, text, lang, 'timeline' AS context, doc_id AS seq FROM documents)"
KEYS = (
    f"keyed AS (SELECT id, handle, seq, k AS farm_key FROM (SELECT id, handle, seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '') AS k "
    f"FROM (SELECT *, {lines('text')} AS l FROM posts)) WHERE length(k) >= 8)"
)
SHARED = "shared AS (SELECT farm_key, count(DISTINCT handle) AS accounts, count(*) AS posts, min(seq) AS first_seq FROM keyed GROUP BY farm_key HAVING count(DISTINCT handle) >= 2)"
FULL = (
    "full_posts AS (SELECT doc_id AS id, doc_id AS seq, CASE WHEN doc_id % 20 = 1 THEN '' ELSE source END AS handle, "
    f"CASE WHEN doc_id % 10 = 1 THEN {picked(SHORTS, 'doc_id // 10')} WHEN doc_id % 3 = 0 THEN text || ' ' || {picked(PHRASES, 'doc_id // 3')} ELSE text END AS text, "
    f"CASE WHEN doc_id % 20 = 1 THEN '' WHEN doc_id % 9 = 0 THEN {picked(NAMES, 'doc_id // 9')} ELSE source END AS display_name, lang, "
    f"CASE WHEN doc_id % 11 = 0 THEN {picked(PHRASES, 'doc_id // 11')} END AS card_text, CASE WHEN doc_id % 13 = 0 THEN 'a photo of the sea' END AS alt_text, "
    "CASE WHEN doc_id % 17 = 0 THEN 'as someone said' END AS quoted_text, doc_id % 4 = 0 AS has_media, CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 ELSE 0 END AS media_count, "
    f"{picked(('timeline', 'reply', 'recommended'), 'doc_id')} AS context, doc_id % 41 = 0 AS is_own, doc_id % 37 = 0 AS spam_section FROM documents)"
)


def share(k: int) -> str:
    return f"(id * {k} % 101) / 100.0::DOUBLE"


ANSWERS = (
    ", ".join(f"CASE WHEN id % 12 = 5 THEN 0 ELSE {share(k)} END AS {n}" for n, k in (("adult", 37), ("solicitation", 53), ("deceptive", 71), ("confidence", 29)))
    + f", CASE WHEN id % 12 = 5 THEN 0 ELSE (id * 13 % 31) / 10.0::DOUBLE END AS severity, CASE WHEN id % 12 = 5 THEN 'other' ELSE {picked(CATEGORIES, 'id // 7')} END AS category, "
    f"CASE WHEN id % 12 <> 5 AND id % 4 <> 0 THEN {share(17)} END AS junk, CASE WHEN id % 12 = 5 THEN 'model_error' END AS degraded, id % 17 = 0 AS media_suspicious, id % 34 = 0 AS media_blocked, "
    f"CASE WHEN id % 19 = 0 THEN {share(31)} END AS vision_adult, CASE WHEN id % 19 = 0 THEN {share(41)} END AS vision_confidence"
)
REPLIES = (
    "replies AS (SELECT CASE WHEN conv_id % 10 <> 0 THEN conv_id END AS thread_id, turn, conv_id * 1000 + turn AS seq, conv_id * 1000 + turn AS id, role || (turn % 3)::VARCHAR AS handle, "
    f"CASE WHEN turn > 0 AND (conv_id + turn) % 2 = 0 THEN {picked([s for s, _ in SAID], 'conv_id * 3 + turn')} ELSE text END AS text, "
    f"CASE WHEN turn > 0 AND (conv_id + turn) % 2 = 0 THEN {picked([c for _, c in SAID], 'conv_id * 3 + turn')} END AS class, turn = 0 AS thread_root, "
    "CASE WHEN conv_id % 10 = 0 THEN 'timeline' ELSE 'reply' END AS context, CASE WHEN (conv_id * 1000 + turn) % 5 <> 0 THEN ['ignore', 'ignore', 'hide', 'ignore'][(conv_id * 1000 + turn) % 4 + 1] END AS band, "
    "row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations)"
)
