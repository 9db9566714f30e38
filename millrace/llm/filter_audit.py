"""Filter interaction audit (operator 11): what each filter removes, alone and after others, in every order.

Orders of filters form a trie.  Two prefixes that hold the same filters leave the same survivors, so a state is a set of
filters: of n filters 2**n states instead of all prefixes of n! orders.  The trie is walked depth first.  Each state has
its survivors as a persisted DataFrame, made from its parent's by one filter; what each filter still to come removes is
counted on them, edge by edge; then the states below follow, unless another order has come by already.  Once the walk
leaves a state its survivors are given up, so at most n of them are held.  Survivors are a few flags a document: texts
are read once.  A lost executor costs the filters since the flags, which are written to the shared folder.

Results: a row for each part, order and step, zeros included.  A null text is empty; a null part is the empty string;
rows that repeat are counted each; a document without an id repeats no other and is repeated by none; of several labels
of a document one that says so is enough; columns other than those named are not read; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import scratch, small, stored, table

#: Up to so many rows of labels, or of texts that several documents have, are broadcast; more of them are shuffled.
BROADCAST_ROWS = 1_000_000
GAP, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text decides by itself; true where the document fails."""
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP, -1))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """part, a flag for each filter, and whether labels call the document good or toxic; written once."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(v.alias(k) for k, v in text_failures(F.col("text")).items())), "audit-flags")
    # Only texts of several ids can repeat one; sums for each are made before they are shuffled.
    first = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "audit-firsts")
    rows = rows.join(small(first, broadcast_rows), "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic"))
    rows = rows.join(small(stored(marks.where("doc_id is not null and (good or toxic)"), "audit-labels"), broadcast_rows), "doc_id", "left")
    return stored(rows.select("part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit-rows")


def edges(rows: DataFrame, filters: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """part, state (filters already applied, in the order of ``filters``), filter, alive, removed, lost_<outcome> of every edge."""
    path, seen = scratch(rows.sparkSession, "audit-edges"), set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        seen.add(state)
        left = [f for f in filters if f not in state]
        counts = {(f, o): F.count_if(F.col(f) & F.col(o) if o else F.col(f)).alias(f"{f}_{o}") for f in left for o in ("", *outcomes)}
        counted = survivors.groupBy("part").agg(F.count("*").alias("alive"), *counts.values())
        edge = lambda f: F.struct(F.lit(f).alias("filter"), F.col(f"{f}_").alias("removed"), *(F.col(f"{f}_{o}").alias(f"lost_{o}") for o in outcomes))
        counted = counted.select("part", F.lit("".join(f for f in filters if f in state)).alias("state"), "alive", F.inline(F.array(*map(edge, left))))
        counted.write.mode("append").parquet(path)
        for f in left:
            below = state | {f}
            if below not in seen and len(below) < len(filters):
                kept = survivors.where(~F.col(f)).persist()
                visit(below, kept)
                kept.unpersist()

    visit(frozenset(), rows)
    return rows.sparkSession.read.parquet(path)


def orders(filters: Sequence[str]) -> list[tuple[int, str, int, str, str]]:
    """Number, order, step, the state before the step and its filter, of every order and step."""
    ranked = [("".join(p), k + 1, "".join(f for f in filters if f in p[:k]), p[k]) for p in permutations(filters) for k in range(len(p))]
    return [(n, *x) for n, x in enumerate(ranked)]


def audit(rows: DataFrame, filters: Sequence[str], outcomes: Mapping[str, str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a column for each outcome's losses, shapley.

    ``rows`` has ``part``, a flag for each filter (one letter) and one for each key of ``outcomes``, whose values name
    the columns of losses.
    """
    spark, n = rows.sparkSession, len(filters)
    found = edges(rows, filters, list(outcomes))
    before = F.length("state")
    # In so many of the orders exactly the state's filters come before the edge's.
    times = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), before + 1)
    whole = found.groupBy("part", "filter").agg(
        F.max(F.when(before == 0, F.col("removed"))).alias("fails"), F.coalesce(F.max(F.when(before == n - 1, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(times * F.col("removed")).alias("shapley"),
    )
    walk = spark.createDataFrame(orders(filters), "n int, filter_order string, step int, state string, filter string")
    steps = whole.select("part").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n * factorial(n) - 1)))).join(F.broadcast(walk), "n")
    at = steps.join(found, ["part", "state", "filter"], "left").join(whole, ["part", "filter"])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return at.select(
        "part", "filter_order", "step", (number("alive") - number("removed")).alias("kept"), number("removed").alias("removed"), (F.col("fails") - number("removed")).alias("redundant"),
        number("unique_fails").alias("unique_fails"), *(number(f"lost_{o}").alias(c) for o, c in outcomes.items()), number("shapley").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS repeats
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN repeats THEN 'E' ELSE '' END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT a.c || b.c || m.c || y.c || z.c AS filter_order FROM x a, x b, x m, x y, x z WHERE len(list_distinct([a.c, b.c, m.c, y.c, z.c])) = 5
), s AS (
  SELECT filter_order, step, substring(filter_order, step, 1) AS own, substring(filter_order, 1, step - 1) AS gone FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE translate(fails, gone || own, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, gone, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND translate(fails, gone, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(fails, own) AND translate(fails, gone, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE contains(fails, own) AND translate(fails, gone, '') = fails), 0) AS toxic_lost
  FROM p, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
