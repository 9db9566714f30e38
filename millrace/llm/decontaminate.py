"""Benchmark decontamination (operator 1): template windows and slot consistency, in SQL functions only.

A text becomes a sequence of lower-case words in which numbers, units after numbers and names (capitalised words
inside a sentence) are typed slots.  Windows of ``WINDOW`` tokens, hashed without the slots' values, of every document
are joined to those of the benchmark items, so a question asked again with other numbers or names still meets its
template.  Windows of slots mostly meet only windows with the same values.  Hits are judged by occurrence: those with
one offset between item and text, those with neighbouring offsets (words put in or left out), and all of a text.  Within
an occurrence each value of the item must stand for one value of the document; a document is contaminated when an
occurrence has at least ``COVERAGE`` of the item's windows so, of the template's or of all.

Results: one row per contaminated document and item.  Null and empty texts, and items of fewer than ``LEAST`` tokens,
match nothing; an item shorter than a window is one window; repeated rows of the same id count once;
rows without an id are judged each by itself and
reported under a null id.  Other columns are not read.  Whole texts are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import id_text, table

WINDOW, LEAST, COVERAGE = 8, 4, 0.5
#: Offsets this close are one occurrence; a template that an item repeats lies a window away at least.
SHIFT = WINDOW - 1
#: Up to so many benchmark windows (24 bytes and eight short words each) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Units of measurement that become a slot when they follow a number.
UNITS = "km|cm|mm|kg|mg|lbs?|oz|miles?|meters?|metres?|feet|foot|inch(?:es)?|liters?|litres?|grams?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|mph|m|g|l|s|h"
_NUMBER = r"\d(?<![\p{L}\p{N}]\d)\d*(?:[.,:/]\d+)*"
_QUANTITY = rf"({_NUMBER})[  ]?({UNITS})(?![\p{{L}}\p{{N}}])"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{Ll}'’-]+(?![\p{L}\p{N}])"
_GAPS = r"[^\p{L}\p{N}\x01]+"
_VALUE_GAPS = r"(?:[^\p{L}\p{N}\x01.,:/]|[.,:/](?!\d)|(?<!\d)[.,:/])+"


def tokens(text: Column, values: bool = False) -> Column:
    """Words of a text; slots are \\x01 and n, u or p, followed by the value where ``values`` is set."""
    v = (lambda group: f"${group}") if values else (lambda group: "")
    named = F.when(text.rlike(r"[\p{L}\p{N},;] \p{Lu}"), F.regexp_replace(text, f"({_NAME})", f" \x01p{v(1)} ")).otherwise(text)
    with_numbers = F.regexp_replace(F.regexp_replace(named, _QUANTITY, f" \x01n{v(1)} \x01u{v(2)} "), f"({_NUMBER})", f" \x01n{v(1)} ")
    marked = F.when(text.rlike(r"\d"), with_numbers).otherwise(named)
    return F.array_remove(F.split(F.lower(marked), _VALUE_GAPS if values else _GAPS, -1), "")


def window_hashes(words: Column, size: int) -> Column:
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size))))


def _least_literal(size):
    return F.greatest(F.lit(2), F.floor(size / 2))


def _literal(part: Column) -> Column:
    return F.size(F.filter(part, lambda x: ~x.startswith("\x01")))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, size, key, at, of and of_all (windows of the item that are no ``heavy`` ones, and all), heavy, valued tokens of each window of the items.

    The key of a heavy window, one of slots mostly, is that of its valued tokens.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = items.withColumn("words", tokens(F.col("text"))).withColumn("valued", tokens(F.col("text"), True))
    items = items.where(F.size("words") >= LEAST).withColumn("size", F.least(F.size("words"), F.lit(window)))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    each = at.withColumn("part", F.expr("slice(words, at, size)")).withColumn("item_part", F.expr("slice(valued, at, size)"))
    each = each.withColumn("heavy", _literal(F.col("part")) < _least_literal(F.col("size")))
    of = Window.partitionBy("item_id")
    key = F.when(F.col("heavy"), F.xxhash64("item_part")).otherwise(F.xxhash64("part"))
    return each.select("item_id", "size", key.alias("key"), "at", F.count_if(~F.col("heavy")).over(of).alias("of"), F.count("*").over(of).alias("of_all"), "heavy", "item_part")


def _probe(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_id, text, tkey, pos and the item's columns of each window that an item has as well."""
    windows = F.posexplode(window_hashes(F.col("words"), size)).alias("pos", "key")
    if items.count() <= BROADCAST_WINDOWS:
        return docs.select("doc_id", "text", "tkey", windows).join(F.broadcast(items), "key")
    # Windows travel without their text, which only those that meet an item fetch again.
    found = docs.select("doc_id", "tkey", windows).join(items, "key").withColumnsRenamed({"doc_id": "of_doc", "tkey": "of_text"})
    texts = docs.select("doc_id", "tkey", "text").dropDuplicates(["doc_id", "tkey"])
    return found.join(texts, F.col("of_doc").eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("tkey")))


def _probe_heavy(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """doc_id, tkey, pos and the item's columns of each window of slots mostly that an item has with the same values."""
    n = F.size("words") - (size - 1)
    key = lambda i: F.when(_literal(F.slice("words", i, size)) < _least_literal(F.lit(size)), F.xxhash64(F.slice("valued", i, size)))
    keys = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((i - 1).alias("pos"), key(i).alias("key"))), lambda x: x["key"].isNotNull())
    # More slots than half of a window, or all but one of its tokens: two of them are neighbours.
    dense = docs.where((n >= 1) & F.array_join("words", " ").rlike("\x01. \x01")).withColumn("valued", tokens(F.col("text"), True))
    found = dense.select("doc_id", "tkey", F.explode(keys).alias("w")).select("doc_id", "tkey", "w.pos", "w.key")
    return found.join(F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items, "key")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots of documents that hold an item or its template, of its best occurrence.

    One scan of the texts: windows are exploded and probe the benchmark's inside the same stage; only hits, with the
    few words they span, are grouped by document and item.  Windows of slots mostly take a second scan, if items have any.
    """
    items = item_windows(benchmark, window)
    sizes = sorted(map(tuple, items.select("size", "heavy").distinct().collect()))  # at most twice ``window`` rows
    docs = id_text(docs).withColumn("words", tokens(F.col("text"))).withColumn("tkey", F.xxhash64("text"))
    hits = None
    for size, heavy in sizes:
        of_size = items.where((F.col("size") == size) & (F.col("heavy") == heavy))
        if heavy:
            probed = _probe_heavy(docs, of_size, size)
            spoken = F.col("item_part")
        else:
            probed = _probe(docs, of_size, size)
            spoken = F.slice(tokens(F.col("text"), True), F.col("pos") + 1, size)
        pairs = F.filter(F.arrays_zip(F.col("item_part").alias("b"), spoken.alias("d")), lambda p: p["b"].startswith("\x01"))
        slotted = F.exists("item_part", lambda x: x.startswith("\x01"))
        none = F.array().cast("array<struct<b:string,d:string>>")
        hit = probed.select("doc_id", "tkey", "item_id", "at", (F.col("pos") - F.col("at")).alias("offset"), "of", "of_all", "heavy", F.when(slotted, pairs).otherwise(none).alias("slots"))
        hits = hit if hits is None else hits.union(hit)
    if hits is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_slots")).where("false")
    # Each hit counts among those of the template, and among all where the item has heavy windows.
    counted = F.filter(F.array(F.when(~F.col("heavy"), F.col("of")), F.when(F.col("of_all") > F.col("of"), F.col("of_all"))), lambda x: x.isNotNull())
    hits = hits.withColumn("of", F.explode(counted))
    of_text = ["doc_id", "tkey", "item_id", "of"]
    slots = lambda found: F.array_distinct(F.flatten(found)).alias("slots")
    lines = hits.groupBy(*of_text, "offset").agg(F.collect_set("at").alias("at"), slots(F.collect_set("slots")))
    by_offset = Window.partitionBy(*of_text).orderBy("offset")
    fresh = F.when(F.col("offset") - F.lag("offset").over(by_offset) <= SHIFT, 0).otherwise(1)
    lines = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_offset.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("no")) for k, c in enumerate(("offset", "run"))), F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("no")))
    grouped = lines.withColumn("occurrence", F.explode(kinds)).groupBy(*of_text, "occurrence").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), slots(F.collect_list("slots"))
    )
    values = F.array_distinct(F.transform("slots", lambda p: p["b"]))
    passed = grouped.withColumn("coverage", F.col("n_windows") / F.col("of")).where((F.col("coverage") >= coverage) & (F.size(values) == F.size("slots")))
    best = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", F.size("slots").alias("n_slots"))).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.coverage", "best.n_slots")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
