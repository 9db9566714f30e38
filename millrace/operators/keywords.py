"""Which texts hold which of many keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Characters of all keywords together up to which one automaton of them is sent to the tasks (some 50 bytes a character).
AUTOMATON_CHARS = 2_000_000


def contains_join(texts: DataFrame, keys: DataFrame, gram: int = 8, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """doc_id and the smallest item_id of the keywords (k, item_id) that a text (doc_id, t) contains; an empty keyword is in every text.

    Lists of a checked size become an automaton that reads each text once, whatever their number; longer ones meet the
    texts by their grams.
    """
    keys = keys.where("k is not null and item_id is not null")
    size = keys.agg(F.coalesce(F.sum(F.length("k")), F.lit(0))).first()[0]
    return _by_automaton(texts, keys) if size <= automaton_chars else _by_grams(texts, keys, gram)


def _by_automaton(texts: DataFrame, keys: DataFrame) -> DataFrame:
    import ahocorasick

    found = ahocorasick.Automaton()
    least = {r["k"]: r["item_id"] for r in keys.groupBy("k").agg(F.min("item_id").alias("item_id")).collect()}
    always = least.pop("", None)
    for k, item in least.items():
        found.add_word(k, item)
    found.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast((found, always))
    types = {f.name: f.dataType.simpleString() for f in (texts.schema["doc_id"], keys.schema["item_id"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = sent.value
        for b in batches:
            ids, best = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist()):
                hits = (item for _, item in automaton.iter(t)) if len(automaton) and t is not None else ()
                first = min(hits, default=always)
                if t is not None and first is not None:
                    ids.append(i)
                    best.append(first if always is None else min(first, always))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(best, pa.int64())], ["doc_id", "item_id"])

    # A row may repeat an id: the smallest item of all its rows counts.
    met = texts.select("doc_id", "t").mapInArrow(run, f"doc_id {types['doc_id']}, item_id long")
    return met.groupBy("doc_id").agg(F.min("item_id").cast(types["item_id"]).alias("item_id"))


def _by_grams(texts: DataFrame, keys: DataFrame, gram: int) -> DataFrame:
    """A keyword meets the texts in an equi-join of its first ``gram`` characters, or of all if it has fewer, with their grams of that length."""
    keys = keys.withColumn("g", F.left("k", F.lit(gram))).withColumn("n", F.length("g"))
    used = sorted(r["n"] for r in keys.select("n").distinct().collect())  # at most gram + 1 numbers
    found = []
    if 0 in used:
        least = keys.where("n = 0").agg(F.min("item_id")).first()[0]
        found.append(texts.where("t is not null").select("doc_id", F.lit(least).cast(keys.schema["item_id"].dataType).alias("item_id")))
    lengths = [n for n in used if n]
    if lengths:
        grams = F.array_distinct(F.concat(*(T.grams(F.col("t"), n) for n in lengths)))
        met = texts.select("doc_id", "t", F.explode(grams).alias("g")).join(keys, "g")
        found.append(met.where(F.contains("t", "k")).select("doc_id", "item_id"))
    if not found:
        return texts.select("doc_id", F.lit(None).cast(keys.schema["item_id"].dataType).alias("item_id")).where("false")
    both = found[0] if len(found) == 1 else found[0].union(found[1])
    return both.groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
