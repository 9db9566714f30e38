"""A corpus from raw documents to a mixed training order: each stage is one of the corpus operators at work.

All stages treat a null text as empty and read only doc_id, text, source and labels; rows that repeat stay repeated
unless a stage takes them out, other columns are passed on by all but the last, and an empty table gives an empty one.
Rows without an id are never taken out as near-duplicates or leaks, since ids say what goes; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, id_text, scratch, small
from millrace.llm.decontaminate import contaminated
from millrace.llm.mixing import mixed
from millrace.llm.near_dups import near_duplicates
from millrace.llm.pii import find_pii, fit_pii, redacted
from millrace.llm.quality import fit_quality, quality_scorer

#: Up to so many ids (8 bytes each) are broadcast to take documents out; more of them meet the documents by a shuffle.
BROADCAST_IDS = 2_000_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = fit_quality(id_text(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_scorer(model)(F.coalesce("text", F.lit(""))) >= 0.5)


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    path = scratch(docs.sparkSession, f"pipeline-{name}-ids")
    ids.select("doc_id").distinct().write.parquet(path)
    return docs.join(small(docs.sparkSession.read.parquet(path), BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return _without(docs, near_duplicates(docs).where("not kept"), "near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or its template, go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    model = fit_pii(id_text(docs))
    # The row travels in one column of its own, so that none of its names meets those of the spans.
    found = find_pii(docs.select(F.struct("*").alias("row_read"), F.coalesce("text", F.lit("")).alias("text")), model)
    new = found.withColumn("text", redacted(F.col("text"), F.col("all_spans"))).withColumn("n_chars", F.length("text").cast("long"))
    return new.select(*(F.col(c) if c in ("text", "n_chars") else F.col("row_read").getField(c).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources."""
    return mixed(docs, carry=("text", "lang", "n_chars"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("private", private), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet and read again as the next one's documents, then goes; the last one's stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
