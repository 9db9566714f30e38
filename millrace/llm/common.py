"""Helpers that the corpus operators share: table access, checkpoints, components of a link table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of the driver's only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from the files, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the operators read, whatever else the table carries; a null text counts as empty."""
    return docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` equals ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def components(links: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table as (node, component), component being the smallest node reached.

    Alternates two joins a round (each node to the smallest label among its neighbours, then to that label's own
    label), so chains halve every round and stars end in two.  Only min() aggregates and equi-joins: a node with very
    many links is aggregated map-side and its join side is one AQE can split.  Nothing is gathered on the driver but
    one count a round.
    """
    edges = links.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    label = materialise(
        nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select(
            "node", F.coalesce("m", "node").alias("label")
        )
    )
    for _ in range(max_rounds):
        # A label hooks on to the smallest label across any of its members' edges; labels then jump to their root.
        lu = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        lv = label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        across = edges.join(lu, "u").join(lv, "v").where("lu <> lv")
        hook = across.groupBy(F.greatest("lu", "lv").alias("label")).agg(F.min(F.least("lu", "lv")).alias("to"))
        hook = materialise(hook)
        moved = label.join(hook, "label", "left").select("node", F.coalesce("to", "label").alias("label"), F.col("label").alias("was"))
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("up"))
        # What a node's label was goes with it, so no further join tells whether any has changed.
        moved = materialise(moved.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"), "was"))
        if hook.isEmpty() and moved.where("label <> was").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        label = moved.select("node", "label")
    raise RuntimeError("components did not settle")


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df``, written as Parquet into the shared folder and read again: smaller than a checkpoint, and read by column."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled rows that are not held out, picked by a hash of the id.

    The picked ids (16 bytes each, so 16 * bound in all) are broadcast: the texts stay where they are read.
    """
    picked = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[f"`{label}`"].cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(bound)
    )
    return docs.join(F.broadcast(picked), "doc_id")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its count, which is taken, shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df
