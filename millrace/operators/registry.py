"""The account registry: merging sightings, statistics, import and export of lists in several shapes, membership joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bands from the mildest, reasons and post ids kept for an account.
BANDS, REASONS, POSTS = ("ignore", "review", "hide", "block"), 8, 10


def normalize_handle(raw: Column) -> Column:
    """Handle out of @names and profile addresses; empty where none is left."""
    bare = F.regexp_replace(F.trim(raw), r"(?i)^(?:https?://)?(?:www\.)?(?:x|twitter)\.com/", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^@+", ""), r"[/?#].*$", ""))


def valid_handle(handle: Column) -> Column:
    return handle.rlike("^[a-z0-9_]{1,15}$")


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), band)


def merge(sightings: DataFrame) -> DataFrame:
    """One row per handle of (handle, ts, band, adult, hits) and, where the table has them, category and confidence.

    The category is the latest named one.
    """
    have = set(sightings.columns)
    more = [F.max_by("category", F.when(F.col("category").isNotNull(), F.struct("ts", "category"))).alias("best_category")] if "category" in have else []
    more += [F.max("confidence").alias("best_confidence")] if "confidence" in have else []
    hits = F.sum(F.greatest(F.coalesce("hits", F.lit(1)), F.lit(1))) if "hits" in have else F.count("*")
    return sightings.groupBy("handle").agg(
        hits.alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("band", band_rank(F.col("band"))).alias("best_band"), F.max("adult").alias("best_adult"), *more
    )


def evidence(sightings: DataFrame, column: str, most: int, latest: bool = False) -> DataFrame:
    """Per handle the first (or last) ``most`` distinct values of a column, in order of first sight; bounded before it is collected."""
    seen = sightings.where(F.col(column).isNotNull()).groupBy("handle", column).agg(F.min("ts").alias("ts"))
    ahead = (F.desc("ts"), F.desc(column)) if latest else (F.asc("ts"), F.asc(column))
    kept = seen.withColumn("rank", F.row_number().over(Window.partitionBy("handle").orderBy(*ahead))).where(F.col("rank") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("ts", column)))
    return kept.groupBy("handle").agg(F.transform(ordered, lambda x: x[column]).alias(column))


def merge_entries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after ``incoming`` sightings (handle, ts, band, adult, category, confidence, reason, post_id, source).

    Both have these columns, existing ones being the registry's sightings so far.  Handles are normalized, invalid ones
    go; each account has all fields of ``merge``, its first reasons, its last posts, and whether it is new.
    """
    both = existing.withColumn("new", F.lit(False)).unionByName(incoming.withColumn("new", F.lit(True)))
    rows = both.withColumn("handle", normalize_handle(F.col("handle"))).where(valid_handle(F.col("handle")))
    state = rows.groupBy("handle").agg(F.min("new").alias("added"), F.min_by("source", F.struct("new", "ts", "source")).alias("source"))
    out = merge(rows).join(state, "handle")
    for column, most, latest in (("reason", REASONS, False), ("post_id", POSTS, True)):
        out = out.join(evidence(rows, column, most, latest).withColumnRenamed(column, f"{column}s"), "handle", "left")
    return out


def statistics(registry: DataFrame) -> DataFrame:
    return registry.groupBy("best_band").agg(F.count("*").alias("accounts"), F.sum("hits").alias("hits"))


def by_source(registry: DataFrame) -> DataFrame:
    """Accounts by source, and all of them under a null source."""
    return registry.rollup("source").agg(F.count("*").alias("accounts"))


def united(lists: list[DataFrame]) -> DataFrame:
    """Distinct handles of several lists."""
    out = lists[0].select("handle")
    for other in lists[1:]:
        out = out.union(other.select("handle"))
    return out.select(normalize_handle(F.col("handle")).alias("handle")).where(valid_handle(F.col("handle"))).distinct()


def export_list(registry: DataFrame, path: str) -> None:
    """JSON lines, one entry each with the time of export; ``import_list`` reads them back."""
    registry.withColumn("exported_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.json(path)


def export_entries(registry: DataFrame) -> DataFrame:
    """One JSON text per account."""
    return registry.select("handle", F.to_json(F.struct(*registry.columns), {"ignoreNullFields": "false"}).alias("entry"))


def import_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_list(spark.read.text(path).withColumnRenamed("value", "text"))


def remove(registry: DataFrame, handles: DataFrame) -> DataFrame:
    return registry.join(handles.select(normalize_handle(F.col("handle")).alias("handle")).distinct(), "handle", "left_anti")


def named_entries(texts: DataFrame) -> DataFrame:
    """Every entry of an import, one text per row: the text, the normalized handle, and whether it is valid.

    A text is a JSON array of names or entries, an object with ``entries`` or ``handles``, one entry with a ``handle``,
    an object whose keys are names, or plain lines of which the first word counts and ``#`` begins a remark.
    """
    text = F.trim("text")
    whole = F.from_json(text, "entries array<string>, handles array<string>, handle string")
    lines = F.transform(F.filter(F.transform(F.split(text, r"[\n\r,;]+"), F.trim), lambda x: (x != "") & ~x.startswith("#")), lambda x: F.regexp_extract(x, r"^(\S*)", 1))
    named = F.coalesce(whole["entries"], whole["handles"], F.when(whole["handle"].isNotNull(), F.array(whole["handle"])), F.map_keys(F.from_json(text, "map<string,string>")))
    raw = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), named).otherwise(lines)
    name = F.when(F.col("raw").startswith("{"), F.get_json_object("raw", "$.handle")).otherwise(F.col("raw"))
    handle = F.coalesce(normalize_handle(name), F.lit(""))
    return texts.select("text", F.explode(raw).alias("raw")).select("text", handle.alias("handle"), valid_handle(handle).alias("valid"))


def parse_list(texts: DataFrame) -> DataFrame:
    """Valid handles of an import, each once."""
    return named_entries(texts).where("valid").select("handle").distinct()
