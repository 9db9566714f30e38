"""What is kept of decisions: audit events, their retention, counters, labels for people, and the summary of a page."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import preview
from millrace.operators.emotion import LABELS as FEELINGS
from millrace.operators.rules import RULES

#: Characters of a text in an audit event, events that are kept, most that a badge shows.
PREVIEW, KEPT, BADGE = 160, 500, 999
CATEGORY_LABELS = {
    "adult_porn": "pornography", "adult_solicitation": "sexual solicitation", "scam": "scam or gambling", "ad_spam": "advertising", "clickbait": "clickbait",
    "low_quality": "low quality", "suggestive_bait": "suggestive bait", "ordinary": "ordinary", "other": "unclassified",
}
REASON_LABELS = {
    "adult_high": "the model is sure of adult content", "deceptive_high": "the model is sure of deception", "solicitation_high": "the model is sure of solicitation",
    "dual_confirmation_block": "adult content and solicitation confirm each other", "prefilter_strong": "strong rules hit", "prefilter_weak": "weak rules hit",
    "farm_repeat": "several accounts post the same text", "media_skin_dominant": "the image shows mostly skin", "media_skin_suspicious": "the image shows much skin",
    "off_platform_solicitation": "invites off the platform", "vision_model_adult": "the image model is sure", "adult_probability_high": "adult content is likely",
    "category_confident": "the category is clear", "low_confidence_review": "unsure, to be looked at", "solicit_template": "a known solicitation phrase", "x_spam_section": "the platform calls it spam",
    "profile_solicitation": "the name solicits", "junk_probe": "the probe calls it junk", "too_short_with_media": "hardly any text beside the image", "category_disabled": "the category is switched off",
    "budget_exhausted": "no calls were left", "model_error": "the model failed", "schema_invalid": "the answer was incomplete", "skin_ratio_blocked": "nearly all skin", "skin_ratio_suspicious": "much skin",
} | {r.id: f"rule {r.id}" for r in RULES} | {"random_name": "the name looks random"}


def labelled(codes: Column, labels: Mapping[str, str] = REASON_LABELS) -> Column:
    """Labels of an array of codes; ``category:`` codes by their category, unknown ones as they are."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    categories = F.create_map(*(F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair))
    named = lambda c: F.try_element_at(categories, F.regexp_replace(c, "^category:", ""))
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), F.when(c.startswith("category:"), named(c)), c))


def feeling_labels(classes: Column) -> Column:
    return labelled(classes, FEELINGS)


def audit_events(decided: DataFrame, version: str = "1") -> DataFrame:
    """One event per decision: its number, time, the post with a short text, and the decision, as structs."""
    post = F.struct("id", "handle", "context", preview(F.coalesce("text", F.lit("")), PREVIEW).alias("text_preview"))
    made = F.struct("band", "category", "reasons")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return decided.select(F.col("seq"), "ts", iso.alias("iso"), F.lit("decision").alias("type"), F.lit(version).alias("version"), post.alias("post"), made.alias("decision"))


def retained(logs: list[DataFrame], order: str, most: int = KEPT) -> DataFrame:
    """The latest ``most`` events of several logs together, each once."""
    both = logs[0]
    for other in logs[1:]:
        both = both.unionByName(other)
    latest = both.orderBy(F.desc(order)).limit(most) if len(logs) == 1 else both.dropDuplicates([order]).orderBy(F.desc(order)).limit(most)
    return latest


def counters(decided: DataFrame, by: str) -> DataFrame:
    """Decisions by band, skips, and sum and mean of the latency, for each value of ``by``."""
    bands = {b: F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("block", "hide", "review", "ignore")}
    return decided.groupBy(by).agg(F.count("*").alias("decisions"), *bands.values(), F.count_if(F.col("skip").isNotNull()).alias("skips"), F.sum("latency_ms").alias("latency_sum"), F.avg("latency_ms").alias("latency_mean"))


def added_up(flushes: DataFrame, key: str) -> DataFrame:
    """Counters over several flushes: sums of each numeric column, a flush being what was counted since the last one."""
    numbers = [c for c, t in flushes.dtypes if c != key and t in ("bigint", "int", "double")]
    return flushes.groupBy(key).agg(*(F.sum(c).alias(c) for c in numbers))


def summary(shown: DataFrame) -> DataFrame:
    """By author of a page's posts: how many are hidden, folded and marked."""
    state = F.col("display_state")
    return shown.groupBy("handle").agg(
        F.count("*").alias("posts"), F.count_if(state == "hidden").alias("hidden"), F.count_if(state == "beta_folded").alias("folded"), F.count_if(state == "alpha").alias("alpha")
    )


def badge(n: Column) -> Column:
    return F.least(n, F.lit(BADGE))


def recent(rows: DataFrame, by: str, order: str, most: int = 40) -> DataFrame:
    """The latest ``most`` rows of each value of ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)
