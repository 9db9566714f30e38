"""The timeline end to end: posts, rule scores, campaigns, answers, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.farm import retro_hits
from millrace.operators.gate import decide
from millrace.operators.prescreen import Scope, prescreen
from millrace.schema import answers, full_posts, posts
from millrace.settings import Settings, read_settings

#: What a user might have set: suggestions are not looked at, one account and two phrases are exempt, two groups are off.
SCOPE = Scope(contexts=("timeline", "reply"), handles=("src7",), keywords=("学术讨论", "walk by the sea"))
SETTINGS: Settings = read_settings({"off": ["clickbait", "low_quality"]})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, handle, answers, signals, band and reasons of every post that is not skipped."""
    scored = prescreen(full_posts(spark, sf_dir), SCOPE).where("skip is null").select("id", "handle", "score", "short_with_media", "strong_name_hit", "review_floor", "spam_section")
    campaigns = retro_hits(posts(spark, sf_dir)).selectExpr("id", "accounts", "true as farm_hit")
    return decide(answers(scored.join(campaigns, "id", "left")), SETTINGS)
