"""What the decision model is told and how its replies are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import truncate
from millrace.operators.gate import known_category

#: Characters of a whole state, of a name, and of each other text.
STATE_CHARS, NAME_CHARS, PART_CHARS = 4000, 120, 300
REQUIRED = ("adult", "solicitation", "category", "severity")
SCHEMA = (
    "adult struct<noul:double>, solicitation struct<noul:double>, deceptive struct<noul:double>, category struct<choice:string,confidence:double>, "
    "severity struct<score:double,confidence:double>, junk struct<noul:double>"
)


def state_text(posts: DataFrame) -> Column:
    """A post as the model reads it.  Lines without a value are left out; the whole is cut."""
    have = set(posts.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    some = lambda x: F.when(x != "", x)
    part = lambda title, name, most: F.concat(F.lit(f"{title}="), truncate(some(col(name)), most))
    ratio = lambda title, name: F.concat(F.lit(f"{title}="), F.format_number(F.col(name), "0.000")) if name in have else F.lit(None).cast("string")
    media = F.coalesce(F.col("media_count"), F.lit(0)) if "media_count" in have else F.lit(0)
    place = F.concat(
        F.lit("platform=x.com; position="), F.coalesce(col("context"), F.lit("timeline")), F.lit("; has_media="), F.when(media > 0, "yes").otherwise("no"),
        F.lit("; media_count="), media.cast("string"),
    )
    handle = F.concat(F.lit("handle=@"), F.coalesce(some(F.regexp_replace(F.coalesce(F.col("handle"), F.lit("")), "^@+", "")), F.lit("unknown")))
    lines = (
        F.lit("POST TEXT:"), F.coalesce(some(F.trim(F.coalesce(F.col("text"), F.lit("")))), F.lit("(no text)")), F.lit(""), F.lit("AUTHOR:"), handle, part("display_name", "display_name", NAME_CHARS),
        F.lit(""), F.lit("CONTEXT:"), place, part("media_alt_text", "alt_text", PART_CHARS), part("link_card_text", "card_text", PART_CHARS), part("quoted_post_text", "quoted_text", PART_CHARS),
        F.concat(F.lit("declared_language="), some(col("lang"))), ratio("local_image_skin_tone_ratio", "skin_ratio"), ratio("local_vision_adult_probability", "vision_adult"),
    )
    return truncate(F.concat_ws("\n", *lines), STATE_CHARS)


def _share(x: Column) -> Column:
    """Clamped to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def read_answers(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``replies`` with the scores, category and junk that a JSON reply holds, and whether it is complete.

    Missing likelihoods count as 0 and a missing category as other; junk stays null.  Unreadable replies are incomplete.
    """
    rows = replies.withColumn("_a", F.from_json(column, SCHEMA))
    a = F.col("_a")
    value = {"adult": a["adult"]["noul"], "solicitation": a["solicitation"]["noul"], "deceptive": a["deceptive"]["noul"], "confidence": a["category"]["confidence"]}
    out = {k: F.coalesce(_share(v), F.lit(0.0)) for k, v in value.items()}
    out["severity"] = F.greatest(a["severity"]["score"], F.lit(0.0))
    out["category"] = F.coalesce(known_category(a["category"]["choice"]), F.lit("other"))
    out["junk"] = _share(a["junk"]["noul"])
    complete = F.coalesce(a[REQUIRED[0]].isNotNull(), F.lit(False))
    for name in REQUIRED[1:]:
        complete = complete & F.coalesce(a[name].isNotNull(), F.lit(False))
    out["complete"] = complete
    return rows.withColumns(out).drop("_a")
