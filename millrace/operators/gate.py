"""The decision table: model answers and local signals to a band with reasons; then the account action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.settings import CATEGORIES, Settings

#: Signals that a table may lack, and what stands for them.
SIGNALS = {
    "score": 0, "farm_hit": False, "accounts": 0, "media_suspicious": False, "media_blocked": False, "short_with_media": False, "strong_name_hit": False,
    "review_floor": False, "spam_section": False,
}
LIKELIHOODS = ("adult", "solicitation", "deceptive", "confidence", "severity")


def known_category(raw: Column) -> Column:
    return F.when(raw.isin(*CATEGORIES), raw).otherwise("other")


def category_of(names: tuple[str, ...], category: Column) -> Column:
    return category.isin(*names) if names else F.lit(False)


Reason = Column | str | tuple[Column, str]


def _named(part: Reason) -> Column:
    """A reason's name; that of a pair only where its test holds."""
    return F.when(part[0], part[1]) if isinstance(part, tuple) else F.lit(part) if isinstance(part, str) else part


def branches(settings: Settings) -> list[tuple[int, Column, str | Column, list[Reason]]]:
    """(number, test, band, reasons) in the order in which they are tried; the first that holds decides."""
    t = settings.thresholds
    category = known_category(F.col("category"))
    enabled = category_of(tuple(c for c, (g, _, _) in CATEGORIES.items() if settings.on(g)), category)
    hideable = category_of(tuple(c for c, (_, h, _) in CATEGORIES.items() if h), category)
    eligible = category_of(tuple(c for c, (_, _, e) in CATEGORIES.items() if e), category)
    adult_on, farm_on, any_on = (F.lit(x) for x in (settings.on("adult"), settings.on("farm"), settings.any_on))
    a, so, d, c, s = (F.col(x) for x in LIKELIHOODS)
    score, junk = F.col("score"), F.col("junk")
    accounts, farm = F.col("accounts"), farm_on & F.col("farm_hit")
    blocked, suspicious = adult_on & F.col("media_blocked"), adult_on & F.col("media_suspicious")
    at_least = lambda x, v: F.coalesce(x >= v, F.lit(False))
    named, strong = F.concat(F.lit("category:"), category), (score >= 3, "prefilter_strong")
    dual = (a >= t.dual) & (so >= t.dual) & (c >= t.dual_confidence)
    evidence = [(a >= t.block, "adult_high"), (d >= t.deceptive, "deceptive_high"), ((so >= 0.9) & (s >= 2.5), "solicitation_high"), (dual, "dual_confirmation_block")]
    sure = evidence[0][0] | evidence[1][0] | evidence[2][0] | dual
    local = (a >= t.farm_least) | (d >= t.farm_least) | (so >= 0.6) | (score >= 1) | at_least(junk, t.farm_least)
    campaign = ["farm_repeat", (score >= 1, "prefilter_weak")]
    shown = enabled & hideable
    return [
        (1, enabled & eligible & (c >= t.block_confidence) & (s >= t.block_severity) & sure, "block", [named, *evidence, strong]),
        (2, farm & (accounts >= 3), "hide", campaign),
        (3, farm & local, "hide", campaign),
        (4, blocked & ((a >= 0.5) | (score >= 2)), "hide", ["media_skin_dominant", (score >= 2, "prefilter_weak")]),
        (5, suspicious & (so >= 0.8), "hide", ["media_skin_suspicious", "off_platform_solicitation"]),
        (6, adult_on & at_least(F.col("vision_adult"), 0.9) & at_least(F.col("vision_confidence"), 0.7), "hide", ["vision_model_adult"]),
        (7, adult_on & (a >= 0.9) & (c >= 0.5), "hide", [named, "adult_probability_high"]),
        (8, shown & ((c >= t.hide_confidence) | (s >= t.hide_severity)), "hide", [named, "category_confident", strong]),
        (9, shown & (a >= 0.9), "hide", [named, "adult_probability_high"]),
        (10, shown & (c >= t.review_confidence), "review", [named, "low_confidence_review"]),
        (11, any_on & F.col("review_floor"), "review", ["solicit_template", strong]),
        (12, any_on & F.col("spam_section"), "review", ["x_spam_section"]),
        (13, adult_on & F.col("strong_name_hit"), "review", ["profile_solicitation", strong]),
        (14, any_on & at_least(junk, t.junk_review), "review", ["junk_probe"]),
        (15, blocked & F.col("short_with_media"), "review", ["media_skin_dominant", "too_short_with_media"]),
        (16, suspicious & (score >= 2), "review", ["media_skin_suspicious", "prefilter_weak"]),
        (17, adult_on & (a >= 0.5), "review", ["low_confidence_review"]),
        (18, F.col("degraded").isNotNull(), F.when(score >= 2, "review").otherwise("ignore"), [F.col("degraded")]),
        (19, ~enabled & hideable & (c >= t.hide_confidence), "ignore", ["category_disabled"]),
    ]


def decide(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds branch, band and reasons.

    ``scored`` has the answers, category and junk, and the signals where there are any; missing likelihoods count as 0.
    The table is worked out once, as the number of its first branch; band and reasons follow from that.
    Reasons also name the degradation and the images that looked suspicious, each once.
    """
    have = set(scored.columns)
    filled = {k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in SIGNALS.items()}
    filled |= {k: F.coalesce(F.col(k), F.lit(0.0)) for k in LIKELIHOODS}
    filled |= {k: F.lit(None).cast("double") for k in ("junk", "vision_adult", "vision_confidence") if k not in have}
    filled |= {"degraded": F.lit(None).cast("string")} if "degraded" not in have else {}
    rows, table = scored.withColumns(filled), branches(settings)
    number = F.lit(20)
    for n, test, _, _ in reversed(table):
        number = F.when(test, n).otherwise(number)
    rows = rows.withColumn("branch", number)
    names = {n: name for n, _, name, _ in table}
    band = F.get(F.array(*(F.lit(names.get(n, "ignore")) if isinstance(names.get(n, ""), str) else names[n] for n in range(1, 21))), F.col("branch") - 1)
    # All reasons of all branches in one array, of which those of the deciding branch are kept.
    every_reason = F.array(*(F.struct(F.lit(n).alias("n"), _named(part).alias("name")) for n, _, _, parts in table for part in parts))
    reasons = F.transform(F.filter(every_reason, lambda x: (x["n"] == F.col("branch")) & x["name"].isNotNull()), lambda x: x["name"])
    skin = F.when(F.col("media_blocked"), F.array(F.lit("skin_ratio_blocked"))).when(F.col("media_suspicious"), F.array(F.lit("skin_ratio_suspicious"))).otherwise(F.array().cast("array<string>"))
    degraded = F.array_compact(F.array(F.col("degraded")))
    every = F.array_distinct(F.concat(reasons, degraded, skin))
    return rows.withColumn("band", band).withColumn("reasons", every).withColumn("category", known_category(F.col("category")))


def plan_action(decided: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """kind, execute and reason of the account action of each decision; ``budget`` (actions left) counts where the table has it."""
    s = settings.actions
    both = {(True, True): "both", (True, False): "block", (False, True): "mute", (False, False): "none"}[s.auto_block, s.auto_mute]
    hides = (F.col("band") == "hide") & F.lit(s.mute_on_hide)
    kind = F.when(hides, "mute").when(F.col("band") == "block", both).otherwise("none")
    budget = F.coalesce(F.col("budget"), F.lit(1)) if "budget" in decided.columns else F.lit(1)
    reason = (
        F.when((F.col("band") != "block") & ~hides, "band_below_block")
        .when(F.coalesce("handle", F.lit("")) == "", "unknown_handle")
        .when(F.col("kind") == "none", "no_action_configured")
        .when(F.lit(s.dry_run), "dry_run")
        .when(budget <= 0, "budget_exhausted")
        .otherwise("armed")
    )
    return decided.withColumn("kind", kind).withColumn("reason", reason).withColumn("execute", F.col("reason") == "armed")


def first_actions(planned: DataFrame) -> DataFrame:
    """Each account action once: the earliest armed one of a handle and kind."""
    armed = planned.where("execute")
    return armed.groupBy("handle", "kind").agg(F.min("id").alias("id"))
