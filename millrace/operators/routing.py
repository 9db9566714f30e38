"""Which posts reach the decision model and what its answers, or their absence, come to; a cache of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import FirstIn, in_order
from millrace.operators.rates import micros

#: The probe's score from which the full question set follows, the life of a cached decision, and how many are held.
ESCALATE, CACHE_SECONDS, CACHE_ENTRIES = 0.75, 6 * 3600, 2000
SCORES = ("adult", "solicitation", "deceptive", "severity", "confidence")
REQUIRED = ("adult", "solicitation", "category", "severity")


def route(scored: DataFrame, triage: bool = True, sample_rate: float = 0.25, client: bool = True) -> DataFrame:
    """Adds ``route`` from booleans candidate, media_suspicious, vision_ok, farm_hit, repeats, model_budget, triage_budget and ``draw`` in [0, 1).

    Without a ``client`` nothing is called: posts that would be asked about have the route no_client.
    """
    ask = F.col("candidate") | F.col("media_suspicious") | F.col("vision_ok")
    return scored.withColumn(
        "route",
        F.when(ask & F.lit(not client), "no_client")
        .when(F.lit(not client), "none")
        .when(ask & F.col("model_budget"), "full")
        .when(ask, "budget_exhausted")
        .when(F.lit(not triage), "none")
        .when(~F.col("farm_hit") & ~F.col("repeats") & (F.col("draw") >= sample_rate), "not_sampled")
        .when(~F.col("triage_budget"), "triage_budget_exhausted")
        .otherwise("probe"),
    )


def evaluate(routed: DataFrame, full: DataFrame, probe: DataFrame) -> DataFrame:
    """Joins the answers of both tiers by id; only routed rows meet them.

    ``full``: id, the scores and category; ``probe``: id, junk.  A missing row is a failed call.  The result has zeros and
    ``other`` where no answer holds, ``junk``, ``source`` (model, probe or null), ``degraded`` (null where all is well) and
    ``note``: why a post that needn't be asked about has no probe's answer.
    """
    asked = routed.select("id", "route").where("route in ('full', 'probe')")
    probed = asked.where("route = 'probe'").select("id").join(probe.select("id", F.col("junk"), F.lit(True).alias("probed")), "id")
    rows = routed.join(probed, "id", "left").withColumn("escalated", (F.col("route") == "probe") & F.coalesce(F.col("junk") >= ESCALATE, F.lit(False)) & F.col("model_budget"))
    answers = full.select("id", *(F.col(c).alias(f"read_{c}") for c in (*SCORES, "category")), F.lit(True).alias("answered"))
    called = rows.where("route = 'full' or escalated").select("id").join(answers, "id")
    rows = rows.join(called, "id", "left").withColumn("called", (F.col("route") == "full") | F.col("escalated"))
    valid = F.coalesce("answered", F.lit(False))
    for c in REQUIRED:
        valid = valid & F.col(f"read_{c}").isNotNull()
    degraded = (
        F.when(F.col("route") == "budget_exhausted", "budget_exhausted")
        .when(F.col("route") == "no_client", "model_error")
        .when((F.col("called") & F.col("answered").isNull()) | ((F.col("route") == "probe") & F.col("probed").isNull()), "model_error")
        .when(F.col("called") & ~valid, "schema_invalid")
    )
    failed = F.col("probed").isNull() | (F.col("escalated") & F.col("answered").isNull())
    note = (
        F.when(F.col("route").isin("not_sampled", "triage_budget_exhausted"), F.col("route"))
        .when((F.col("route") == "probe") & failed, "probe_failed")
        .when((F.col("route") == "probe") & F.col("junk").isNull(), "probe_answer_invalid")
    )
    source = F.when(F.col("called") & valid, "model").when(F.col("junk").isNotNull(), "probe")
    clamped = {c: F.when(valid, F.greatest(F.coalesce(f"read_{c}", F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)) for c in SCORES}
    clamped = {c: v if c == "severity" else F.least(v, F.lit(1.0)) for c, v in clamped.items()}
    category = F.when(valid, F.col("read_category")).otherwise("other")
    return rows.select("id", "route", "escalated", *(v.alias(c) for c, v in clamped.items()), category.alias("category"), "junk", source.alias("source"), degraded.alias("degraded"), note.alias("note"))


def cached(requests: DataFrame, key: str | Column, ts: str, order: str, seconds: int = CACHE_SECONDS, most: int = CACHE_ENTRIES, fingerprint: Column | None = None, scope: Column | None = None) -> DataFrame:
    """Which requests a cache answers: ``order`` and ``hit``.

    A decision answers the same key under the same ``fingerprint`` of the settings for ``seconds``, not renewed by use; of
    more than ``most`` decisions the first made go.  ``scope`` tells caches apart (a viewer, a shard): each is one pass.
    """
    asked = (F.col(key) if isinstance(key, str) else key).cast("string")
    asked = asked if fingerprint is None else F.concat_ws("\x1f", asked, fingerprint.cast("string"))
    return in_order(requests, F.lit("") if scope is None else scope, micros(ts), order, lambda: FirstIn(most, seconds * 1_000_000), asked, "hit")
