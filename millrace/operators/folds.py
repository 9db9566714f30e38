"""Replies of a thread: low-information replies fold under the first one; candidates, references and model answers for the rest.

``replies`` has thread_id, seq (the order of observation), id, handle, text and context, with class or band where a
function says so.  Nothing here joins a whole thread with itself: pairs meet inside bounded stretches of seq.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import farm_key, farm_text, group_key, overlap, preview, shingles
from millrace.operators.cut import kept
from millrace.operators.emotion import CLASSES, LABELS
from millrace.operators.order import numbered
from millrace.operators.overlaps import Trigrams, millionths
from millrace.operators.recent import STRETCH, entry_key, over_windows
from millrace.settings import Folding

ORDER = (*CLASSES, "emoji")


def fold_allowed(context: Column, s: Folding = Folding()) -> Column:
    return F.when(context == "reply", F.lit(s.fold_in_replies)).otherwise(F.lit(s.fold_in_feed))


def fold_scope(s: Folding = Folding()) -> Column:
    """thread, feed, or null where a post takes no part: roots, switches that are off, replies without a thread."""
    inside = (F.col("context") == "reply") | F.col("thread_id").isNotNull()
    root = F.col("thread_root") | F.coalesce(F.col("id").cast("string") == F.col("thread_id").cast("string"), F.lit(False))
    on = F.lit(s.enabled and s.emotion) & F.when(inside, s.fold_in_replies).otherwise(s.fold_in_feed)
    return F.when(root | ~on | F.col("class").isNull() | (inside & F.col("thread_id").isNull()), None).when(inside, "thread").otherwise("feed")


def breakdown(classes: Column) -> Column:
    """Map of class to count as a string, most first, ties in the order of the classes; empty for a single class."""
    ranked = F.array_sort(F.transform(F.map_entries(classes), lambda e: F.struct((-e["value"]).alias("n"), F.array_position(F.array(*map(F.lit, ORDER)), e["key"]).alias("o"))))
    name = lambda e: F.element_at(F.array(*(F.lit(LABELS[c]) for c in ORDER)), e["o"].cast("int"))
    shown = F.transform(ranked, lambda e: F.concat_ws(" ", name(e), (-e["n"]).cast("string")))
    return F.when(F.size(classes) > 1, F.array_join(shown, " · ")).otherwise("")


def thread_fold(replies: DataFrame, s: Folding = Folding()) -> DataFrame:
    """Each classified post's fold as of its own place: scope, representative and its author, size, running counts by class.

    One window over each thread, ordered by seq, carries all of it; posts outside threads fold by themselves.
    """
    low = replies.withColumn("scope", fold_scope(s)).where("scope is not null")
    feed = F.col("scope") == "feed"
    w = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = low.where(~feed)
    n = F.count("*").over(w)
    counts = F.array(*(F.struct(F.lit(c).alias("key"), F.count_if(F.col("class") == c).over(w).alias("value")) for c in ORDER))
    first = F.first(F.struct("id", "handle")).over(w)
    threads = inside.select("*", n.alias("group_size"), first.alias("first"), F.map_from_entries(F.filter(counts, lambda x: x["value"] > 0)).alias("classes"))
    alone = F.map_from_entries(F.array(F.struct(F.col("class").alias("key"), F.lit(1).cast("long").alias("value"))))
    feeds = low.where(feed).select("*", F.lit(1).cast("long").alias("group_size"), F.lit(None).cast(threads.schema["first"].dataType).alias("first"), alone.alias("classes"))
    both, later = threads.unionByName(feeds), F.col("group_size") > 1
    key = F.when(F.col("scope") == "feed", F.concat(F.lit("em:feed:"), "class")).otherwise(F.concat(F.lit("em:"), F.col("thread_id").cast("string"), F.lit(":low")))
    lead = (F.col("scope") == "thread") & ~later & F.lit(s.mode == "fold")
    return both.select(
        "thread_id", "seq", "id", "class", "scope", key.alias("group_key"), "group_size", F.when(later, F.col("first.id")).alias("duplicate_of"),
        F.when(later, F.col("first.handle")).alias("duplicate_of_handle"), lead.alias("representative"), (~lead).alias("folded"), "classes",
        breakdown(F.col("classes")).alias("class_breakdown"), F.when(F.col("scope") == "feed", preview(F.col("text"))).alias("content_preview"),
    )


def class_breakdown(replies: DataFrame) -> DataFrame:
    return replies.where("class is not null").groupBy("thread_id", "class").agg(F.count("*").alias("replies"))


def observed(replies: DataFrame) -> DataFrame:
    """Replies as observations of the recent window, with their normalized text and campaign key: texts are read once."""
    text = F.coalesce("text", F.lit(""))
    return replies.select(
        "place", "seq", "thread_id", F.col("id").cast("long").alias("id"), entry_key(F.col("id"), F.col("handle"), text).alias("key"), F.lit(True).alias("pushes"),
        farm_text(text).alias("normal"), farm_key(text).alias("campaign"),
    )


def beta_candidates(replies: DataFrame, s: Folding = Folding(), stretch: int = STRETCH) -> DataFrame:
    """For each post up to ``candidates`` of those that the recent window holds before it that it may repeat, best first.

    A candidate is similar, or less so in the same thread, or has the same campaign key.  ``place`` (1, 2, ...) counts
    observations; a post seen again counts at its latest one, with the text it then had.
    """

    def judge(rows: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        t = Trigrams(rows["normal"].tolist())
        alike = np.where((t.length[i] == 0) | (t.length[j] == 0), 0, millionths(t.common(i, j), t.smaller(i, j)))
        met = lambda c: (rows[c].to_numpy()[i] == rows[c].to_numpy()[j]) & rows[c].notna().to_numpy()[i]
        thread, campaign = met("thread_id"), met("campaign")
        good = (alike >= round(s.similar * 1e6)) | (thread & (alike >= round(s.similar_in_thread * 1e6))) | campaign
        i, j, alike, thread, campaign = (x[good] for x in (i, j, alike, thread, campaign))
        seq, ids = rows["seq"].to_numpy(), rows["id"].astype("Int64")
        order = np.lexsort((seq[j], -alike, i))
        i, j, alike, thread, campaign = (x[order] for x in (i, j, alike, thread, campaign))
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        out = pd.DataFrame({"seq": seq[i], "candidate": seq[j], "candidate_id": ids.iloc[j].to_numpy(), "similarity": alike / 1e6, "same_thread": thread, "same_campaign": campaign, "rank": rank})
        return out[rank <= s.candidates]

    schema = "seq long, candidate long, candidate_id long, similarity double, same_thread boolean, same_campaign boolean, rank int"
    return over_windows(observed(replies), s.window, kept, judge, schema, stretch)


def asked_references(events: DataFrame, s: Folding = Folding(), stretch: int = STRETCH) -> DataFrame:
    """References of each reply at the moment it is judged: seq, references, median_similarity.

    ``events`` is one log in the order of ``at`` (distinct numbers): kind ``observe`` (seq, id, thread_id, handle, text),
    ``decide`` (seq, band: what became of an observation) and ``ask`` (seq: an observation is judged now).  References are
    the latest others of its thread in the recent window whose band is not known yet or ``ignore``: a band counts from its
    decision on.
    """
    log = numbered(events, "at")
    seen = log.where("kind = 'observe'")
    bands = log.where("kind = 'decide'").groupBy("seq").agg(F.min_by(F.struct(F.col("band"), F.col("place").alias("decided")), "place").alias("d")).select("seq", "d.band", "d.decided")
    pushed = observed(seen.drop("band")).drop("campaign").join(bands, "seq", "left")
    asks = log.where("kind = 'ask'").select("place", "seq").join(pushed.drop("place", "pushes", "band", "decided"), "seq")
    none = {"pushes": F.lit(False), "band": F.lit(None).cast("string"), "decided": F.lit(None).cast("long")}
    # Places count all events; a stretch is as many of them.
    rows = pushed.unionByName(asks.withColumns(none))

    def judge(part: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        place, seq, band, thread = (part[c].to_numpy() for c in ("place", "seq", "band", "thread_id"))
        decided = part["decided"].fillna(np.inf).to_numpy(float)
        asks = ~part["pushes"].to_numpy()
        open_ = (decided[j] > place[i]) | np.isin(band[j], [None, "ignore"]) | part["band"].isna().to_numpy()[j]
        key = part["key"].to_numpy()
        good = asks[i] & (thread[i] == thread[j]) & part["thread_id"].notna().to_numpy()[i] & (seq[i] != seq[j]) & (key[i] != key[j]) & open_
        i, j = i[good], j[good]
        order = np.lexsort((-place[j], i))
        i, j = i[order], j[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < s.most_references
        i, j = i[few], j[few]
        t = Trigrams(part["normal"].tolist())
        alike = np.where((t.length[i] == 0) | (t.length[j] == 0), 0.0, t.common(i, j) / t.smaller(i, j))
        got = pd.DataFrame({"seq": seq[i], "alike": alike}).groupby("seq")["alike"].agg(["size", "median"]).reset_index()
        mine = asks & ~part["lead"].to_numpy()
        out = pd.DataFrame({"seq": seq[mine]}).merge(got, "left", "seq")
        return pd.DataFrame({"seq": out["seq"], "references": out["size"].fillna(0).astype(int), "median_similarity": out["median"].fillna(0.0)})

    found = over_windows(rows, s.window, kept, judge, "seq long, references int, median_similarity double", stretch)
    return found.withColumn("median_similarity", F.round("median_similarity", 6))


def alpha_references(replies: DataFrame, s: Folding = Folding()) -> DataFrame:
    """Number of references and median similarity of each reply to the latest others of its thread that stayed visible.

    A thread's references are its latest ``most_references`` + 1 visible replies, one more than needed as a reply is not
    its own: they are cut out by rank before the join, so a busy thread costs that many pairs a reply and no more.
    """
    rows = replies.where("thread_id is not null").select("thread_id", "seq", "id", "band", farm_text(F.col("text")).alias("normal"))
    latest = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    kept = rows.where("coalesce(band, 'ignore') = 'ignore'").withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= s.most_references + 1)
    x, y = rows.withColumn("grams", shingles(F.col("normal"))).alias("x"), kept.withColumn("grams", shingles(F.col("normal"))).alias("y")
    pairs = x.join(y, (F.col("x.thread_id") == F.col("y.thread_id")) & (F.col("x.seq") != F.col("y.seq")))
    blank = (F.col("x.normal") == "") | (F.col("y.normal") == "")
    alike = F.when(blank, 0.0).otherwise(overlap(F.col("x.grams"), F.col("y.grams")))
    ranked = pairs.groupBy(F.col("x.seq").alias("seq")).agg(F.sort_array(F.collect_list(F.struct(F.col("y.rank").alias("rank"), alike.alias("s")))).alias("all"))
    first = F.transform(F.slice("all", 1, s.most_references), lambda p: p["s"])
    return ranked.select("seq", F.size(first).alias("references"), F.round(median(first), 6).alias("median_similarity"))


def median(values: Column) -> Column:
    """Median of an array; 0 where it is empty."""
    n = F.size(values)
    middle = lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle(F.array_sort(values))).otherwise(0.0)


def plan_calls(replies: DataFrame, candidates: DataFrame, references: DataFrame, s: Folding = Folding()) -> DataFrame:
    """seq, n_candidates, n_references, beta_allowed, alpha_applicable, call, reason: whether a post needs the model at all."""
    counted = candidates.groupBy("seq").agg(F.count("*").cast("int").alias("n"))
    rows = replies.select("seq", "context", "thread_id").join(counted, "seq", "left").join(references.select("seq", "references"), "seq", "left")
    allowed = F.lit(s.beta) & fold_allowed(F.col("context"), s)
    refs = F.coalesce("references", F.lit(0))
    why = F.when(F.lit(not s.alpha), "alpha_disabled").when(F.lit(s.alpha_only_in_replies) & (F.col("context") != "reply"), "not_reply")
    why = why.when(F.col("thread_id").isNull(), "no_thread").when(refs < s.least_references, "not_enough_references")
    rows = rows.select("seq", F.when(allowed, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_candidates"), refs.alias("n_references"), allowed.alias("beta_allowed"), why.isNull().alias("alpha_applicable"))
    call = F.lit(s.enabled) & ((F.col("n_candidates") > 0) | F.col("alpha_applicable"))
    reason = F.when(F.lit(not s.enabled), "semantics_disabled").when(F.lit(not s.beta), "beta_disabled").when(~F.col("beta_allowed"), "beta_fold_disabled").otherwise("no_candidates")
    return rows.withColumn("call", call).withColumn("reason", F.when(~call, reason))


def read_beta(answered: DataFrame, posts: DataFrame, s: Folding = Folding()) -> DataFrame:
    """Groups from the model's answers (seq, candidate, similarity, noul, choice): the earliest confirmed candidate stands for the group.

    ``posts`` (seq, id, text, and handle if it has one) tells verbatim repeats from paraphrases where the model names no
    kind, and who wrote what the group repeats: bare, empty where nobody is known.
    """
    kinds = ("verbatim", "paraphrase", "same_claim", "emotion")
    named = F.lower(F.trim("choice"))
    sure = answered.where(F.col("noul").between(s.confirm, 1.0)).withColumn("named", F.when(named.isin(*kinds), named))
    earliest = F.min_by(F.struct("candidate", "named", F.col("similarity").alias("local")), "candidate")
    groups = sure.groupBy("seq").agg(earliest.alias("e"), (F.count("*") + 1).alias("group_size"), F.round(F.max("noul"), 3).alias("similarity"))
    handle = F.regexp_replace(F.trim(F.coalesce(F.col("handle") if "handle" in posts.columns else F.lit(None).cast("string"), F.lit(""))), "^@", "")
    text = posts.select("seq", "id", handle.alias("handle"), farm_text(F.col("text")).alias("normal"))
    own, other = text.select("seq", F.col("normal").alias("own")), text.select(F.col("seq").alias("candidate"), F.col("id").alias("duplicate_of"), F.col("handle").alias("duplicate_of_handle"), F.col("normal").alias("theirs"))
    rows = groups.select("seq", "e.candidate", "e.named", "e.local", "group_size", "similarity").join(own, "seq").join(other, "candidate")
    told = F.when((F.col("own") != "") & (F.col("own") == F.col("theirs")), "verbatim").when(F.col("local") >= s.paraphrase, "paraphrase").otherwise("same_claim")
    return rows.select(
        "seq", F.col("candidate").alias("representative"), "duplicate_of", "duplicate_of_handle", group_key(F.col("theirs"), F.col("duplicate_of")).alias("group_key"), "group_size", "similarity",
        F.coalesce("named", told).alias("kind"),
    )


def read_alpha(references: DataFrame, s: Folding = Folding()) -> DataFrame:
    """Replies unlike their references (seq, references, median_similarity, majority, contrast) that the model sets apart, with a score."""
    apart = (F.col("references") >= s.least_references) & F.col("majority").between(s.confirm, 1.0) & (F.col("median_similarity") <= s.median) & F.col("contrast").isNotNull()
    return references.where(apart).select("seq", F.round(F.least(F.greatest(F.col("contrast") / 3, F.lit(0.0)), F.lit(1.0)), 3).alias("score"), F.col("references").alias("reference_count"))


def read_both(posts: DataFrame, beta: DataFrame, alpha: DataFrame, local: DataFrame) -> DataFrame:
    """seq, kind, folded, alpha of each post: a mark keeps a group from folding, and a local fold (seq, folded) steps in where there is neither."""
    rows = posts.select("seq").join(beta.select("seq", F.col("kind").alias("beta_kind")), "seq", "left")
    rows = rows.join(alpha.select("seq", F.lit(True).alias("hit")), "seq", "left").join(local.select("seq", F.col("folded").alias("local")), "seq", "left")
    hit = F.coalesce("hit", F.lit(False))
    free = F.col("beta_kind").isNull() & ~hit
    kind = F.when(F.col("beta_kind").isNotNull(), F.col("beta_kind")).when(free & F.col("local").isNotNull(), "emotion")
    folded = F.when(F.col("beta_kind").isNotNull(), ~hit).when(free, F.coalesce("local", F.lit(False))).otherwise(False)
    return rows.select("seq", kind.alias("kind"), folded.alias("folded"), hit.alias("alpha"))


def display_state(band: Column, alpha: Column, emotion: Column, folded: Column) -> Column:
    """What a reader sees; an alpha mark keeps a reply from folding."""
    return F.when(band.isin("hide", "block"), "hidden").when(alpha, "alpha").when(emotion.isNotNull() & ~folded, "emotion").when(folded, "beta_folded").otherwise("plain")
