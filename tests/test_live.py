"""Campaigns as they live, near pairs that meet, and the recent window: all against folds one post at a time."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import folds, live
from millrace.operators.cut import kept
from millrace.operators.overlaps import Trigrams, millionths
from millrace.operators.recent import entry_key, windows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
POSTS = "id long, seq long, handle string, text string, ts timestamp, scope string"


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def similarity(a, b):
    if 2 * min(len(a), len(b)) < max(len(a), len(b)):
        return 0.0
    x, y = grams(a), grams(b)
    return len(x & y) / min(len(x), len(y))


def fold(rows, life):
    """The tracker as a plain list of clusters: (scope, seq) -> leader, likeness, accounts as of the post."""
    out, held = {}, {}
    for scope, at, seq, handle, key in sorted(rows):
        clusters = held.setdefault(scope, [])
        clusters[:] = [c for c in clusters if c["at"] > at - life.micros]
        while life.most is not None and len(clusters) > life.most:
            clusters.pop(0)
        found, likeness = None, 1.0
        for c in clusters:
            s = similarity(key, c["key"])
            if s >= life.similarity:
                found, likeness = c, 1.0 if c["key"] == key else s
                break
        if found is None:
            found = {"key": key, "seq": seq, "handles": set(), "samples": []}
            clusters.append(found)
        found["at"] = at
        found["handles"].add(handle or f"#anon:{len(clusters)}")
        if key not in found["samples"] and len(found["samples"]) < 3:
            found["samples"].append(key)
        out[scope, seq] = (found["seq"], round(likeness, 9), len(clusters), len(found["handles"]), tuple(found["samples"]))
    return out


def timeline(n, seed, minutes, scopes=1, stems=None, few=0.5):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(12, 30))) for _ in range(stems or max(8, n // 12))]
    rows, at = [], 0
    for k in range(n):
        at += r.choice([0, 0, 1, 5, 20, 60, 200, 1800, 1801]) if r.random() < minutes else r.choice([0, 1, 3])
        t = r.choice(stems[: 6 if r.random() < few else len(stems)])
        if r.random() < 0.5:
            p = r.randrange(len(t))
            t = t[:p] + r.choice("0123456789") + t[p:]
        rows.append((k, k, r.choice(["a", "B", "@b", "c", "", None]), t, T0 + timedelta(seconds=at), str(r.randrange(scopes))))
    return rows


def plain(rows, scoped=True):
    return [(s if scoped else "", round((ts - T0).total_seconds() * 1e6) + int(T0.timestamp() * 1e6), seq, (h or "").lower().lstrip("@"), t) for _, seq, h, t, ts, s in rows]


#: More than 300 clusters are alive at times, and gaps of half an hour to the second occur.
FULL = (5000, 1, 0.01, 1, 2500, 0.1)
CASES = [
    (FULL, live.Life()),
    ((900, 2, 0.9, 3), live.Life(chunk=2, replay=1)),
    ((900, 3, 0.5, 1), live.Life(chunk=1, replay=0, most=5)),
    ((600, 4, 0.05, 2), live.Life(chunk=1, replay=0, most=None)),
]


@pytest.mark.parametrize(("case", "life"), CASES)
def test_clusters_are_the_fold(spark, case, life):
    rows = timeline(*case)
    want = fold(plain(rows), life)
    keyed = live.keyed(spark.createDataFrame(rows, POSTS), F.col("scope"))
    members = kept(live.memberships(keyed, life))
    got = {(r["scope"], r["seq"]): (r["leader"], round(r["similarity"], 9), r["alive"]) for r in members.collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    last = {}
    for (scope, _), v in want.items():
        last[scope, v[0]] = (max(v[3], last.get((scope, v[0]), (0,))[0]), v[4])
    shown = {(r["scope"], r["leader"]): (r["accounts"], tuple(x["farm_key"] for x in r["samples"])) for r in live.clusters(live.accounts_of(keyed, members), life).collect()}
    assert shown == last


def test_campaigns_that_overlap_for_ever_are_folded_by_many_tasks(spark, monkeypatch):
    """A campaign of six hours begins every four, so every chunk's start differs: strands are short, rounds are few."""
    texts = ["".join(random.Random(k).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for k in range(16)]
    rows = [(k * 100 + i, k * 100 + i, "ab"[i % 2], t, T0 + timedelta(hours=4 * k, minutes=20 * i), "") for k, t in enumerate(texts) for i in range(18)]
    life, dealt, whole = live.Life(chunk=2, replay=1), [], live._folds

    def seen(given, life):
        own = given.where("phase = 2")
        dealt.append((own.select("scope", "strand").distinct().count(), own.count()))
        return whole(given, life)

    monkeypatch.setattr(live, "_folds", seen)
    keyed = live.keyed(spark.createDataFrame(rows, POSTS))
    got = {r["seq"]: (r["leader"], r["alive"]) for r in live.memberships(keyed, life).collect()}
    assert got == {seq: (v[0], v[2]) for (_, seq), v in fold(plain(rows, False), life).items()}
    assert dealt[1][0] >= 8, "all that differs was one task's"
    assert len(dealt) <= 5


def test_trigrams_of_other_characters_count():
    for a, b in [("abc约炮吗xyz", "abc约炮吗xyq"), ("ab", "ab"), ("ab", "abc"), ("日", "日本"), ("abcdefé1", "abcdefé2"), ("aaaa", "aaa"), ("日本語日本語ab", "日本語ab")]:
        tracker = live.Tracker(live.Life(similarity=0.01))
        tracker.record(0, 1, a)
        want = similarity(a, b)
        assert tracker.record(1, 2, b)[:2] == ((1, want) if want >= 0.01 else (2, 1.0)), (a, b)


def test_the_cap_is_met():
    rows = timeline(*FULL)
    assert max(v[2] for v in fold(plain(rows), live.Life()).values()) > 300, "the first case must evict"


@pytest.mark.parametrize("dense", [0, 4096])
def test_near_runs(spark, dense):
    rows, life = timeline(300, 7, 0.6), live.Life()
    by_key, want = {}, set()
    for _, at, seq, _, key in sorted(plain(rows, False)):
        mine = by_key.setdefault(key, [])
        if mine and at - mine[-1][2] < life.micros:
            mine[-1][2] = at
        else:
            mine.append([seq, at, at])
    flat = [(s, lo, hi, k) for k, v in by_key.items() for s, lo, hi in v]
    for a, lo, hi, k in flat:
        for b, at, _, k2 in flat:
            if k != k2 and (lo, a) < (at, b) and at < hi + life.micros and similarity(k, k2) >= life.similarity:
                want.add((a, b, round(similarity(k, k2), 6)))
    got = live.near_runs(live.keyed(spark.createDataFrame(rows, POSTS)), life, dense)
    assert {(r["a"], r["b"], r["similarity"]) for r in got.collect()} == want and len(want) > 50


@pytest.mark.parametrize("dense", [0, 4096])
def test_retro_hits(spark, dense):
    rows, life = timeline(300, 8, 0.6), live.Life()
    flat = sorted(plain(rows, False))
    folded = fold(flat, life)
    final = {}
    for v in folded.values():
        final[v[0]] = max(v[3], final.get(v[0], 0))
    want = {}
    for n, (_, at, seq, _, _) in enumerate(flat):
        leader, _, _, accounts, samples = folded["", seq]
        if accounts < life.accounts:
            continue
        for _, at2, seq2, _, key2 in flat:
            if at2 <= at < at2 + life.micros and any(similarity(key2, s) >= life.similarity for s in samples):
                want[seq2] = max(final[leader], want.get(seq2, 0))
    keyed = kept(live.keyed(spark.createDataFrame(rows, POSTS)))
    found = live.clusters(live.accounts_of(keyed, live.memberships(keyed, life)), life)
    assert {r["seq"]: r["accounts"] for r in live.retro_hits(keyed, found, life, dense).collect()} == want and len(want) > 50


def test_trigrams_of_any_texts():
    r = random.Random(4)
    texts = ["", "", "a", "b", "ab", "ba", "aa", "中", "中文", "abc", "abcabc", "xyzabc", "a\U0001f600b", "\U0001f600"] + ["".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(40)]
    t = Trigrams(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    own = [grams(x) for x in texts]
    assert t.size.tolist() == [len(x) for x in own]
    i, j = i[i != j], j[i != j]
    assert t.common(i, j).tolist() == [len(own[a] & own[b]) for a, b in zip(i, j)]
    assert millionths(np.array([1, 2, 1, 5]), np.array([3, 3, 128, 5])).tolist() == [333333, 666667, 7813, 1000000]


def lru(events, size):
    """place -> places in the window, for events (place, key, pushes)."""
    held, out = [], {}
    for place, key, pushes in events:
        if pushes:
            held = [x for x in held if x[0] != key] + [(key, place)]
            held = held[-size:]
        out[place] = [p for k, p in held if not (pushes and k == key)]
    return out


@pytest.mark.parametrize(("keys", "size", "stretch"), [(400, 60, 64), (9, 6, 4), (5, 60, 8), (3, 2, 2), (1, 1, 3)])
def test_windows_are_the_fold(spark, keys, size, stretch):
    r = random.Random(keys)
    events, burst = [], 0
    for n in range(300):
        burst = burst - 1 if burst else r.choice([0] * 20 + [40])
        events.append((n + 1, "hot" if burst else str(r.randrange(keys)), r.random() < 0.9))
    got = windows(spark.createDataFrame(events, "place long, key string, pushes boolean"), size, kept, stretch)
    assert {x["place"]: list(x["window"]) for x in got.collect()} == lru(events, size)


def test_entries_without_an_id_are_told_by_author_and_text(spark):
    rows = [(None, "a", "x"), (None, "a", "x"), (None, "b", "x"), (None, None, None), (3, "a", "x"), (3, "q", "other")]
    keys = [x[0] for x in spark.createDataFrame(rows, "id long, handle string, text string").select(entry_key(F.col("id"), F.col("handle"), F.col("text"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 4 and keys[4] == keys[5] and None not in keys


def references_fold(events, s):
    held, out = [], {}
    for kind, seq, id_, thread, text, band in events:
        if kind == "observe":
            held = [x for x in held if x["id"] != id_] + [{"seq": seq, "id": id_, "thread": thread, "text": text, "band": None}]
            held = held[-s.window :]
        elif kind == "decide":
            for x in held:
                if x["seq"] == seq:
                    x["band"] = band
        else:
            refs = [x for x in held if thread is not None and x["thread"] == thread and x["seq"] != seq and x["id"] != id_ and x["band"] in (None, "ignore")][-s.most_references :]
            alike = sorted(0.0 if not text or not x["text"] else similarity_of(text, x["text"]) for x in refs)
            n = len(alike)
            out[seq] = (n, round((alike[(n - 1) // 2] + alike[n // 2]) / 2, 6) if n else 0.0)
    return out


def similarity_of(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / min(len(x), len(y))


def reply_log(n, seed):
    r = random.Random(seed)
    events, posts, waiting = [], [], []
    for seq in range(n):
        id_ = r.choice(posts)[2] if posts and r.random() < 0.2 else 1000 + seq
        p = ("observe", seq, id_, r.choice([1, 2, None]), "".join(r.choice("abcd") for _ in range(r.choice([0, 5, 12]))), None)
        events.append(p)
        posts.append(p)
        waiting.append([r.randint(0, 6), p])
        for w in waiting:
            w[0] -= 1
        for w in [w for w in waiting if w[0] < 0]:
            waiting.remove(w)
            events.append(("ask", *w[1][1:]))
            events.append(("decide", *w[1][1:5], r.choice(["ignore", "hide", "block", "review", "ignore"])))
    return events


LOG = "at long, kind string, seq long, id long, thread_id long, handle string, text string, band string"


@pytest.mark.parametrize("stretch", [16, 2048])
def test_references_change_after_decisions(spark, stretch):
    s = folds.Folding(window=12, most_references=5)
    events = reply_log(150, 5)
    rows = [(7 * n, k, seq, i, t, "h", x, b) for n, (k, seq, i, t, x, b) in enumerate(events)]
    got = folds.asked_references(spark.createDataFrame(rows, LOG), s, stretch)
    want = references_fold(events, s)
    assert {r["seq"]: (r["references"], r["median_similarity"]) for r in got.collect()} == want
    assert want != references_fold([e for e in events if e[0] != "decide"], s)


@pytest.mark.parametrize("stretch", [8, 2048])
def test_beta_candidates_are_the_fold(spark, stretch):
    s, r = folds.Folding(window=7, candidates=3), random.Random(6)
    rows = [(n + 1, 10 * n, r.choice([1, 2, None]), 5 if r.random() < 0.2 else n, "h", "".join(r.choice("abc") for _ in range(r.choice([0, 6, 9])))) for n in range(80)]
    held, want = [], set()
    for place, seq, thread, id_, _, text in rows:
        held = [x for x in held if x[1] != id_]
        found = []
        for cseq, cid, cthread, ctext in held[-(s.window - 1) :]:
            alike = round(similarity_of(text, ctext), 6) if text and ctext else 0.0
            same, campaign = thread is not None and thread == cthread, len(text) >= 8 and text == ctext
            if alike >= s.similar or (same and alike >= s.similar_in_thread) or campaign:
                found.append((-alike, cseq, cid, same, campaign))
        want |= {(seq, c, i, -a, same, campaign, k + 1) for k, (a, c, i, same, campaign) in enumerate(sorted(found)[: s.candidates])}
        held = [*held, (seq, id_, thread, text)][-s.window :]
    df = spark.createDataFrame(rows, "place long, seq long, thread_id long, id long, handle string, text string")
    got = folds.beta_candidates(df, s, stretch).select("seq", "candidate", "candidate_id", "similarity", "same_thread", "same_campaign", "rank").collect()
    assert {tuple(x) for x in got} == want and len(want) > 40
