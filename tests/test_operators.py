from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import farm, gate, prescreen, rates
from millrace.streaming.campaigns import campaign_sessions

ANSWERS = "id long, adult double, solicitation double, deceptive double, severity double, confidence double, category string, junk double, score int, accounts long, farm_hit boolean, handle string"


@pytest.mark.parametrize(
    "row, expected",
    [
        ((0.97, 0, 0, 2.5, 0.9, "adult_porn", None, 3, None), "block"),
        ((0.95, 0, 0, 2.5, 0.4, "adult_porn", None, 0, None), "hide"),
        ((0.85, 0.86, 0, 2.5, 0.96, "adult_solicitation", None, 0, None), "block"),
        ((0.1, 0, 0, 2.5, 0.9, "ordinary", None, 5, None), "ignore"),
        ((0.93, 0, 0, 2.5, 0.6, "other", None, 0, None), "hide"),
        ((0.1, 0, 0, 0.0, 0.0, "other", 0.54, 0, 4), "hide"),
        ((0.1, 0, 0, 0.0, 0.0, "other", 0.05, 0, 2), "ignore"),
        ((0.1, 0, 0, 0.0, 0.35, "scam", None, 0, None), "review"),
        ((0.1, 0, 0, 0.0, 0.0, "other", 0.7, 0, None), "review"),
        ((0.6, 0, 0, 0.0, 0.0, "other", None, 0, None), "review"),
    ],
)
def test_gate(spark, row, expected):
    df = spark.createDataFrame([(1, *map(float, row[:5]), row[5], row[6], row[7], row[8], (row[8] or 0) >= 2, "h")], ANSWERS)
    assert gate.decide(df).first()["band"] == expected


def test_only_block_and_hide_act(spark):
    df = spark.createDataFrame([(b, h) for b in ("block", "hide", "review", "ignore") for h in ("x", "")], "band string, handle string")
    got = {(r["band"], r["handle"]): r["reason"] for r in gate.plan_action(df).collect()}
    assert got["block", "x"] == got["hide", "x"] == "armed" and got["block", ""] == "unknown_handle" and got["review", "x"] == "band_below_block"


def test_prescreen(spark):
    rows = [(1, "alice", "DM for menu"), (2, "alice", "嗯"), (3, "bob", "这里有资源分享"), (4, "bob", "这里有资源分享，还有极品学生妹"), (5, "", ""), (6, "yrmyzhcxvlkzpu", "这里有资源分享"), (7, "c", "a walk in the park today")]
    got = {r["id"]: r for r in prescreen.prescreen(spark.createDataFrame(rows, "id long, handle string, text string")).collect()}
    assert got[1]["candidate"] and got[2]["skip"] == "too_short_no_media" and not got[3]["candidate"] and got[4]["candidate"]
    assert got[5]["skip"] == "no_author" and got[6]["score"] == 2 and got[6]["candidate"] and got[7]["score"] == 0


def test_exact_gap_splits(spark):
    t = datetime(2024, 1, 1)
    rows = [("k", "a", t), ("k", "b", t + timedelta(minutes=29)), ("k", "c", t + timedelta(minutes=59))]
    got = farm.sessions(spark.createDataFrame(rows, "k string, h string, ts timestamp"), "k", "h", "ts").orderBy("session").collect()
    assert [(r["events"], r["accounts"]) for r in got] == [(2, 2), (1, 1)]


def test_near_pairs_against_all_pairs(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat", "an entirely different sentence stands here", "the quick brown fox jumped over a lazy dog"]
    posts = spark.createDataFrame([(i, "h", t, i) for i, t in enumerate(texts)], "id long, handle string, text string, seq long")
    keys = ["".join(c for c in t if c.isalnum()) for t in texts]
    grams = [{k[i : i + 3] for i in range(len(k) - 2)} for k in keys]
    want = {(i, j) for i in range(4) for j in range(i + 1, 4) if len(grams[i] & grams[j]) / min(len(grams[i]), len(grams[j])) >= 0.6}
    assert {(r["a"], r["b"]) for r in farm.near_pairs(posts, 0.6).collect()} == want


def test_admission_is_the_fold(spark):
    t = datetime(2024, 1, 1)
    seconds = [0, 10, 20, 700, 1000, 1010, 5000, 5001, 5002]
    rows = [(i, "u", t + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    recent, want = deque(), []
    for s in seconds:
        while recent and recent[0] <= s - 1000:
            recent.popleft()
        want.append(len(recent) < 2)
        if want[-1]:
            recent.append(s)
    got = rates.admit(spark.createDataFrame(rows, "id long, u string, ts timestamp"), "u", "ts", "id", 2, 1000).orderBy("id").collect()
    assert [r["admitted"] for r in got] == want


def test_stream_equals_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, "a", "the same long text", t), (2, "b", "the same long text!", t + timedelta(minutes=5)), (3, "c", "the same long text", t + timedelta(hours=3)), (4, "z", "closing the windows here", t + timedelta(days=2))]
    batch = spark.createDataFrame(rows, "id long, handle string, text string, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = campaign_sessions(stream).writeStream.outputMode("append").format("memory").queryName("campaigns").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["accounts"], r["posts"]) for r in spark.sql("select * from campaigns where farm_key = 'thesamelongtext'").collect())
    want = sorted((r["accounts"], r["events"]) for r in farm.sessions(batch.withColumn("k", F.lit("k")).where("id < 4"), "k", "handle", "ts").collect())
    assert got == want


def test_every_branch_is_reached(spark):
    import __spark_entry__ as entry

    got = {r["branch"] for r in entry.queries()["gate_grid"](spark, "/root/testdata/sf0.01").select("branch").distinct().collect()}
    assert got == set(range(1, 21))


def test_every_phrase_meets_its_rule(spark):
    from millrace.operators.rules import RULES
    from millrace.schema import PHRASES

    posts = spark.createDataFrame([(i, "h", t) for i, t in enumerate(PHRASES)], "id long, handle string, text string")
    got = {r["id"]: r for r in prescreen.prescreen(posts).collect()}
    assert all(r.id in got[i]["reasons"] for i, r in enumerate(RULES))
    assert got[20]["reasons"] == [] and got[22]["news_context"] and got[22]["score"] == 2 and not got[22]["review_floor"] and got[22]["candidate"]


def test_prescreen_fields(spark):
    rows = [
        (1, "a", "n", "x" * 9, True, "reply"), (2, "ａ", "约炮客服", "a quiet day", False, "timeline"), (3, "me", "n", "http://t.co/a", False, "timeline"), (4, "b", "n", "ＤＭ ｆｏｒ ｍｅｎｕ".lower(), False, "timeline"), (5, "c", "n", "处\U0001f436男在此", False, "timeline"),
    ]
    df = spark.createDataFrame(rows, "id long, handle string, display_name string, text string, is_own boolean, context string").withColumn("has_media", F.col("id") == 3)
    got = {r["id"]: r for r in prescreen.prescreen(df).collect()}
    assert got[1]["skip"] == "own_tweet" and got[2]["strong_name_hit"] and got[2]["name_reasons"] == ["zh_solicit_jiaofu"] and got[3]["short_with_media"]
    assert "en_dm_menu" in got[4]["reasons"] and "zh_solicit_weak_slang" in got[5]["reasons"]


def test_leaders_are_the_fold(spark):
    import random

    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(60)})
    led, near = {}, {i: {a for a, b in pairs if b == i} for i in range(40)}
    for i in range(40):
        led[i] = min((a for a in near[i] if led[a] == a), default=i)
    got = farm.leaders(spark.range(40), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x["id"]: x["leader"] for x in got} == led


def test_clusters(spark):
    texts = ["the very same words again", "the very same words again!", "the very same words, again x", "something else entirely here", "the very same words again"]
    posts = spark.createDataFrame([(i, h, t, i) for i, (t, h) in enumerate(zip(texts, "aabcc"))], "id long, handle string, text string, seq long")
    got = {x["leader"]: x for x in farm.clusters(posts).collect()}
    assert got[0]["accounts"] == 3 and got[0]["posts"] == 4 and len(got[0]["samples"]) == 2 and got[3]["accounts"] == 1
    assert {x["id"]: x["accounts"] for x in farm.near_retro_hits(posts).collect()} == {0: 3, 1: 3, 2: 3, 4: 3}


def test_call_budgets_are_the_fold(spark):
    import random

    rnd, t0 = random.Random(2), datetime(2024, 1, 1)
    seconds = sorted(rnd.randrange(200_000) for _ in range(300))
    kinds = [rnd.choice(["model", "triage", "semantics", "media"]) for _ in seconds]
    limits = {k: rates.Limit(3, 3600) if v.seconds else rates.Limit(9) for k, v in rates.LIMITS.items()}
    taken, want = {k: [] for k in limits}, []
    for s, kind in zip(seconds, kinds):
        def free(c, reserve=0):
            m = limits[c]
            return sum((x > s - m.seconds) if m.seconds else (x // 86400 == s // 86400) for x in taken[c]) < m.most - reserve
        good = all(free(c, rates.RESERVE.get(kind, {}).get(c, 0)) for c in rates.CALLS[kind][0])
        want.append(good)
        if good:
            for c in rates.CALLS[kind][1]:
                taken[c].append(s)
    rows = [(i, "u", k, t0 + timedelta(seconds=s)) for i, (s, k) in enumerate(zip(seconds, kinds))]
    got = rates.admit_calls(spark.createDataFrame(rows, "id long, u string, kind string, ts timestamp"), "u", "ts", "id", "kind", limits).orderBy("id").collect()
    assert [x["admitted"] for x in got] == want


def test_an_automaton_finds_what_grams_find(spark):
    import random

    from millrace.operators.keywords import contains_join

    r = random.Random(4)
    texts = ["".join(r.choice("abc中 ") for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, ""]
    words = ["".join(r.choice("abc中 ") for _ in range(r.choice([1, 2, 5, 9, 12]))) for _ in range(50)] + [None, "zz"]
    for extra in ([], [""]):
        docs, keys = spark.createDataFrame(list(enumerate(texts)) + [(3, "zz")], "doc_id long, t string"), spark.createDataFrame([(i + 100, w) for i, w in enumerate(words + extra)], "item_id int, k string")
        want = {}
        for i, t in [*enumerate(texts), (3, "zz")]:
            hits = [n + 100 for n, w in enumerate(words + extra) if t is not None and w is not None and w in t]
            if hits:
                want[i] = min(*hits, want.get(i, 10**9))
        for chars in (0, 10**6):
            got = contains_join(docs, keys, automaton_chars=chars)
            assert {x["doc_id"]: x["item_id"] for x in got.collect()} == want and got.schema["item_id"].dataType.simpleString() == "int"
    assert contains_join(docs, keys.limit(0)).count() == 0


def test_long_lists_find_short_keywords(spark):
    from millrace.queries.texts import contains_join

    texts = ["a cat sat here", "dog", "the quick brown fox jumps", "", None, "ab"]
    words = ["cat", "dog", "quick brown fox", "jumps", "b", "eight ch", "brown fox is not there"]
    run = lambda w: sorted(map(tuple, contains_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), spark.createDataFrame(list(enumerate(w)), "item_id long, k string")).select("doc_id", "item_id").collect()))
    assert run(words) == [(0, 0), (1, 1), (2, 2), (5, 4)]
    assert {d for d, _ in run([*words, ""])} == {0, 1, 2, 3, 5}


def test_settings():
    from millrace.settings import read_settings

    s = read_settings({"thresholds": {"hide_confidence": 5, "block_confidence": 0.6, "unknown": 1, "block": "x"}, "off": ["scam", "nothing"], "folding": {"mode": "odd", "window": -3}})
    assert s.thresholds.hide_confidence == 0.6 and s.thresholds.block == 0.9 and s.off == ("scam",) and s.folding.mode == "fold" and s.folding.window == 0


def test_phrases_far_from_each_other_in_long_texts(spark):
    """Phrases with ideographs are looked for around ideographs only: what stands between them still counts as far as it did."""
    far = "one two three four. " * 40
    texts = {
        0: (far + "约炮" + far, {"zh_solicit_jiaofu"}), 1: (far + "约 啪" + far, {"zh_solicit_jiaofu"}), 2: (far + "嗯" + far + "代收USDT" + far, {"zh_scam_finance"}), 3: ("玩归玩" + "x" * 16 + "福利给你" + far, {"zh_meme_fuli"}),
        4: ("玩归玩" + "x" * 17 + "福利给你" + far, set()), 5: ("玩归玩" + far + "福利给你", set()), 6: (far + "嗯" + far + "vx: abcd1234", {"zh_contact"}), 7: (far + "微信 : ab1_" + far, {"zh_contact"}), 8: (far + "微信" + far, set()),
        9: ("约" + far + "炮", set()), 10: (far + "come to my nsfw page" + far + "嗯", {"en_nsfw"}), 11: (far, set()),
    }
    rows = spark.createDataFrame([(i, "ann", t) for i, (t, _) in texts.items()], "id long, handle string, text string")
    got = {r["id"]: {h["id"] for h in r["found"]} for r in prescreen.prescreen(rows).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}
    assert all(len(run) <= prescreen.EDGE for r in prescreen.RULES for w in r.literals if prescreen.IDEOGRAPH.search(w) for run in prescreen.IDEOGRAPH.split(w))
