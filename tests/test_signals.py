from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import emotion, folds, media, registry, routing


def test_emotion(spark):
    rows = [("哈哈哈", "joy"), ("同意", "support"), ("不同意", "oppose"), ("111", "support"), ("12", None), ("", None), (None, None), ("😂😂", "emoji"), ("I agree because of the data", None), ("really very nice!", "praise"), ("this is so beautiful and great", "praise"), ("a long walk by the sea", None)]
    got = spark.createDataFrame(rows, "text string, want string").withColumn("got", emotion.emotion(F.col("text"))).collect()
    assert [(r["text"], r["got"]) for r in got] == rows


def test_images(spark):
    def image(i, colour, noisy):
        return [(i, 8, 8, x, y, *(min(255, c + (40 if noisy and (x + y) % 2 else 0)) for c in colour)) for x in range(8) for y in range(8)]

    pixels = spark.createDataFrame(image(1, (200, 140, 110), False) + image(2, (200, 140, 110), True) + image(3, (20, 40, 200), True), "image_id long, width int, height int, x int, y int, r int, g int, b int")
    got = {r["image_id"]: r for r in media.verdict(media.image_stats(pixels)).collect()}
    assert got[1]["verdict"] == "flat" and got[2]["verdict"] == "blocked" and got[3]["verdict"] == "clear" and got[1]["texture"] == 0 and got[2]["texture"] == 1 and got[2]["flat_ratio"] == 0.5


def test_best_image_and_vision(spark):
    judged = spark.createDataFrame([(1, 0, 0.8, "blocked"), (1, 1, 0.9, "clear"), (2, 0, 0.1, "clear"), (2, 1, 0.3, "clear"), (2, 2, 0.9, "clear")], "post_id long, position int, skin_ratio double, verdict string")
    assert {r["post_id"]: r["position"] for r in media.best_image(judged).collect()} == {1: 0, 2: 1}
    replies = ['{"adult": true, "confidence": 0.9}', 'Sure:\n```json\n{"adult": false, "confidence": 0.8}\n```', "no idea", None, '{"adult": true}']
    got = spark.createDataFrame([(r,) for r in replies], "raw string").select(F.round(media.vision_answer(F.col("raw")), 6).alias("p")).collect()
    assert [r["p"] for r in got] == [0.9, 0.2, None, None, 0.5]


def test_cache_is_the_fold(spark):
    t, seconds = datetime(2024, 1, 1), [0, 5, 99, 100, 150, 199, 200, 500]
    last, want = None, []
    for s in seconds:
        hit = last is not None and s - last <= 100  # a decision answers up to its last second
        want.append(hit)
        last = last if hit else s
    rows = [(i, "k", t + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    got = routing.cached(spark.createDataFrame(rows, "id long, k string, ts timestamp"), "k", "ts", "id", 100).orderBy("id").collect()
    assert [r["hit"] for r in got] == want


def test_lists(spark, tmp_path):
    texts = ['["@Ann", {"handle": "bob"}]', '{"handles": ["cy", {"handle": "https://x.com/Dee/status/1"}]}', '{"entries": [{"handle": "eve"}]}', '{"fay": {"why": "x"}, "gus": 1}', "# remark\n@hal said so\nbad-name!,ida", '{"handle": "jo"}', "", None]
    got = registry.parse_list(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r["handle"] for r in got.collect()} == {"ann", "bob", "cy", "dee", "eve", "fay", "gus", "hal", "ida", "jo"}
    registry.export_list(got, str(tmp_path / "list"))
    back = registry.import_list(spark, str(tmp_path / "list"))
    assert back.count() == 10 and registry.remove(back, spark.createDataFrame([("@Ann",)], "handle string")).count() == 9


def test_states(spark):
    rows = [("hide", True, "joy", True, "hidden"), ("ignore", True, "joy", True, "alpha"), ("ignore", False, "joy", True, "beta_folded"), ("ignore", False, "joy", False, "emotion"), ("review", False, None, False, "plain")]
    df = spark.createDataFrame(rows, "band string, alpha boolean, emotion string, folded boolean, want string")
    assert df.where(folds.display_state(*map(F.col, df.columns[:4])) != F.col("want")).count() == 0
    refs = spark.createDataFrame([(1, 3, 0.2, 0.9, 2.4), (2, 3, 0.6, 0.9, 3.0), (3, 3, 0.1, 0.5, 3.0), (4, 3, 0.1, 0.8, None), (5, 2, 0.1, 0.8, 3.0)], "seq long, references int, median_similarity double, majority double, contrast double")
    assert [(r["seq"], r["score"]) for r in folds.read_alpha(refs).collect()] == [(1, 0.8)]


def test_nfkc_in_every_normalizer(spark):
    from millrace.functions import text as T

    rows = [("  约　啪  ",), ("Only\u200bFans",), ("ＯＮＬＹＦＡＮＳ",), ("½ ﬁt A",)]
    got = spark.createDataFrame(rows, "t string").select(T.normalize_text(F.col("t")), T.farm_text(F.col("t")), T.feeling_text(F.col("t")), T.dense_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["约 啪", "onlyfans", "onlyfans", "1⁄2 fit a"] and [r[1] for r in got][2:] == ["onlyfans", "12fita"] and got[2][2] == "onlyfans" and got[3][3] == "12fit"


def test_lines_and_labels(spark):
    from millrace.functions import text as T
    from millrace.operators import menus

    df = spark.createDataFrame([("One line here!\nTwo；three\nＯＮＥ ＬＩＮＥ ＨＥＲＥ",)], "t string")
    assert df.select(T.lines(F.col("t"))).first()[0] == ["onelinehere", "two", "three", "onelinehere"] and df.select(T.repeated_line(F.col("t"))).first()[0]
    assert df.select(T.collapse_runs(F.lit("aaaabbc"))).first()[0] == "aabbc"
    assert df.select(menus.menu_action(F.lit("\u202aUnblock @x\u202c"))).first()[0] is None


def test_images_are_decoded(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    from millrace.sources.images import decode, read_images

    px = np.random.default_rng(1).integers(0, 255, (70, 90, 3), dtype=np.uint8)

    def png(filters):
        raw, last = b"", np.zeros(270, np.uint8)
        for y, row in enumerate(px.reshape(70, 270)):
            kind = filters[y % len(filters)]
            left = np.concatenate([np.zeros(3, np.uint8), row[:-3]])
            guess = {0: 0 * row, 1: left, 2: last, 3: ((left.astype(int) + last) // 2).astype(np.uint8)}[kind]
            raw, last = raw + bytes([kind]) + (row - guess).astype(np.uint8).tobytes(), row
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 90, 70, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    assert (decode(png([0, 1, 2, 3])) == px).all() and decode(b"nothing") is None and decode(png([0])[:80]) is None
    (tmp_path / "a.png").write_bytes(png([1]))
    (tmp_path / "b.ppm").write_bytes(b"P6\n90 70\n255\n" + px.tobytes())
    got = read_images(spark, str(tmp_path)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("r").alias("r")).collect()
    assert len(got) == 2 and len({(r["n"], r["r"]) for r in got}) == 1 and got[0]["n"] == 64 * 50


def test_several_logs_are_one_tail(spark):
    from millrace.operators import report

    logs = [spark.createDataFrame([(n, f"log{k}") for n in range(lo, hi)], "seq long, of string") for k, (lo, hi) in enumerate([(0, 40), (30, 60), (55, 58)])]
    got = report.retained(logs, "seq", 25).collect()
    assert sorted(r["seq"] for r in got) == list(range(35, 60))
    assert sorted(r["seq"] for r in report.retained(logs[:1], "seq", 3).collect()) == [37, 38, 39] and report.retained([logs[0].limit(0), logs[1].limit(0)], "seq").count() == 0


def test_who_wrote_what_a_group_repeats(spark):
    answered = spark.createDataFrame([(3, 1, 0.9, 0.9, None), (3, 2, 0.5, 0.95, "verbatim"), (4, 2, 0.5, 0.8, None), (5, 3, 0.5, 0.1, None)], "seq long, candidate long, similarity double, noul double, choice string")
    posts = spark.createDataFrame([(1, 11, "@ann", "a text"), (2, 12, None, "b text"), (3, 13, "cy", "a  text"), (4, 14, "d", "z"), (5, 15, "e", "q")], "seq long, id long, handle string, text string")
    got = {r["seq"]: (r["duplicate_of"], r["duplicate_of_handle"], r["kind"], r["group_size"]) for r in folds.read_beta(answered, posts).collect()}
    assert got == {3: (11, "ann", "verbatim", 3), 4: (12, "", "same_claim", 2)}
