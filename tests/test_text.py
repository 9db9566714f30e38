import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.emotion import emotion
from millrace.operators.registry import normalize_handle, parse_list, valid_handle


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, given, expected",
    [
        (T.normalize_text, "  A　B  ", "a b"),
        (T.normalize_text, "Only​Fans", "onlyfans"),
        (T.dense_text, "aBc 1!约", "ac1约"),
        (T.farm_text, "ABC-123", "abc123"),
        (T.farm_key, "太好了太好了a", None),
        (T.farm_key, "太好了太好了ab", "太好了太好了ab"),
        (T.farm_key, "hello there\nhello there", "hellothere"),
        (T.repeated_line, "hello there\nhello there", True),
        (T.repeated_line, "short\nshort", False),
        (T.fnv1a, "abc", "1a47e90b"),
        (T.fnv1a, "", "811c9dc5"),
        (T.random_name, "yrmyzhcxvlkzpu", True),
        (T.random_name, "alice", False),
        (normalize_handle, "https://x.com/Spammer/status/1", "spammer"),
        (normalize_handle, "@Spammer", "spammer"),
        (normalize_handle, "x.com/spammer?ref=1", "spammer"),
        (valid_handle, "bad-handle", False),
        (valid_handle, "valid_handle", True),
        (emotion, "haha", "joy"),
        (emotion, "😂😂", "emoji"),
        (emotion, "不同意", "oppose"),
        (emotion, "haha that is because of the weather", None),
    ],
)
def test_scalar(spark, f, given, expected):
    assert one(spark, f, given) == expected


def test_nfkc(spark):
    assert one(spark, lambda c: T.normalize_text(T.nfkc(c)), "ＯＮＬＹＦＡＮＳ") == "onlyfans"


def test_shingles_and_overlap(spark):
    row = spark.sql("select 'abcd' a, 'abce' b").select(T.shingles(F.col("a")).alias("s"), T.overlap(T.shingles(F.col("a")), T.shingles(F.col("b"))).alias("o")).first()
    assert row["s"] == ["abc", "bcd"] and row["o"] == 0.5


def test_import_shapes(spark):
    texts = ['["@A", "b"]', '[{"handle": "C"}]', '{"entries": [{"handle": "https://x.com/d"}]}', "e\nf,bad-one"]
    got = {r["handle"] for r in parse_list(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == set("abcdef")


def test_a_line_mark_at_the_end_goes_too(spark):
    rows = [(i, t + mark) for i, (t, mark) in enumerate((t, m) for t in ("", "ea", "aé—", "约a") for m in "\u2028\u2029\u0085")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", T.dense_text(F.col("t")).alias("d")).collect()
    assert {r["i"]: r["d"] for r in got} == {i: "".join(c for c in t if c in "ea约") for i, t in rows}


def test_a_text_is_made_once_in_each_branch():
    """Nothing within another function's arguments twice: such copies are worked out one by one inside arrays."""
    assert str(T.normalize_nfkc(F.col("t"))).count("lower(") <= 2


def test_white_space_runs(spark):
    texts = ("a b", "a  b", "a\t\tb", "a \n b", "a\nb", "\n a", "é b", "é \t b", "é\u00a0b", "é \u00a0b", "é\u1680\u3000b", "é\u0085b", "é\u2003b", "é\x1cb")
    want = {t: re.sub(r"[\t-\r \u0085\u00a0\u1680\u2003\u3000]+", " ", t).strip(" ") for t in texts}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == want
