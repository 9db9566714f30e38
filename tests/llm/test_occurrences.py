"""Decontamination judges each occurrence of an item by itself."""

from corpus_fixtures import documents, prose, rows

from millrace.llm.decontaminate import contaminated

ITEM = "A farmer sells 12 apples and 30 pears at the market, then 12 more apples, and asks how many fruits were sold"
TWICE = "On monday the old baker sold 12 loaves of bread before noon and on monday the old baker sold 55 loaves of bread before noon today"
SUMS = "3 7 11 15 19 23 27 31 35 39 43 47"


def found(spark, texts, *items):
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    return rows(contaminated(documents(spark, texts), bench), "doc_id", "item_id")


def test_other_copies_do_not_hide_an_occurrence(spark):
    one, two = ITEM.replace("12", "47").replace("30", "8"), ITEM.replace("12", "5").replace("30", "9")
    torn = ITEM.replace("12 apples", "47 apples", 1)
    texts = [f"{ITEM}. {prose(1, 30)}. {one}", f"{one}. {two}", f"{prose(2, 30)}. {torn}", (None, one), (None, two), (None, prose(5, 90)), TWICE]
    assert found(spark, texts, ITEM, TWICE) == sorted([(1, 1), (2, 1), (None, 1), (7, 2)], key=repr)


def test_items_of_numbers_match_exact_copies_only(spark):
    texts = [f"{prose(1, 20)} {SUMS} {prose(2, 20)}", f"{prose(1, 20)} {SUMS.replace('3', '4')} {prose(2, 20)}", prose(3, 90)]
    assert found(spark, texts, SUMS) == [(1, 1)]


def test_an_edited_copy_is_one_occurrence(spark):
    words = prose(7, 30).split()
    assert found(spark, [" ".join([*words[:12], "put", "in", *words[12:]])], " ".join(words)) == [(1, 1)]
