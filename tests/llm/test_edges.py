"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from corpus_fixtures import clashing, documents, prose, rows
from pyspark.sql import functions as F

from millrace.llm import embedding_dups
from millrace.llm.decontaminate import contaminated
from millrace.llm.html_text import extract_main_text
from millrace.llm.mixing import mixed
from millrace.llm.near_dups import near_duplicates
from millrace.llm.pii import find_pii, fit_pii, joined
from millrace.llm.quality import fit_quality, score_quality
from millrace.llm.substrings import dedup_substrings
from millrace.llm.token_counts import count_tokens
from millrace.llm.toxicity import fit_toxicity, score_toxicity
from millrace.llm.common import id_text

ITEM = "A farmer sells 12 apples and 30 pears at the market and asks how many fruits were sold"


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def counts(spark, docs):
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def pii(spark, docs):
    d = id_text(docs)
    return find_pii(d, fit_pii(d)).select("doc_id", joined(F.col("all_spans")).alias("spans"))


OPERATORS = {
    "op1": lambda s, d: contaminated(d, bench(s)),
    "op2": counts,
    "op3": lambda s, d: near_duplicates(d),
    "op4": lambda s, d: mixed(d),
    "op6": lambda s, d: dedup_substrings(d),
    "op7": pii,
    "op9": lambda s, d: score_quality(id_text(d), fit_quality(id_text(d), labels(s))),
    "op10": lambda s, d: score_toxicity(id_text(d), fit_toxicity(id_text(d), labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_texts_and_clashing_columns(spark, name):
    long = prose(1, 30_000)
    texts = [None, "", "   \n", "word", prose(2, 60), prose(2, 60), long, long, (5, prose(2, 60)), (None, prose(3, 40)), f"{ITEM}.", "é" * 40_000]
    docs = documents(spark, texts)
    plain = rows(OPERATORS[name](spark, docs))
    assert rows(OPERATORS[name](spark, clashing(docs))) == plain
    if name != "op1":  # which reports hits only
        assert len(plain) == len(texts)
    empty = OPERATORS[name](spark, docs.where("false"))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](spark, docs).columns


def test_unlabelled_table_scores_every_document(spark):
    docs, none = id_text(documents(spark, ["a b", None])), labels(spark).where("false")
    assert score_quality(docs, fit_quality(docs, none)).where("score between 0 and 1").count() == 2
    assert score_toxicity(docs, fit_toxicity(docs, none)).where("score between 0 and 1").count() == 2


def test_embeddings_edges(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 1.0]), (9, [1.0, 0.01]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x"))
    out = {r[0]: tuple(r[1:]) for r in embedding_dups.near_duplicates(df).collect()}
    assert len(out) == 10
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[9] == (2, 1, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))
    assert embedding_dups.near_duplicates(df.where("false")).count() == 0


def test_pages_edges(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>Tom &amp; Ann   went\nhome.</p></article><script>x()</script><footer>Legal</footer></body></html>"
    data = [(1, "http://a.example/1", page), (2, "http://a.example/2", None), (3, None, ""), (4, "no url", "<p>"), (1, "http://a.example/1", page)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("paths", F.lit("x"))
    out = extract_main_text(df).collect()
    assert len(out) == 5
    assert [r.text for r in out if r.page_id == 1] == ["Title\nTom & Ann went home."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in out if r.page_id in (2, 3, 4))
    assert extract_main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_keep_clashing_columns(spark, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    docs = clashing(documents(spark, [None, "", prose(1, 80), prose(1, 80), f"{prose(2, 30)} write to a.b@c.example now", prose(3, 30_000)]))
    out = run(spark, docs, "/root/testdata/sf0.001")
    assert run(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    assert name == "mix" or out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    if name == "private":
        assert len(texts) == 6 and sum("<EMAIL>" in t for t in texts) == 1
    if name == "near_dedup":
        assert len(texts) == 5
