"""What is broadcast below a bound and shuffled above it gives the same on both sides."""

import corpus_pipeline
import pytest
from corpus_fixtures import documents, prose, rows

from millrace.llm import html_text, mixing
from test_regions import page


def test_slots_of_a_mix(spark, monkeypatch):
    texts = [(None if n % 3 == 0 else n, prose(n, 3)) for n in range(700)] + [(None, "the same")] * 40
    docs = documents(spark, texts)
    out = []
    for bound in (10**6, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SLOTS", bound)
        got = mixing.mixed(docs, block=4, frame=32).collect()
        assert sorted(r["position"] for r in got) == list(range(740))
        by_slot = {}
        for r in got:
            by_slot.setdefault(r["slot"], set()).add((r["source"], r["block"]))
        assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
        out.append(sorted((r["doc_id"] or -1, r["source"], r["block"], r["slot"], r["position"]) for r in got if r["doc_id"] is not None))
    assert out[0] == out[1]


def test_rows_without_an_id_are_many_buckets(spark):
    docs = documents(spark, [(None, prose(n, 3)) for n in range(900)]).withColumnRenamed("n_chars", "n").drop("n")
    salted = mixing.ranked(docs.withColumn("salt", mixing._salt(docs)), docs["doc_id"], 100, mixing.F.col("salt"))
    assert salted.select("bucket").distinct().count() == 9 and rows(salted.where("source = 's0'"), "rank") == [(n,) for n in sorted(range(300), key=lambda n: repr((n,)))]


def test_hosts(spark, monkeypatch):
    pages = spark.createDataFrame([(100 * h + k, f"http://h{h}.example.com/{k}", page(h, k)[0]) for h in range(2) for k in range(8)], "page_id long, url string, html string")
    out = []
    for bound in (10**6, 0):
        monkeypatch.setattr(html_text, "BROADCAST_HOSTS", bound)
        out.append(rows(html_text.extract_main_text(pages)))
    assert out[0] == out[1] and all(r[2] for r in out[0])


@pytest.mark.parametrize("bound", [10**6, 0])
def test_ids_that_go(spark, monkeypatch, bound):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", bound)
    docs = documents(spark, [prose(1, 40), prose(1, 40), prose(2, 40), (None, prose(1, 40)), (2, prose(1, 40))])
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 1), (False, 3), (True, None)]
