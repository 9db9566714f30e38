"""What the driver plans for near-duplicates: classes are worked out anew only where links were added."""

from millrace.llm import near_dups


def test_classes_are_worked_out_once_without_new_links(spark, monkeypatch):
    calls, real = [], near_dups.components
    monkeypatch.setattr(near_dups, "components", lambda links: calls.append(1) or real(links))
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " tail"), (3, "lead " + text), (4, " ".join(f"v{i}" for i in range(60))), (5, None)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5} and len(calls) == 1
