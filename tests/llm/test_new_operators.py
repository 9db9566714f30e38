"""The filter audit, virtual slots and the bit-sliced index against brute force, with their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from corpus_fixtures import clashing, documents, prose, rows
from millrace.llm import filter_audit as A
from millrace.llm import lexical as L
from millrace.llm import sharding as S

LABELS = "doc_id long, quality int, toxic int"


def noisy(seed, n):
    r = random.Random(seed)
    words = [w.upper() if r.random() < 0.1 else w for w in prose(seed, max(1, n // 8)).split()]
    return r.choice([" ", "\t", "\n\r"]).join(r.choice(words) for _ in range(n)) + r.choice(["", "", " #", " 5%"])


def audit_brute(docs, labels):
    texts = [(i, lang or "", t or "") for i, t, lang in docs]
    least = {}
    for i, _, t in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))

    def failing(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }

    flagged = [(part, i, {k for k, v in failing(i, t).items() if v}) for i, part, t in texts]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in flagged}:
        own = [(i, f) for p, i, f in flagged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in own)
                out[part, order, k + 1] = (len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                shapley[part, f] += len(gone)
    return sorted(((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()), key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("bound", [0, 1000])
def test_audit(spark, bound):
    r = random.Random(3)
    texts = [noisy(s, r.choice([5, 150, 210, 260])) for s in range(40)]
    docs = [(n, texts[r.randrange(40)] if r.random() < 0.9 else None, r.choice(["en", "de", None])) for n in range(90)]
    docs += [(5, docs[5][1], "en"), (None, texts[0], "en"), (None, None, "de"), (200, "", "fr"), (201, "\t \n", "fr")]
    labels = [(n, n % 2, int(n % 5 == 0)) for n in range(0, 90, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows_ = A.flagged(df, spark.createDataFrame(labels, LABELS), broadcast_rows=bound)
    assert rows(A.audit(rows_, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"}), *AUDIT) == audit_brute(docs, labels)


def test_audit_walks_each_state_once(spark):
    df = spark.createDataFrame([("x", True, False, True)] * 3 + [("y", False, False, False)], "part string, A boolean, B boolean, C boolean")
    found = A.edges(df, "ABC", [])
    assert sorted(found.select("part", "state", "filter").distinct().count() for _ in "1") == [found.count()]
    assert {r["state"] for r in found.where("part = 'y'").collect()} == {"", "A", "B", "C", "AB", "AC", "BC"}
    assert A.audit(df.limit(0), "ABC", {}).count() == 0


def shard_rows(df):
    return [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["virtual_slot"]) for r in df.collect()]


def test_shards(spark):
    texts = [prose(n, 1 + n % 50) for n in range(400)] + [None, "", prose(999, 20000)] + [(None, prose(n, 30)) for n in range(20)] + [(7, "the same row again " * 20)] * 300
    docs = documents(spark, texts)
    got = shard_rows(S.shard(clashing(docs).repartition(5), shards=6, slots=512))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter(g[:3] for g in got) == want
    by_shard, size = defaultdict(list), Counter()
    for _, n, _, s, k, _ in got:
        by_shard[s].append(k)
        size[s] += n
    assert set(by_shard) == set(range(6)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    # A record's virtual slot rests on the record alone, and only rows of one large slot are dealt to several shards.
    slots = defaultdict(set)
    for d, _, c, _, _, v in got:
        slots[d, c].add(v)
    assert all(len(v) == 1 for v in slots.values())
    assert len({g[3] for g in got if g[0] == 7 and g[2] == zlib.crc32(b"the same row again " * 20)}) > 1
    # No shard holds more than its share but by the largest text.
    largest = max(n for _, n, _ in want)
    assert max(size.values()) <= sum(size.values()) / 6 + largest
    small = {s for s in size if not any(g[3] == s and g[1] == largest for g in got)}
    assert max(size[s] for s in small) <= 1.05 * min(size[s] for s in small)


def test_an_empty_table_has_no_shards(spark):
    assert S.shard(documents(spark, []), shards=6).count() == 0


def test_rebalancing_moves_few_slots(spark, tmp_path):
    r = random.Random(1)
    loads = {(s, 0): r.randint(50, 150) for s in range(1000)}
    first = S.packed(loads, 8)
    assert S.rebalanced(first, loads, 8) == {}
    grown = S.rebalanced(first, loads, 9)
    assert set(grown.values()) == {8}, "a new shard only takes slots"
    size = S.shard_bytes(first | grown, loads)
    share = sum(loads.values()) / 9
    assert max(size.values()) - min(size.values()) <= 0.02 * share + 150 and len(grown) <= 1.2 * 1000 / 9
    heavier = loads | {p: 3 * n for p, n in loads.items() if first[p] == 2}
    moved = S.rebalanced(first, heavier, 8)
    assert {first[p] for p in moved} == {2} and len(moved) < 125
    fewer = S.rebalanced(first, loads, 7)
    assert {p for p in first if first[p] == 7} <= set(fewer) and 7 not in (first | fewer).values()
    path = str(tmp_path / "map")
    S.write_map(spark, path, 1, first, loads)
    S.write_map(spark, path, 2, grown, loads)
    read = lambda v: {(x["slot"], x["piece"]): x["shard"] for x in S.read_map(spark, path, v).collect()}
    assert read(1) == first and read(2) == read(None) == first | grown
    assert spark.read.parquet(f"{path}/version=2").count() == len(grown)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        S.write_map(spark, path, 2, {}, loads)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search_brute(docs, items, k=20):
    docs = [(i, terms_of(t)) for i, t in docs]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, length, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms_of(t))
    out = []
    for item, q in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [*prose(seed, 80).split(), "Ünïcode", "ünïcode", "中文", "x1", "É", "é", "a", "A"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [r.choice([" ", "-", ". "]).join(r.choices(vocabulary, weights, k=r.choice([1, 3, 20, 60]))) for _ in range(n)], vocabulary


@pytest.mark.parametrize(("block", "group_rows"), [(4096, 1_000_000), (64, 1_000_000), (70, 40)])
def test_search(spark, block, group_rows):
    texts, vocabulary = corpus(11, 300)
    docs = [(n * 7 % 1009, t) for n, t in enumerate(texts)] + [(500, None), (501, ""), (502, "#!"), (None, texts[0]), (None, texts[1]), (3, texts[3]), (3, texts[3]), (-9, texts[5])]
    r = random.Random(2)
    items = [(n, " ".join(r.choices(vocabulary, k=r.choice([1, 4, 30])))) for n in range(30)] + [(30, None), (31, "nosuchterm"), (32, " ".join(["a"] * 37 + vocabulary[:3] * 5)), (None, vocabulary[0]), (4, "x1")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = L.ranked(clashing(df).repartition(3), clashing(asked), block=block, group_rows=group_rows)
    assert rows(got, "item_id", "rank", "doc_id", "score") == search_brute(docs, items)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.ranked(none, items).count() == 0 and L.ranked(some, items.limit(0)).count() == 0


def test_slices_add_up_and_rank():
    r = np.random.default_rng(5)
    size, terms = 200, {}
    impact = {t: np.where(r.random(size) < 0.4, r.integers(0, 1 << int(r.integers(1, 30)), size), 0) for t in range(12)}
    for t, v in impact.items():
        for k, at, own in L.slices(np.full(size, t), np.arange(size), v):
            terms[k] = at, own
    queries = [[(t, int(r.integers(1, 9))) for t in r.permutation(list(terms))[: 12 - q]] for q in range(9)]
    for q, (place, score) in zip(queries, L.best(L.add_up(terms, queries, size), 20)):
        total = sum(n * impact[t] for t, n in q)
        want = sorted(((-int(s), i) for i, s in enumerate(total) if s > 0))[:20]
        assert sorted(zip((-score).tolist(), place.tolist())) == want


def test_equal_hashes_of_terms_are_told_apart(monkeypatch):
    import pyarrow as pa
    from millrace.llm import words as W

    monkeypatch.setattr(W, "hashes", lambda raw, start, end: np.zeros(len(start), np.uint64))
    v = L.Vocabulary(["a", "bc", "d"])
    raw, at = W.buffers(pa.array(["d bc e a"]))
    assert v.find(raw, *W.words(raw, at, L._BETWEEN)[:2]).tolist() == [2, 1, -1, 0]
