"""Each operator held against a plain version, an exact round trip or held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import documents, prose, rows
from pyspark.sql import functions as F

import __spark_entry__
from millrace.llm import embedding_dups
from millrace.llm.decontaminate import contaminated
from millrace.llm.mixing import mixed
from millrace.llm.near_dups import near_duplicates
from millrace.llm.substrings import dedup_substrings

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_decontaminate_finds_reparameterised_items_only(spark):
    item = "A farmer sells 12 apples and 30 pears at the market, then 12 more apples, and asks how many fruits were sold"
    changed = item.replace("12", "47").replace("30", "8")
    torn = item.replace("12 apples", "47 apples", 1).replace("30", "8")  # 12 stands for two values
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = contaminated(documents(spark, [f"{prose(1, 50)}. {item}. {prose(2, 50)}", f"{prose(3, 50)}. {changed}.", torn, prose(4, 200)]), bench)
    assert rows(found, "doc_id", "item_id") == [(1, 7), (2, 7)]


def test_decontaminate_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    from millrace.llm import decontaminate

    want = rows(run(spark, "op1_decontaminate"))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert want and rows(run(spark, "op1_decontaminate")) == want


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    for r in run(spark, "op2_token_counts").collect():
        text = docs[r.doc_id].text or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def brute_classes(docs, similarity=0.8):
    """Classes by all pairs that share a shingle, weights 1 + ln count."""
    weight = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
        weight[i] = {g: 1 + np.log(n) for g, n in c.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in docs if weight[i]]
    holders = defaultdict(set)
    for i in ids:
        for g in weight[i]:
            holders[g].add(i)
    for a, b in {(a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b}:
        x, y = weight[a], weight[b]
        j = 0.0
        both = x.keys() & y.keys()
        if len(both) < 0.5 * max(len(x), len(y)):
            continue
        for g in both:
            j += 1 / sum(max(x.get(e, 0) / x[g], y.get(e, 0) / y[g]) for e in x.keys() | y.keys())
        if j >= similarity - 1e-9:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in docs}


def test_near_duplicates_against_all_pairs(spark):
    base = [prose(i, 120) for i in range(12)]
    texts = list(base)
    for i, t in enumerate(base):
        w = t.split()
        for k in range(4):
            w2 = list(w)
            w2[(k * 29 + 7) % 120] = f"new{k}"
            texts.append(" ".join(w2))
        texts.append(" ".join(w[:60]))
    texts += [base[0]] * 30
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_classes(dict(enumerate(texts, 1)))


def test_mix_stays_within_a_block(spark):
    docs = documents(spark, [prose(i, 3) for i in range(900)]).selectExpr("doc_id", "text", "lang", "case when doc_id % 9 < 6 then 'a' when doc_id % 9 < 8 then 'b' end as source", "n_chars")
    out = mixed(docs, {"a": 2.0, "b": 1.0}, block=4, frame=32).collect()
    assert sorted(r.position for r in out) == list(range(900)) and len({r.doc_id for r in out}) == 900
    slots = {}
    for r in out:
        slots[r.slot] = r.source
    share, total = {"a": 2.0, "b": 1.0, None: 1.0}, 4.0
    left = Counter(slots.values())
    done = Counter()
    for k in range(len(slots)):
        done[slots[k]] += 1
        if all(done[s] < left[s] for s in share):  # until a source runs out
            assert all(abs(done[s] - (k + 1) * share[s] / total) < 1 + 1e-9 for s in share)


def test_embeddings_recall(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 24))
    x = np.vstack([base, base + 0.03 * r.standard_normal(base.shape), base[:40] + 0.06 * r.standard_normal((40, 24)), np.repeat(base[:1], 50, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    links = d @ d.T >= 0.95
    np.fill_diagonal(links, False)
    got = {a.vec_id: a.n_links for a in embedding_dups.near_duplicates(df, leaf=32).collect()}
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.9 * links.sum()


def plain_dedup(docs, size=20):
    seen, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    for i in sorted(docs):
        w = words[i]
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[k : k + size]), (i, k)) != (i, k):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_on_the_documents(spark, docs):
    want = plain_dedup({i: r.text for i, r in docs.items()})
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op6_substring_dedup").collect()} == want


def test_substrings_within_and_across(spark):
    p = prose(9, 55)
    texts = [f"{prose(1, 30)} {p} {prose(2, 30)} {p}", f"{p}", f"{prose(3, 10)}\n{p}\t{prose(4, 25)}", "a " * 100, "a " * 19, p[: len(p) // 2]]
    got = {r.doc_id: tuple(r)[1:] for r in dedup_substrings(documents(spark, texts)).collect()}
    assert got == plain_dedup(dict(enumerate(texts, 1)))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PATTERNS = {"email": EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    n = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(n) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(n))) % 10 == 0
    return kind == "email" or 9 <= len(n) <= 15


def test_pii_base_spans(spark, docs):
    kinds = list(PATTERNS)
    for r in run(spark, "op7_pii").collect():
        found = [(m.start(), kinds.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, docs[r.doc_id].text or "") if valid(k, m.group())]
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(f[1] == i for f in found) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_html_leaves_boilerplate_out(spark):
    out = run(spark, "op8_html_text").collect()
    assert sum(bool(r.text) for r in out) >= 0.9 * len(out)
    assert not any(re.search(r"<(p|div|span|script)\b", r.text) for r in out)


@pytest.mark.parametrize("name, label, least", [("op9_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in __spark_entry__.queries()[name](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(out) >= 20 and np.mean([r.predicted == labels[r.doc_id] for r in out]) >= least


def _planted_vectors(n: int, dims: int, dense: int, seed: int = 5) -> np.ndarray:
    """Random vectors, every third followed by a neighbour at a cosine of some 0.93 to 1, and one dense group."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((n, dims)) / np.sqrt(dims) * rng.uniform(0.0, 0.38, (n, 1))
    x[1::3] = x[0::3][: len(x[1::3])] + noise[1::3]
    x[:dense] = x[0] + noise[:dense] * 0.5
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_embeddings_leaves_are_split_by_their_members(spark, monkeypatch):
    """A small sample leaves large leaves: splitting them keeps recall, makes up no link, and counts none twice."""
    x = _planted_vectors(6000, 32, 300)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    sizes, grown = [], embedding_dups._refined

    def refined(leafed, *args):
        out = grown(leafed, *args)
        sizes.append([f.groupBy("leaf").count().agg(F.max("count")).first()[0] for f in (leafed, out)])
        return out

    monkeypatch.setattr(embedding_dups, "_refined", refined)
    for broadcast in (1_000_000, 0):
        monkeypatch.setattr(embedding_dups, "BROADCAST_LEAVES", broadcast)
        got = np.array([r.n_links for r in embedding_dups.near_duplicates(df, leaf=100, sample=64).orderBy("vec_id").collect()])
        assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
        assert (got > 0)[want > 0].mean() >= 0.95
    # The dense group of 300 stays whole with what shares its leaf, as long as it is about half of that leaf.
    assert all(after <= 700 < before for before, after in sizes), sizes


def test_embeddings_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(embedding_dups.SQL).fetchall()
    assert sorted(map(tuple, run(spark, "op5_embedding_near_dedup").select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(want)


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage against the decisions of its operator, recomputed plainly where that is possible."""
    import corpus_pipeline

    frame, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, before, SF)
        seen[name] = (before, frame)
        if name != "mix":
            assert frame.columns == before.columns
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in seen["near_dedup"])
    assert set(after) == {i for i, c in brute_classes(before).items() if i == c}
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in seen["private"])
    assert before.keys() == after.keys() and not any(re.search(EMAIL, t or "") for t in after.values())
    mix = seen["mix"][1].collect()
    assert {r.doc_id for r in mix} == set(after) and sorted(r.position for r in mix) == list(range(len(mix)))
