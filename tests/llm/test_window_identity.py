"""Windows are told apart by all bits of their hash; factors, rows without or with repeated ids, anchors that are everywhere."""

import re

import numpy as np
import pytest
import xxhash
from corpus_fixtures import documents, prose
from test_brute_force import plain_dedup

from millrace.llm import substrings
from millrace.llm import words as W


def test_windows_carry_all_bits_of_their_hash():
    raw = np.frombuffer(prose(1, 60).encode(), np.uint8)
    t = substrings.window_table(raw, np.array([0, len(raw)]), np.array([1]), np.array([0]), 20, 8)
    start, end, _ = W.words(raw, np.array([0, len(raw)]))
    assert (t["w"] == W.windows(W.hashes(raw, start, end), 20)).all()


def test_windows_that_share_the_upper_bits_differ():
    t = {"doc": np.array([1, 2, 3]), "tie": np.zeros(3, np.int64), "start": np.zeros(3, np.int64), "h": np.full(3, 9, np.uint64), "w": np.array([7 << 32 | 1, 7 << 32 | 2, 7 << 32 | 1], np.uint64)}
    order, head, later = substrings._first_of_each(t)
    assert order[later].tolist() == [2]
    found = substrings._factors(t, order, head, later)
    assert (found["doc"].tolist(), found["ref"].tolist(), found["n"].tolist()) == ([3], [1], [1])


def test_factors_point_at_their_reference(spark):
    p = prose(3, 40)
    docs = documents(spark, [f"{prose(1, 7)} {p}", f"{prose(2, 11)} {p} {prose(4, 5)}"])
    got = sorted(map(tuple, substrings.factors(docs).collect()))
    covered = set()
    for doc, start, n, ref, ref_start in got:
        assert (doc, ref, start - ref_start) == (2, 1, 4)
        covered |= set(range(start, start + n))
    assert covered == set(range(11, 51))


def tie(text):
    return xxhash.xxh64((text or "").encode(), seed=42).intdigest() >> 33


def ranked(rows):
    """plain_dedup over rows (id, text) in the order of id, then of the hash of the text; rows that are equal are one."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    out = plain_dedup(dict(enumerate((t or "" for _, t in order))))
    return {r: out[k] for k, r in enumerate(order)}


@pytest.mark.parametrize("hot", [10, 1])
def test_any_ids_and_anchors(spark, monkeypatch, hot):
    """With ``hot`` at 1 every anchor is dealt by window."""
    monkeypatch.setattr(substrings, "hot_anchors", lambda docs, size, gram, f=substrings.hot_anchors: f(docs, size, gram, least=hot))
    p, line = prose(9, 50), prose(8, 12)
    rows = [
        (None, f"{p} {p}"), (None, "a short text without id"), (None, f"{prose(2, 30)} {p}"), (2, f"{p} {prose(5, 25)}"), (2, "a short text"), (2, "a short text"), (3, None), (4, ""), (4, p), (4, p), (5, "x " * 50),
        *[(10 + k, f"{prose(20 + k, 15)} {line} {prose(60 + k, 15)}") for k in range(12)], (40, f"{prose(20, 15)} {line} {prose(60, 15)}"),
    ]
    want = ranked(rows)
    got = substrings.dedup_substrings(documents(spark, rows), texts=True).collect()
    assert len(got) == len(rows)
    left = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert left == sorted((i is not None, i or 0, *want[i, t]) for i, t in rows)
    assert all(r.text == " ".join(re.findall(r"\S+", r.text)) for r in got)
