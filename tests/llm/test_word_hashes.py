"""Words and windows that polynomial hashes confuse: Thue-Morse sequences."""

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import documents, prose
from millrace.llm import words as W
from millrace.llm.near_dups import near_duplicates
from millrace.llm.substrings import dedup_substrings
from millrace.llm.token_counts import count_tokens


def thue_morse(n, one="a", two="b"):
    out = one
    flip = str.maketrans({one: two, two: one})
    while len(out) < n:
        out += out.translate(flip)
    return out[:n], out[:n].translate(flip)


def parts(texts):
    raw, at = W.buffers(pa.array(texts))
    return raw, *W.words(raw, at)[:2]


@pytest.mark.parametrize("n", [8, 16, 128, 256, 512, 2048])
def test_words(n):
    raw, start, end = parts([" ".join(thue_morse(n)), "x" * n, "x" * (n - 1)])
    assert len(set(W.hashes(raw, start, end).tolist())) == 4
    assert not W.same(raw, start[:1], end[:1], raw, start[1:2], end[1:2])[0] and W.same(raw, start, end, raw, start, end).all()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    text = prose(5, 400) + " " + "y" * 700
    raw, start, end = parts([text, "zz " + text])
    h = W.hashes(raw, start, end)
    n = len(text.split())
    assert (h[:n] == h[n + 1 :]).all() and len(set(h.tolist())) == len({*text.split(), "zz"})


@pytest.mark.parametrize("size", [1, 2, 5, 8, 16, 20, 31])
def test_windows(size):
    order = np.array([1 if c == "a" else 2 for c in thue_morse(64)[0] + thue_morse(64)[1]], np.uint64)
    h = W.windows(W.mix(order), size)
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(x, tuple(order[i : i + size])) == tuple(order[i : i + size])
    assert len(h) == len(order) - size + 1 and len(seen) == len({tuple(order[i : i + size]) for i in range(len(h))})


def test_operators(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for pair in ("th", "ei", "ab") for t in thue_morse(2048, *pair)]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(documents(spark, texts).coalesce(1), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {i + 1: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}

    around = prose(9, 24).split()
    one, two = (" ".join([*around[:12], w, *around[12:]]) for w in thue_morse(1024))
    removed = {r["doc_id"]: r["n_removed"] for r in dedup_substrings(documents(spark, [one, two])).collect()}
    assert removed == {1: 0, 2: 0}
    pair = [" ".join(thue_morse(1024)[k] for _ in range(8)) for k in (0, 1)]
    assert {r["class_id"] for r in near_duplicates(documents(spark, pair)).collect()} == {1, 2}
