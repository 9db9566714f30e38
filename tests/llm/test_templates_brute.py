"""Benchmark decontamination against a plain search: every item held against every document, window by window."""

import random

import pytest
import regex
from corpus_fixtures import documents

from millrace.llm import decontaminate as D

NUMBER = r"\d(?<![\p{L}\p{N}]\d)\d*(?:[.,:/]\d+)*"
QUANTITY = rf"({NUMBER})[  ]?({D.UNITS})(?![\p{{L}}\p{{N}}])"
NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{Ll}'’-]+(?![\p{L}\p{N}])"


def tokens(text):
    """(word or slot, value) of a text."""
    marked = regex.sub(f"({NAME})", lambda m: f" \x01p{m[1]} ", text)
    marked = regex.sub(QUANTITY, lambda m: f" \x01n{m[1]} \x01u{m[2]} ", marked)
    marked = regex.sub(rf"(?<![\x01\w.,:/])({NUMBER})", lambda m: f" \x01n{m[1]} ", marked)
    out = []
    for w in regex.split(r"(?:[^\p{L}\p{N}\x01.,:/]|[.,:/](?!\d)|(?<!\d)[.,:/])+", marked.lower()):
        if w:
            out.append((w[:2], w) if w.startswith("\x01") else (w, w))
    return out


def heavy(window):
    return sum(not w.startswith("\x01") for w, _ in window) < max(2, len(window) // 2)


def occurrences(doc, item, size):
    """(at, offset, slot pairs) of every place where a window of the item stands in the document."""
    for at in range(len(item) - size + 1):
        own = item[at : at + size]
        for pos in range(len(doc) - size + 1):
            theirs = doc[pos : pos + size]
            met = [v for _, v in own] == [v for _, v in theirs] if heavy(own) else [w for w, _ in own] == [w for w, _ in theirs]
            if met and (not heavy(own) or heavy(theirs)):
                yield at, pos - at, {(a[1], b[1]) for a, b in zip(own, theirs) if a[0].startswith("\x01")}, heavy(own)


def contaminated(doc, item):
    item, doc = tokens(item), tokens(doc)
    if len(item) < D.LEAST:
        return False
    size = min(len(item), D.WINDOW)
    starts = range(len(item) - size + 1)
    of = sum(not heavy(item[a : a + size]) for a in starts)
    found = list(occurrences(doc, item, size))
    ways = [(of, [f[:3] for f in found if not f[3]])]
    if len(starts) > of:
        ways.append((len(starts), [f[:3] for f in found]))
    for total, hits in ways:
        if not total or not hits:
            continue
        offsets = sorted({o for _, o, _ in hits})
        runs, run = [], []
        for o in offsets:
            if run and o - run[-1] > D.SHIFT:
                runs.append(run)
                run = []
            run.append(o)
        for group in [*([o] for o in offsets), *runs, run, offsets]:
            mine = [(a, s) for a, o, s in hits if o in group]
            slots = set().union(*(s for _, s in mine))
            if len({a for a, _ in mine}) / total >= D.COVERAGE and len({k for k, _ in slots}) == len(slots):
                return True
    return False


def corpus(seed):
    r = random.Random(seed)
    words = "the a train leaves from station with people and each of them buys some apples for money how many are left when it stops there".split()
    names = ["Anna", "Bert", "Carl", "Dora"]

    def sentence(n):
        out = [r.choice(words)]
        for _ in range(n):
            x = r.random()
            out.append(f"{r.randint(1, 99)} {r.choice(['km', 'hours', 'apples'])}" if x < 0.12 else r.choice(names) if x < 0.2 else r.choice(words))
        return " ".join(out)

    items = [sentence(r.choice([2, 3, 6, 9, 14, 20])) for _ in range(14)] + ["3 + 4 = 7, 8 + 9 = 17, 2 + 5 = 7", "", "one two", None]

    def changed(t):
        other = {n: r.choice(names) for n in names}
        t = regex.sub(r"\d+", lambda m: str(r.randint(1, 99)), t) if r.random() < 0.5 else t
        t = regex.sub("|".join(names), lambda m: other[m[0]], t)
        w = t.split()
        if len(w) > 4 and r.random() < 0.4:
            w.insert(r.randrange(len(w)), r.choice(words))
        return " ".join(w[: r.choice([len(w), max(2, len(w) // 2)])])

    docs = []
    for _ in range(60):
        parts = [sentence(r.randint(3, 12))]
        for _ in range(r.choice([0, 1, 1, 2])):
            parts += [r.choice([changed, str])(r.choice(items[:15])), sentence(r.randint(1, 8))]
        docs.append(", ".join(parts))
    return [*docs, None, ""], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bound", [10**6, 0])
def test_every_item_against_every_document(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", bound)
    docs, items = corpus(seed)
    want = {(i + 1, k) for i, d in enumerate(docs) for k, t in enumerate(items) if contaminated(d or "", t or "")}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, docs), bench).collect()}
    assert got == want and len(want) > 25
