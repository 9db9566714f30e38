"""Spans that the method adds to the rules' own."""

import random

from corpus_fixtures import documents, prose

from millrace.llm.common import id_text
from millrace.llm.pii import KINDS, find_pii, fit_pii, joined, redacted


def card(r):
    d = [r.randrange(10) for _ in range(15)]
    check = -sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10
    return "".join(map(str, [*d, check]))


def test_each_kind_is_added_and_look_alikes_stay(spark):
    r = random.Random(4)
    texts = []
    for k in range(160):
        c = card(r)
        bad = c[:-1] + str((int(c[-1]) + 1) % 10)
        ip = ".".join(str(r.randrange(256)) for _ in range(4))
        texts.append(f"{prose(k, 8)} call +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} {prose(k + 500, 3)} user{k}@mail{k % 7}.example.com {prose(k, 2)} {ip} {prose(k, 1)} {c} {prose(k, 2)}")
        texts.append(f"{prose(k + 900, 6)} {' '.join(bad[i : i + 4] for i in (0, 4, 8, 12))} and 300.{k}.400.2 on 2021-03-0{k % 9 + 1} me@home {prose(k, 4)} no 12 34 56 {prose(k, 2)}")
    c = card(r)
    special = {
        "email": "please write ann [at] mail [dot] example [dot] com about it",
        "ip": "the host 10[.]20[.]30[.]40 is down",
        "card": f"my card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} expired",
        "phone": "call (415) 555-0199 after noon",
    }
    docs = id_text(documents(spark, [*texts, *special.values(), None, ""]))
    out = find_pii(docs, fit_pii(docs))
    got = {x["doc_id"]: x for x in out.select("doc_id", "text", joined(out["base"]).alias("base"), joined(out["all_spans"]).alias("spans"), redacted(out["text"], out["all_spans"]).alias("clean")).collect()}
    first = len(texts) + 1
    for i, kind in enumerate(special):
        row = got[first + i]
        assert row["base"] == "" and [x.split(":")[0] for x in row["spans"].split(",")] == [kind], (kind, row["spans"])
        assert f"<{kind.upper()}>" in row["clean"] and not any(ch.isdigit() for ch in row["clean"])
    assert got[first + 4]["spans"] == got[first + 5]["spans"] == ""
    for k in range(0, len(texts), 2):
        row = got[k + 1]
        assert set(row["base"].split(",")) <= set(row["spans"].split(",")) and len(row["base"].split(",")) == 4
        assert all(f"<{x.upper()}>" in row["clean"] for x in KINDS)
    assert sum(got[k + 2]["spans"] != "" for k in range(0, len(texts), 2)) <= 2
