"""Hosts whose markup names nothing: only how their pages differ tells the article from what stands around it."""

import random

from corpus_fixtures import prose

from millrace.llm.html_text import by_variation, extract_main_text, region

PAGE = "page_id long, url string, html string"


def page(host, k):
    """html and main text; each host has its own order of boxes and classes without meaning."""
    r = random.Random(f"{host}-{k}")
    names = [f"x{host}{c}" for c in "abcdef"]
    article = [("h1", prose(1000 * host + k, 4))] + [(r.choice(["p", "p", "blockquote"]), prose(r.randrange(10**6), r.randint(25, 60))) for _ in range(r.randint(3, 7))]
    items = [prose(r.randrange(10**6), 8) for _ in range(r.randint(2, 4))]
    main = "".join(f"<{t}>{x}</{t}>" for t, x in article) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    top = f"<div class={names[0]}><span>The Daily Page</span><ul><li><a href=/>Start</a></li><li><a href=/n>News</a></li></ul></div>"
    links = f"<div class={names[1]}>" + "".join(f"<div><a href=/{n}>{prose(r.randrange(10**6), 5)}</a></div>" for n in range(5)) + "</div>"
    said = f"<div class={names[2]}>" + "".join(f"<div><b>{prose(r.randrange(10**6), 1)}</b><p>{prose(r.randrange(10**6), 6)}</p></div>" for _ in range(r.choice([0, 0, 1, 3]))) + "</div>"
    legal = f"<div class={names[3]}>All rights reserved<p>Write to us</p></div>"
    boxes = [[top, f"<div class={names[4]}>{main}</div>", links, said, legal], [top, links, f"<div class={names[5]}><div class={names[4]}>{main}</div>{said}</div>", legal]][host % 2]
    return f"<html><body>{''.join(boxes)}</body></html>", "\n".join([*(x for _, x in article), *items])


def f1(got, want):
    from collections import Counter

    a, b = Counter(got.split()), Counter(want.split())
    common = sum((a & b).values())
    return 2 * common / max(1, sum(a.values()) + sum(b.values()))


def test_regions_by_variation(spark):
    pages = {(h, k): page(h, k) for h in range(4) for k in range(20)}
    rows = [(100 * h + k, f"http://h{h}.example.com/{k}", html) for (h, k), (html, _) in pages.items()]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    for (h, k), (_, want) in pages.items():
        assert got[100 * h + k] == want, (h, k)
    # The same pages, each on a host of its own, have nothing to differ from.
    alone = [(i, f"http://alone{i}.example.com/", html) for i, _, html in rows]
    single = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(alone, PAGE)).collect()}
    scores = [f1(single[100 * h + k], want) for (h, k), (_, want) in pages.items()]
    assert max(scores) < 1 and sum(scores) / len(scores) < 0.95


def test_region_stops_where_text_parts():
    assert region({("html", "body", "div[a]", "p"): 60.0, ("html", "body", "div[b]", "p"): 50.0}) == ("html", "body")
    assert region({("html", "body", "div[a]", "p"): 90.0, ("html", "body", "div[a]", "ul", "li"): 30.0, ("html", "body", "div[b]", "p"): 20.0}) == ("html", "body", "div[a]")
    assert region({("p",): 5.0}) == ()


def test_an_optional_box_does_not_lead():
    main, said = ("html", "body", "div[a]", "p"), ("html", "body", "div[b]", "p")
    wrapper = [[main, False, True], [said, True, True]]
    assert by_variation([main, said], wrapper, {main: (1.0, 100.0), said: (0.2, 500.0)}) == [main]
