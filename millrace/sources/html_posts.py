"""Post records out of saved timeline pages, and plain records out of any page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Marks of posts, texts, author lines, photos, cards, cells and advertisements in a page, tried in this order.
POST = (("data-testid", "tweet"), ("role", "article"), ("tag", "article"))
TEXT, AUTHOR, PHOTO, CARD = (("data-testid", "tweetText"),), (("data-testid", "User-Name"),), (("data-testid", "tweetPhoto"),), (("data-testid", "card.wrapper"),)
CELL, PROMOTED, SWITCHER = ("data-testid", "cellInnerDiv"), ("data-testid", "placementTracking"), ("data-testid", "SideNav_AccountSwitcher_Button")
QUOTE = (("role", "link"), ("data-testid", "quoteTweet"))
#: Headings and openings that tell replies, suggestions, advertisements and suspected spam, in some languages.
REPLYING = re.compile(r"^(?:replying to|en réponse à|antwort an|en respuesta a|回复|返信先)", re.I)
SUGGESTED = re.compile(r"who to follow|more posts|discover more|suggested|推荐|おすすめ", re.I)
SPAM = re.compile(r"probable spam|likely spam|may contain spam|垃圾", re.I)
ADVERT = re.compile(r"^(?:promoted|ad|推广|プロモーション)$", re.I)
STATUS = re.compile(r"/status/([0-9]{5,25})")
HANDLE, PROFILE = re.compile(r"@([A-Za-z0-9_]{1,15})"), re.compile(r"^(?:https?://(?:www\.)?(?:x|twitter)\.com)?/([A-Za-z0-9_]{1,15})/?$")
MARKS = re.compile("[​-‏‪-‮⁠-⁩﻿]")
SCHEMA = (
    "page_id long, place int, id string, thread_id string, handle string, display_name string, text string, quoted_text string, alt_text string, card_text string, "
    "media array<string>, has_media boolean, context string, promoted boolean, spam_section boolean, is_own boolean, lang string, permalink string"
)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "below")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.below = tag, attrs, parent, [], None

    def all(self) -> list[Node]:
        """All nodes inside, in order; listed once for each node that is asked, so pages must be read to their end before."""
        if self.below is None:
            self.below, open_ = [], [self]
            while open_:
                n = open_.pop()
                self.below.append(n)
                open_ += [c for c in reversed(n.children) if isinstance(c, Node)]
            del self.below[0]
        return self.below

    def is_one(self, marks) -> bool:
        return any(self.tag == v if k == "tag" else self.attrs.get(k) == v for k, v in marks)

    def find(self, marks, outside: Node | None = None) -> list[Node]:
        return [n for n in self.all() if n.is_one(marks) and (outside is None or not n.within(QUOTE, outside))]

    def within(self, marks, top: Node | None = None) -> bool:
        n = self.parent
        while n is not None and n is not top:
            if n.is_one(marks):
                return True
            n = n.parent
        return False

    def text(self) -> str:
        parts = [c.text() if isinstance(c, Node) else c for c in self.children]
        return clean(" ".join(parts) if self.tag in ("div", "article") else "".join(parts))


class Reader(HTMLParser):
    """A page as a tree; end tags close down to their own kind, unknown ones are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", MARKS.sub("", text)).strip()


def _status(post: Node) -> str:
    links = [n.attrs["href"] for n in post.all() if n.tag == "a" and "/status/" in n.attrs.get("href", "")]
    timed = [n.parent.attrs["href"] for n in post.all() if n.tag == "time" and n.parent.tag == "a" and "/status/" in n.parent.attrs.get("href", "")]
    plain = [x for x in links if not re.search(r"/(?:photo|video|analytics)(?:/|$)", x)]
    return (timed or plain or [""])[0]


def _handle(post: Node, status: str) -> str:
    authors = post.find(AUTHOR, post)
    links = [m for a in authors for n in a.all() if n.tag == "a" and (m := PROFILE.match(clean(n.attrs.get("href", ""))))]
    marked = [m for a in authors for n in a.all() if n.attrs.get("tabindex") == "-1" and (m := HANDLE.search(n.text()))]
    named = [m for a in authors if (m := HANDLE.search(a.text()))]
    last = re.match(r"^/([A-Za-z0-9_]{1,15})/status/", status)
    found = [*links[:1], *marked[:1], *named[:1], *([last] if last else [])]
    return found[0][1].lower() if found else ""


def _name(post: Node) -> str:
    for author in post.find(AUTHOR, post)[:1]:
        for n in author.all():
            if n.tag == "a" and n.attrs.get("href") and n.text() and not n.text().startswith("@"):
                return n.text()[:60]
        return clean(re.sub(r"\b\d+[smhd]\b", "", HANDLE.sub("", author.text())))[:60]
    return ""


def _sized(url: str) -> str:
    """Photos of the platform's own store in their small size."""
    if not re.match(r"https?://[^/]*twimg\.com/", url):
        return url
    bare, _, query = url.partition("?")
    kept = [p for p in query.split("&") if p and not p.startswith("name=")]
    return f"{bare}?{'&'.join([*kept, 'name=small'])}"


def _media(post: Node) -> list[str]:
    photos = [i.attrs["src"] for p in post.find(PHOTO, post) for i in ([p] if p.tag == "img" else p.all()) if i.tag == "img" and i.attrs.get("src")]
    posters = [n.attrs["poster"] for n in post.all() if n.tag == "video" and n.attrs.get("poster") and not n.within(QUOTE, post)]
    return list(dict.fromkeys([*map(_sized, photos), *posters]))[:4]


def _alt(post: Node) -> str:
    texts = [clean(n.attrs["alt"]) for n in post.all() if n.tag == "img" and n.attrs.get("alt") and not n.within(QUOTE, post)]
    return " | ".join(t[:200] for t in texts if len(t) >= 4 and not re.fullmatch(r"(?i)image|图像|画像", t))[:400]


def _heading(post: Node) -> str:
    """The nearest heading before a post's cell."""
    cell = post
    while cell.parent is not None and not cell.is_one((CELL,)):
        cell = cell.parent
    while cell.parent is not None:
        before = cell.parent.children[: next(i for i, c in enumerate(cell.parent.children) if c is cell)]
        for n in reversed([c for c in before if isinstance(c, Node)]):
            found = [h for h in (n, *n.all()) if h.tag in ("h1", "h2", "h3") or h.attrs.get("role") == "heading"]
            if found:
                return found[-1].text()
        cell = cell.parent
    return ""


def _context(post: Node, heading: str) -> str:
    if any(REPLYING.match(n.text()) for n in post.all() if n.tag in ("div", "span", "a")):
        return "reply"
    return "recommended" if SUGGESTED.search(heading) else "timeline"


def posts_of(page: str, url: str) -> list[dict]:
    """Every post of a page, in order, without those that lie in others."""
    reader = Reader()
    reader.feed(page)
    root, out = reader.root, []
    found = next((x for mark in POST if (x := [n for n in root.find((mark,)) if not n.within((mark,))])), [])
    own = next((m[1].lower() for n in root.find((SWITCHER,)) if (m := HANDLE.search(n.text()))), "")
    thread = STATUS.search(url or "")
    for place, post in enumerate(found):
        status, heading = _status(post), _heading(post)
        handle, media = _handle(post, status), _media(post)
        texts, quoted = post.find(TEXT, post), [n for n in post.find(TEXT) if n.within(QUOTE, post)]
        cards, number = post.find(CARD, post), STATUS.search(status)
        out.append(
            {
                "place": place, "id": number[1] if number else post.attrs.get("data-id"), "thread_id": thread[1] if thread else None, "handle": handle, "display_name": _name(post),
                "text": texts[0].text() if texts else "", "quoted_text": " ".join(n.text() for n in quoted)[:400], "alt_text": _alt(post), "card_text": cards[0].text()[:300] if cards else "",
                "media": media, "has_media": bool(media), "context": _context(post, heading), "promoted": post.within((PROMOTED,)) or any(ADVERT.match(n.text()) for n in post.all() if n.tag == "span"),
                "spam_section": bool(SPAM.search(heading)), "is_own": bool(own) and handle == own, "lang": texts[0].attrs.get("lang", "") if texts else "", "permalink": status,
            }
        )
    return out


def timeline_posts(pages: DataFrame) -> DataFrame:
    """Posts of pages (page_id, url, html) in the schema of posts.  A page without posts gives no row."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": i} | p for i, u, h in zip(b["page_id"], b["url"], b["html"]) for p in posts_of(h or "", u)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, SCHEMA)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, host, language, title and number of links of each page."""
    return pages.select(
        "page_id",
        F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("host"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        (F.size(F.split("html", r"<a ", -1)) - 1).cast("long").alias("links"),
    )


def status_id(url: Column) -> Column:
    """The numeric id in a post's address; empty where there is none."""
    return F.regexp_extract(url, r"/status/([0-9]{5,25})", 1)
