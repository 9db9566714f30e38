"""HTML extraction (operator 8): wrappers by union-free regular-expression inference over the pages of a host.

A page is a stream of tags and text slots.  Within a page, equal neighbouring stretches fold into repeated groups, so
a page with three paragraphs and one with thirty have the same shape.  The distinct shapes of a host are then aligned
one after the other: where two streams part, the stretch that only one has becomes an optional group, and a text that
differs becomes a slot.  The outcome is one union-free expression (sequence, optional, repeat, slot) per host: its
wrapper.  Texts take part as well: a text that stands at the same place on nearly all distinct pages of a host is
fixed, a part of the template, and all others fill slots.  Pages count as one where their longest text is the same, so
copies of an article don't make its text fixed, and a page that would be left without any text keeps what it has.

A slot belongs to the main text when its ancestors and their attributes are not those of menus, headers,
footers, sidebars, notices, adverts, forms or comments, and, where a host has an article-like container, when it lies
inside it.  Where a host's markup names no such container, the wrapper decides by how its pages differ: slots that stand
on most pages and are not optional, weighed by the varying text that fills them, show the element that holds most of it;
what lies outside that element, in other elements of its own, is not main text, whatever its name.

Shapes are counted in Spark before they are aligned, and a host's shapes are aligned in groups of at most ``GROUP``
whose wrappers are aligned again, so a host with a third of all pages costs no more than its distinct shapes.

Results: one row per row of the table.  A null html, or one without main text, gives an empty string; urls without a
host share one wrapper; rows that repeat stay repeated; other columns are not read; whole pages are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small, stored, table

GROUP = 64
#: A text is fixed when so many distinct pages of a host have it at one place, and this share of all of them.
LEAST_PAGES, FIXED = 5, 0.9
#: Where nothing is named: the share of its varying text that leads into an element, the share of pages that an optional slot
#: must be on to lead, what a box beside the text must have of it, and which elements are boxes.
MOST, OFTEN, FAIR = 0.6, 0.6, 0.2
BOXES = frozenset("div section table center".split())
#: Wrappers of up to so many hosts (a few kB each) are broadcast to the pages; those of more hosts meet them by a shuffle.
BROADCAST_HOSTS = 20_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are no part of an article, and words in classes, ids and roles that say the same.
OUTSIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|"
    r"footer|foot|header|masthead|topbar|toolbar|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|social|comments?|"
    r"commentlist|replies|reply|respond|disqus|complementary|contentinfo|alert|tags|pagination|pager|skip)(?:$|[\s_-])"
)
MAIN_TAGS = ("article", "main")
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:[_-]?(?:body|content|text))?(?:$|[\s_-])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Opening one of these ends an open one of the other kinds that HTML lets go without an end tag.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol dl article section div body".split())


@lru_cache(4096)
def label(tag: str, attributes: str) -> str:
    """A tag with what its class, id, role and visibility say; numbers are left out, so pages compare."""
    if not attributes or attributes.isspace():
        return tag
    found = {m[0].lower(): next((x for x in m[1:] if x), "") for m in ATTRIBUTE.findall(attributes)}
    words = " ".join(WHITE.sub(" ", re.sub(r"\d+", "", found.get(k, ""))).strip().lower() for k in ("class", "id", "role"))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", ""))
    words = WHITE.sub(" ", words).strip()
    return tag + (f"[{words}]" if words else "") + ("!" if hidden else "")


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """Path of labels and text of each block of a page, in order; scripts, styles, comments and markup are gone."""
    stack: list[str] = []
    names: list[str] = []
    out: list[tuple[tuple[str, ...], str]] = []
    text: list[str] = []
    where: tuple[str, ...] = ()

    def flush() -> None:
        joined = WHITE.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append((where, joined))
        text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            if not text or not "".join(text).strip():
                where = tuple(s for s, t in zip(stack, names) if t not in INLINE or s != t)
            text.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text.append(entities.unescape(m[0][9:-3]).replace("&", "&amp;"))
            continue
        if m[1]:
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag not in INLINE or any(x not in INLINE for x in names[k:]):
                    flush()
                del names[k:], stack[k:]
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            # Inline elements don't outlive the block that they stand in; list items and the like end their equals.
            while names and names[-1] in INLINE:
                names.pop(), stack.pop()
            if tag in BLOCKS_END_P and "p" in names and not any(x in SCOPES for x in names[len(names) - names[::-1].index("p") :]):
                k = len(names) - 1 - names[::-1].index("p")
                del names[k:], stack[k:]
            for k in range(len(names) - 1, -1, -1):
                if names[k] in CLOSES.get(tag, ()):
                    del names[k:], stack[k:]
                    break
                if names[k] in SCOPES:
                    break
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in ("p", "div", "span", "a"):
            continue
        names.append(tag)
        stack.append(label(tag, m[3]))
    flush()
    return out


# A wrapper is a list of items: (path, optional, repeated).  A path names the slot's place; folding makes neighbours
# with one path a repeated slot, and longer repeats (rows of a table, entries of a list) share the paths of their slots.


def fold(paths: list[tuple[str, ...]]) -> list[list]:
    """The shape of one page: runs of blocks with equal paths, and repeated sequences of up to four, become one."""
    out: list[list] = []
    for p in paths:
        if out and out[-1][0] == p:
            out[-1][2] = True
            continue
        out.append([p, False, False])
        for size in (2, 3, 4):
            if len(out) >= 2 * size and [x[0] for x in out[-size:]] == [x[0] for x in out[-2 * size : -size]]:
                for x, y in zip(out[-2 * size : -size], out[-size:]):
                    x[1], x[2] = x[1] or y[1], True
                del out[-size:]
                break
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what both match: the longest common sequence of slots stays, the rest becomes optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2]])
            i, j = i + 1, j + 1
        elif j >= m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2]])
            j += 1
    # Neighbouring optional slots of one place are one repeated slot.
    merged: list[list] = []
    for x in out:
        if merged and merged[-1][0] == x[0]:
            merged[-1][1:] = [merged[-1][1] and x[1], True]
        else:
            merged.append(x)
    return merged


def _outside(step: str) -> bool:
    tag, _, words = step.partition("[")
    words = words.partition("]")[0]
    if step.endswith("!") or tag in OUTSIDE:
        return True
    return tag not in ("body", "html", *MAIN_TAGS) and bool(words) and bool(OUTSIDE_WORDS.search(words))


def _container(path: tuple[str, ...]) -> int:
    """2: in an article or main element, 1: in something named like one, 0: neither."""
    if any(s.partition("[")[0] in MAIN_TAGS for s in path):
        return 2
    return int(any(MAIN_WORDS.search(s.partition("[")[2].rstrip("]!")) for s in path if "[" in s))


def region(weights: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """The innermost element that holds most of the varying text: from the root down, as long as one container below has ``MOST`` of it."""
    at: tuple[str, ...] = ()
    while True:
        below: dict[str, float] = {}
        for path, w in weights.items():
            # The last step of a path is the block that has the text, not a container of blocks.
            if path[: len(at)] == at and len(path) > len(at) + 1:
                below[path[len(at)]] = below.get(path[len(at)], 0.0) + w
        if not below:
            return at
        step, most = max(below.items(), key=lambda x: (x[1], x[0]))
        if most < MOST * sum(w for p, w in weights.items() if p[: len(at)] == at):
            return at
        at = (*at, step)


def by_variation(slots: list[tuple[str, ...]], wrapper: list[list], filled: dict[tuple[str, ...], tuple[float, float]]) -> list[tuple[str, ...]]:
    """Of the slots of a host without named containers those of the region that most of the varying text fills.

    ``filled`` says of a path on which share of the pages it has text, and how much of it varies, in characters a page.
    """
    optional = {p for p, o, _ in wrapper if o} - {p for p, o, _ in wrapper if not o}
    firm = {p: chars for p, (share, chars) in filled.items() if p in slots and chars > 0 and (share >= OFTEN or p not in optional)}
    if not firm:
        return slots
    at = region(firm)
    inside = [p for p in slots if p[: len(at)] == at]
    total = sum(filled.get(p, (0, 0.0))[1] for p in inside)

    def part(p: tuple[str, ...]) -> float:
        """What the element just below the region that holds the slot has of its varying text, and how often it is there."""
        box = p[: len(at) + 1]
        return sum(filled.get(q, (0, 0.0))[1] for q in inside if q[: len(box)] == box) / total if total else 1.0

    # Beside the text's own blocks and lists only boxes with a fair part of it count: not those of notices and links.
    own = lambda p: len(p) <= len(at) + 1 or p[len(at)].partition("[")[0] not in BOXES
    return [p for p in inside if own(p) or part(p) >= FAIR]


def main_slots(wrapper: list[list], filled: dict[tuple[str, ...], tuple[float, float]] | None = None) -> list[list[tuple[str, ...]]]:
    """Paths of the wrapper's slots that may hold main text: outside any container, in one by name, in an article."""
    good: list[list[tuple[str, ...]]] = [[], [], []]
    for path, _, _ in wrapper:
        inside = _container(path)
        header = any(s.partition("[")[0] == "header" for s in path) and not (inside == 2 and path[[s.partition("[")[0] for s in path].index("header") - 1 :][0].partition("[")[0] in MAIN_TAGS)
        # A word on what encloses an article (a layout "with sidebar") says nothing about the article.
        tags = [s.partition("[")[0] for s in path]
        first = next((k for k, t in enumerate(tags) if t in MAIN_TAGS), 0) if inside == 2 else 0
        hidden = any(s.endswith("!") or t in OUTSIDE for s, t in zip(path[:first], tags))
        if not header and not hidden and not any(_outside(s) for s in path[first:]) and path not in good[inside]:
            good[inside].append(path)
    if filled and not good[1] and not good[2]:
        good[0] = by_variation(good[0], wrapper, filled)
    return good


SEP, STEP = "\x1e", "\x1f"


def _write(items: list[list]) -> str:
    return SEP.join(f"{'?' if o else '.'}{'+' if r else '.'}{STEP.join(p)}" for p, o, r in items)


def _read(text: str) -> list[list]:
    return [[tuple(x[2:].split(STEP)) if x[2:] else (), x[0] == "?", x[1] == "+"] for x in text.split(SEP)] if text else []


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape, paths and texts of the blocks of each page, and the hash of its longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, paths, texts, longest = [], [], [], []
            for page in b.column("html").to_pylist():
                found = blocks(page or "")
                shapes.append(_write(fold([p for p, _ in found])))
                paths.append([STEP.join(p) for p, _ in found])
                texts.append([t for _, t in found])
                longest.append(_hash(max(texts[-1], key=len, default="")))
            words = pa.list_(pa.string())
            columns = [b.column("page_id"), b.column("url"), b.column("host"), pa.array(shapes, pa.string()), pa.array(paths, words), pa.array(texts, words), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "shape", "paths", "texts", "longest"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.withColumn("host", host).mapInArrow(run, "page_id long, url string, host string, shape string, paths array<string>, texts array<string>, longest long")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def fixed_texts(seen: DataFrame, least: int = LEAST_PAGES, share: float = FIXED) -> DataFrame:
    """(host, fixed) of (host, longest, marks): the marks that nearly all distinct pages of a host have.

    A host has few: each is on ``share`` of its pages, so there are no more than a page has blocks by ``share``.
    """
    pages = seen.groupBy("host").agg(F.count_distinct("longest").alias("pages")).where(F.col("pages") >= least)
    each = seen.select("host", "longest", F.explode(F.array_distinct("marks")).alias("mark")).distinct()
    counted = each.groupBy("host", "mark").agg(F.count("*").alias("n")).join(pages, "host")
    return counted.where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("fixed"))


def filled_slots(seen: DataFrame, fixed: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, filled) of (host, longest, paths, marks, sizes): of each path the share of pages that fill it and the characters a page that vary.

    For hosts of ``least`` distinct pages at least.  A host has as many paths as its wrapper has places.
    """
    pages = seen.groupBy("host").agg(F.count_distinct("longest").alias("pages")).where(F.col("pages") >= least)
    each = seen.join(small(fixed, BROADCAST_HOSTS), "host", "left").select("host", "longest", "fixed", F.explode(F.arrays_zip(F.col("paths").alias("p"), F.col("marks").alias("m"), F.col("sizes").alias("n"))).alias("b"))
    varies = F.when(F.col("fixed").isNull() | ~F.array_contains("fixed", F.col("b.m")), F.col("b.n")).otherwise(0)
    by_page = each.groupBy("host", "longest", F.col("b.p").alias("path")).agg(F.max(varies).alias("most"), F.sum(varies).alias("chars"))
    by_path = by_page.where("chars > 0").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).join(pages, "host")
    return by_path.groupBy("host").agg(F.collect_list(F.struct("path", (F.col("n") / F.col("pages")).alias("share"), (F.col("chars") / F.col("pages")).alias("chars"))).alias("filled"))


def wrappers(shapes: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, wrapper) from distinct (host, shape): groups of shapes are aligned, then their wrappers, until one is left."""

    def aligned(t: pa.Table) -> pa.Table:
        items: list[list] = []
        for text in sorted(t.column("shape").to_pylist()):
            items = align(items, _read(text)) if items else _read(text)
        return pa.table({"host": [t.column("host")[0].as_py()], "shape": [_write(items)]})

    while True:
        dealt = shapes.withColumn("n", F.ceil(F.count("*").over(_by_host()) / group)).withColumn("g", F.pmod(F.xxhash64("shape"), "n"))
        shapes = materialise(dealt.groupBy("host", "g").applyInArrow(aligned, "host string, shape string").distinct())
        if shapes.groupBy("host").count().where("count > 1").isEmpty():
            return shapes.withColumnRenamed("shape", "wrapper")


def _by_host():
    from pyspark.sql import Window

    return Window.partitionBy("host")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, by the wrapper of the page's host."""
    # What is stored is what can't be made from the rest: marks are hashes of path and text.
    read = stored(parsed(pages), "html-blocks", "zstd")
    read = read.withColumn("marks", F.zip_with("paths", "texts", lambda p, t: F.xxhash64(p, t)))
    seen = read.select("host", "shape", "longest", "paths", "marks", F.transform("texts", lambda t: F.length(t)).alias("sizes"))
    found = wrappers(materialise(seen.select("host", "shape").distinct()))
    fixed = materialise(fixed_texts(seen))
    filled = filled_slots(seen, fixed)
    known = materialise(_with_slots(found.join(filled, "host", "left")).join(fixed, "host", "left"))  # a row for each host
    joined = read.join(small(known, BROADCAST_HOSTS), "host", "left")
    # A page's main text lies in the most article-like slots of its host's wrapper that it has.
    levels = [F.get("slots", F.lit(i)) for i in (2, 1)]
    best = F.when(F.arrays_overlap("paths", levels[0]), levels[0]).when(F.arrays_overlap("paths", levels[1]), levels[1]).otherwise(F.get("slots", F.lit(0)))
    joined = joined.withColumn("best", best)
    inside = F.filter(F.arrays_zip(F.col("paths").alias("p"), F.col("texts").alias("t"), F.col("marks").alias("m")), lambda x: F.array_contains("best", x["p"]))
    varying = F.when(F.col("fixed").isNull(), F.col("inside")).otherwise(F.filter("inside", lambda x: ~F.array_contains("fixed", x["m"])))
    joined = joined.withColumn("inside", inside).withColumn("varying", varying)
    kept = F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("inside"))
    text = F.coalesce(F.array_join(F.transform(kept, lambda x: x["t"]), "\n"), F.lit(""))
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _with_slots(found: DataFrame) -> DataFrame:
    """(host, slots) of (host, wrapper, filled): its main slots by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = []
            for w, filled in zip(b.column("wrapper").to_pylist(), b.column("filled").to_pylist()):
                by_path = {tuple(x["path"].split(STEP)) if x["path"] else (): (x["share"], x["chars"]) for x in filled or ()}
                slots.append([[STEP.join(p) for p in level] for level in main_slots(_read(w), by_path)])
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(slots, pa.list_(pa.list_(pa.string())))], ["host", "slots"])

    return found.select("host", "wrapper", "filled").mapInArrow(run, "host string, slots array<array<string>>")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
