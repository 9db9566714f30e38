"""Substring dedup (operator 6): relative Lempel-Ziv parsing against every earlier block of words.

Each text is cut at content-defined anchors (the smallest hash of a ``GRAM``-word gram in every ``WINDOW`` words), so
equal passages are cut alike wherever they stand.  The block of an anchor is the run of ``WINDOW``-word windows whose
smallest gram it is, so every window belongs to exactly one block, and two equal windows to blocks of one anchor.  The
index holds each block by its anchor.  A document is factored greedily against all blocks that come before it: at a
window the index gives the first place that holds the same words, and the factor grows window by window while that
reference goes on alike; where it ends, the next window is looked up afresh.  A factor of n windows is n + ``WINDOW`` - 1
words, each of its windows a duplicate of one that starts earlier in (doc_id, start) order, and its words go.

Blocks are first looked up within the batch of texts at hand, so a passage that very many documents share reaches the
index once per batch and not once per document.  The index is never held: it is one sorted shuffle by anchor, of which
a task keeps the windows of one anchor at a time.  Anchors that many documents have (known from a bounded sample, which
decides on the dealing only) are dealt window by window instead of as blocks, so no task holds all their windows.

Results: one row per row of the table; a null text has no words (kept_sha256 is that of an empty string); words are
kept unchanged; rows that repeat an id and text are the same place, and none of them makes the other a duplicate; rows
that repeat an id with other texts are documents of their own, in the order of a hash of their texts; null ids come
before all others.  Other columns are not read.  Identity of windows rests on 64 bits over all their words, beside 64
bits of the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import id_text, table

WINDOW, GRAM = 20, 4
#: Documents of the sample that tells which anchors are dealt by window, and in how many of them such an anchor stands.
HOT_SAMPLE, HOT = 50_000, 100
SLICE = 3 << 20
U = np.uint64
#: Stands for a null id: no real id is smaller.
NULL_ID = -(2**63)


def window_table(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, tie: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Every window: id and tie of its row, first word, the hash of its smallest gram, and the 64 bits of its own hash."""
    start, end, of = W.words(raw, at)
    word = W.hashes(raw, start, end)
    n = len(word) - size + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return {"doc": e, "tie": e, "start": e, "h": e.view(U), "w": e.view(U)}
    first = np.searchsorted(of, np.arange(len(at) - 1))
    place = np.arange(len(word)) - first[of]
    grams = W.windows(word, gram)
    own = W.windows(word, size)
    # Smallest gram of each window by doubling: minima over 1, 2, 4, 8 grams, then two overlapping runs.
    span, low, width = size - gram + 1, grams, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    inside = of[size - 1 :] == of[:n]
    return {"doc": ids[of[:n][inside]], "tie": tie[of[:n][inside]], "start": place[:n][inside], "h": low[inside], "w": own[inside]}


def _first_of_each(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of windows by (h, w, place), where the first with the same h and w stands in it, and which start later than that."""
    order = np.lexsort((t["start"], t["tie"], t["doc"], t["w"], t["h"]))
    h, w, doc, tie, start = (t[k][order] for k in ("h", "w", "doc", "tie", "start"))
    lead = np.ones(len(h), bool)
    lead[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
    return order, head, (doc != doc[head]) | (tie != tie[head]) | (start != start[head])


def _factors(t: dict[str, np.ndarray], order: np.ndarray, head: np.ndarray, later: np.ndarray, whole: bool = True) -> dict[str, np.ndarray]:
    """Factors of the windows that stand earlier as well: row, first word and number of windows, and the same of the reference.

    Windows in text order; one goes on with the factor before it if its reference is the next window of that one's.
    Factors that only say which words go (not ``whole``) are joined where they follow each other; their reference is the first one's.
    """
    at, ref = order[later], order[head[later]]
    back = np.lexsort((t["start"][at], t["tie"][at], t["doc"][at]))
    at, ref = at[back], ref[back]
    doc, tie, start = (t[k][at] for k in ("doc", "tie", "start"))
    of, of_tie, of_start = (t[k][ref] for k in ("doc", "tie", "start"))
    fresh = np.ones(len(at), bool)
    same = [x[1:] == x[:-1] for x in ((doc, tie, of, of_tie) if whole else (doc, tie))] + [x[1:] == x[:-1] + 1 for x in ((start, of_start) if whole else (start,))]
    fresh[1:] = ~np.all(same, axis=0)
    edge = np.flatnonzero(fresh)
    n = np.diff(np.append(edge, len(at)))
    return {"doc": doc[edge], "tie": tie[edge], "start": start[edge], "n": n, "ref": of[edge], "ref_start": of_start[edge]}


FACTOR = "doc long, tie int, start int, n int, ref long, ref_start int"
_TYPES = {"key": pa.int64(), "doc": pa.int64(), "tie": pa.int32(), "start": pa.int32(), "n": pa.int32(), "ref": pa.int64(), "ref_start": pa.int32()}
#: What a shuffled factor says of its reference, in the place of a block's windows.
_REFERENCE = np.dtype([("n", "<i4"), ("ref", "<i8"), ("ref_start", "<i4")])
BLOCK = ("key", "doc", "tie", "start")


def _batch(t: dict, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t[k], _TYPES[k]) for k in names], list(names))


def _block_batch(t: dict, edge: np.ndarray, payload: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCK and their parts of the payload; ``edge`` counts bytes."""
    w = pa.BinaryArray.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(payload.tobytes())])
    return pa.RecordBatch.from_arrays([*(pa.array(t[k], _TYPES[k]) for k in BLOCK), w], [*BLOCK, "w"])


def _factor_rows(f: dict) -> pa.RecordBatch:
    """Factors among blocks: their first word is written as -1 less it."""
    payload = np.zeros(len(f["doc"]), _REFERENCE)
    for k in _REFERENCE.names:
        payload[k] = f[k]
    key = W.mix(f["doc"].astype(np.int64).view(U) + f["start"].astype(np.int64).view(U)).view(np.int64)
    return _block_batch({"key": key, "doc": f["doc"], "tie": f["tie"], "start": -1 - f["start"]}, np.arange(len(key) + 1) * _REFERENCE.itemsize, payload)


def _factors_of(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    payload = np.frombuffer(b"".join(b.column("w").to_pylist()), _REFERENCE)
    return {"doc": b.column("doc").to_numpy(), "tie": b.column("tie").to_numpy(), "start": -1 - b.column("start").to_numpy()} | {k: payload[k] for k in _REFERENCE.names}


def _sliced(b: pa.RecordBatch, size: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    raw, at = W.buffers(b.column(2))
    ids, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
    for lo, hi in W.slices(at, SLICE):
        t = window_table(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ids[lo:hi], tie[lo:hi], size, gram)
        if len(t["h"]):
            yield t


def hot_anchors(docs: DataFrame, size: int, gram: int, sample: int = HOT_SAMPLE, least: int = HOT) -> np.ndarray:
    """Sorted anchors that at least ``least`` of about ``sample`` documents have: at most the sample's anchors by ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _sliced(b, size, gram):
                order = np.lexsort((t["tie"], t["doc"], t["h"]))
                h, doc, tie = (t[k][order] for k in ("h", "doc", "tie"))
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
                keys, n = np.unique(h[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    share = min(1.0, sample / max(docs.count(), 1))
    seen = docs if share == 1 else docs.sample(share, seed=7)
    found = seen.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(U))


def _dealt(t: dict[str, np.ndarray], hot: np.ndarray) -> dict[str, np.ndarray]:
    """The windows with the key by which they are dealt for ``h``: their anchor, or a mix of it and their own hash where it is hot."""
    if not len(hot):
        return t
    i = np.minimum(np.searchsorted(hot, t["h"]), len(hot) - 1)
    return t | {"h": np.where(hot[i] == t["h"], W.mix(t["h"] ^ W.mix(t["w"])), t["h"])}


def blocks(docs: DataFrame, size: int, gram: int, hot: np.ndarray, whole: bool) -> DataFrame:
    """Blocks (key, doc, tie, start, w) of consecutive windows that are the first in their batch, and the factors of those that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _sliced(b, size, gram):
                t = _dealt(t, hot)
                order, head, later = _first_of_each(t)
                yield _factor_rows(_factors(t, order, head, later, whole))
                stay = np.sort(order[~later])  # back in text order
                doc, tie, start, h, w = (t[k][stay] for k in ("doc", "tie", "start", "h", "w"))
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + 1)
                at = np.flatnonzero(fresh)
                yield _block_batch({"key": h[at].view(np.int64), "doc": doc[at], "tie": tie[at], "start": start[at]}, np.append(at, len(h)) * 8, w)

    return docs.mapInArrow(run, "key long, doc long, tie int, start int, w binary")


def _look_up(sorted_blocks: DataFrame, whole: bool) -> DataFrame:
    """Factors (``FACTOR``) of duplicate windows, from blocks sorted by key and place.

    Whole batches are decided at once; only first windows of the key that is still open at a batch's end are carried on.
    """
    names = tuple(x.split()[0] for x in FACTOR.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_h, seen = None, None  # the key that is open, and the first place of each of its windows so far
        for b in batches:
            known = pc.less(b.column("start"), 0)
            if pc.any(known).as_py():
                yield _batch(_factors_of(b.filter(known)), names)
                b = b.filter(pc.invert(known))
            if not b.num_rows:
                continue
            h, w = b.column("key").to_numpy().view(U), b.column("w")
            offsets = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64) // 8
            n = np.diff(offsets)
            each = np.repeat(np.arange(len(h)), n)
            shared = np.zeros(len(h), bool)  # blocks whose key stands alone have nothing to look up
            shared[1:] = h[1:] == h[:-1]
            shared[:-1] |= shared[1:]
            shared[(h == h[-1]) | (h == open_h if open_h is not None else False)] = True
            take = shared[each]
            t = {k: b.column(k).to_numpy().astype(np.int64)[each][take] for k in ("doc", "tie")} | {
                "h": h[each][take],
                "start": (b.column("start").to_numpy()[each] + np.arange(len(each)) - np.repeat(offsets[:-1] - offsets[0], n))[take],
                "w": np.frombuffer(w.buffers()[2], U)[offsets[0] : offsets[-1]][take],
            }
            if open_h is not None and open_h == h[0]:
                t = {k: np.concatenate([seen[k], t[k]]) for k in t}
            order, head, later = _first_of_each(t)
            found = _factors(t, order, head, later, whole)
            if len(found["doc"]):
                yield _batch(found, names)
            first = order[~later]
            first = first[t["h"][first] == h[-1]]
            # Of a place that repeated rows share one window is enough.
            first = first[np.unique(np.stack([t[k][first].astype(np.int64) for k in ("doc", "tie", "start")]), axis=1, return_index=True)[1]] if len(first) else first
            open_h, seen = h[-1], {k: v[first] for k, v in t.items()}

    return sorted_blocks.mapInArrow(run, FACTOR)


def _kept(words: list[bytes], starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, bytes]:
    """How many words the windows at the runs cover, and the other words joined by spaces."""
    if not len(starts):
        return 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + lengths + size - 1, len(words)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone) if not g])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a number for null as well), tie, text.

    The tie tells rows of one id with other texts apart: 31 bits of a hash of the text.  Where no id has several texts,
    which the ids and hashes tell, it is 0 for all and takes no room in what is shuffled.
    """
    docs = id_text(docs, id_col, text_col)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("x")).distinct()
    several = not hashed.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int") if several else F.lit(0)
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), tie.alias("tie"), "text")


def _parsed(named: DataFrame, size: int, gram: int, whole: bool) -> DataFrame:
    found = blocks(named, size, gram, hot_anchors(named, size, gram), whole)
    # One shuffle takes blocks to their anchor, and factors that are found already to anywhere.
    dealt = found.repartition("key")
    return _look_up(dealt.sortWithinPartitions("key", "doc", "tie", "start"), whole)


def factors(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words, ref_id, ref_start of every factor: words that stand earlier, at the reference, as well."""
    found = _parsed(_named(docs, id_col, text_col), size, gram, True)
    id_ = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(id_("doc").alias("doc_id"), "start", (F.col("n") + size - 1).alias("n_words"), id_("ref").alias("ref_id"), "ref_start")


def dedup_substrings(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the kept ``text`` where ``texts`` is set."""
    named = _named(docs, id_col, text_col)
    marks = _parsed(named, size, gram, False).groupBy("doc", F.col("tie").alias("of_tie")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, marked in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("runs").to_pylist()):
                every = text.split()  # of bytes: the six white space characters
                m = np.array([(x["start"], x["n"]) for x in marked or ()], np.int64).reshape(-1, 2)
                gone, kept = _kept(every, m[:, 0], m[:, 1], size)
                rows.append((len(every), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            out = list(zip(*rows)) or [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(out, types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    same = (named["doc_id"] == marks["doc"]) & (named["tie"] == marks["of_tie"])
    joined = named.join(marks.hint("shuffle_hash"), same, "left").select("doc_id", "text", "runs")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), *out.columns[1 : 5 if texts else 4])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
