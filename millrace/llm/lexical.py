"""Ranked lexical search (operator 13): a bit-sliced impact index.

What a term adds to a document's score, its impact, is an integer.  Documents are taken in blocks; in a block a term has a
bitmap for each bit of its impacts, a bit of a bitmap standing for a document.  A query adds the slices of its terms with
bitwise carries, 64 documents an operation and all queries of a group at once, and gets its scores as slices too.  The
best are found from the highest slice down: documents with the bit set stay candidates as long as there are enough of
them.  Only they are turned into numbers, and the best of all blocks are ranked.

1. Texts are read once.  Of each document the number of its terms and the counts of those that are asked for are kept.
2. Totals over all documents and document frequencies follow from these.
3. Blocks of documents become the index: rows (block, term, bytes of the bitmaps that aren't empty, slices).
4. Rows of a block come together, and all queries are answered on it.

Queries and their terms are sent to the tasks in groups of bounded size; each group is a pass of its own, so nothing that
is sent grows with the table of queries.

Results: rows of one query id are one query, whose terms are those of all its rows; a null id is an id.  Null and empty
texts, and texts without a term, are never found.  Rows that repeat a document's id are ranked each; among equal scores
the smaller id goes first, null ids last.  Columns other than ids and texts are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import id_text, stored, table

BEST = 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a block, queries that are added up together, and (query, term) rows that a group of queries may have.
BLOCK, TOGETHER, GROUP_ROWS = 4096, 256, 1_000_000
SLICE_BYTES = 4 << 20
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The row of a block that has its documents' ids instead of a term's slices.
IDS = -1


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query, term, n: how often each query has each of its terms."""
    text = F.translate(items[f"`{text_col}`"].cast("string"), UPPER, LOWER)
    rows = items.select(items[f"`{id_col}`"].cast("long").alias("query"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.groupBy("query", "term").agg(F.count("*").alias("n"))


class Vocabulary:
    """Terms by number; words of texts are found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.raw, self.at = W.buffers(pa.array(terms, pa.large_string()))
        h = W.hashes(self.raw, self.at[:-1], self.at[1:])
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self.most = int(np.unique(h, return_counts=True)[1].max(initial=1))

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word's term; -1 for other words."""
        out = np.full(len(start), -1, np.int64)
        if not self.terms:
            return out
        h = W.hashes(raw, start, end)
        at = np.searchsorted(self.hashes, h)
        for _ in range(self.most):
            near = np.flatnonzero((at < len(self.order)) & (self.hashes[np.minimum(at, len(self.order) - 1)] == h) & (out < 0))
            term = self.order[at[near]]
            good = W.same(raw, start[near], end[near], self.raw, self.at[term], self.at[term + 1])
            out[near[good]] = term[good]
            at = at + 1
        return out


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers, ascending) and tfs of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            raw_all, at_all = W.buffers(b.column(1))
            for lo, hi in W.slices(at_all, SLICE_BYTES):
                raw, at = _LOWER[raw_all[at_all[lo] : at_all[hi]]], at_all[lo : hi + 1] - at_all[lo]
                start, end, of = W.words(raw, at, _BETWEEN)
                term = v.find(raw, start, end)
                hit = term >= 0
                pair, tf = np.unique(of[hit] * max(1, len(v.terms)) + term[hit], return_counts=True)
                edge = pa.array(np.searchsorted(pair, np.arange(hi - lo + 1) * max(1, len(v.terms))), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(x, pa.int32())) for x in (pair % max(1, len(v.terms)), tf)]
                n = np.bincount(of, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Totals:
    """Documents that have a term, all their terms, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each posting adds to a score; ``n`` are the terms of its document."""
        m = 100 - 25 + (25 * n * self.documents) // max(1, self.terms)
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def totals(rows: DataFrame, terms: int) -> Totals:
    """Sums over all documents; a row for each term of the vocabulary comes back, no more."""
    whole = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    n = whole["documents"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    return Totals(n, whole["terms"], weight)


def slices(term: np.ndarray, place: np.ndarray, impact: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each term the bytes of its bitmaps that aren't empty, and its slices there, lowest bit first."""
    some = impact > 0
    term, place, impact = term[some], place[some], impact[some]
    order = np.lexsort((place, term))
    term, place, impact = term[order], place[order], impact[order]
    if not len(term):
        return
    byte = place >> 3
    head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (byte[1:] != byte[:-1])))
    planes = np.stack([np.bitwise_or.reduceat((((impact >> j) & 1) << (place & 7)).astype(np.uint8), head) for j in range(int(impact.max()).bit_length())])
    at, of = byte[head].astype(np.uint16), term[head]
    edges = [*np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist(), len(of)]
    for lo, hi in zip(edges, edges[1:]):
        own = planes[:, lo:hi]
        yield int(of[lo]), at[lo:hi], own[: int(np.flatnonzero(own.any(axis=1))[-1]) + 1]


def impact_index(rows: DataFrame, of: Totals, block: int = BLOCK) -> DataFrame:
    """block, term, at, slices: the index of all documents that have a term of the vocabulary.

    A block's documents stand in the order of their ids, null ids last; their ids are in the row of the term ``IDS``, whose
    ``at`` says how many of them are null.
    """
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def rows_of(number: int, t: pa.Table) -> pa.RecordBatch:
        ids = t.column("doc_id").combine_chunks()
        null = np.asarray(ids.is_null())
        key = np.asarray(ids.fill_null(0))
        order = np.lexsort((key, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        count = np.asarray(t.column("terms").combine_chunks().value_lengths())
        term, tf = (t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        n = np.repeat(np.asarray(t.column("n")), count)
        out = [(IDS, np.array([null.sum()], np.int32).tobytes(), key[order].astype(np.int64).tobytes())]
        out += [(k, at.tobytes(), own.tobytes()) for k, at, own in slices(term, np.repeat(place, count), sent.value.impacts(n, term, tf))]
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "term", "at", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for b in batches:
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part])
            while len(held) >= block:
                yield rows_of(number, held.slice(0, block))
                number, held = number + 1, held.slice(block)
        if held is not None and len(held):
            yield rows_of(number, held)

    return rows.where(F.size("terms") > 0).mapInArrow(run, "block long, term int, at binary, slices binary")


def _add(sums: np.ndarray, more: np.ndarray, top: int) -> None:
    """sums += more, number by number; both are slices, lowest first, and ``more`` has nothing from ``top`` on."""
    carry = np.zeros_like(more[0])
    for j in range(top):
        x, y = sums[j], more[j]
        either = x ^ y
        keep = (x & y) | (carry & either)
        np.bitwise_xor(either, carry, out=x)
        carry = keep
    while carry.any():
        x, keep = sums[top], sums[top] & carry
        x ^= carry
        carry, top = keep, top + 1


def add_up(terms: dict[int, tuple[np.ndarray, np.ndarray]], queries: list[list[tuple[int, int]]], size: int) -> np.ndarray:
    """Scores of ``size`` documents for each query [(term, times)] as slices: an array by slice, query and 64 documents.

    Times are powers of two added one by one: a slice moved up by k counts 2**k times.  ``queries`` with most terms go first.
    """
    parts = [[(t, k) for t, n in q for k in range(n.bit_length()) if n >> k & 1] for q in queries]
    most = max(sum(n << len(terms[t][1]) for t, n in q) for q in queries)
    sums = np.zeros((most.bit_length(), len(queries), -(-size // 64)), np.uint64)
    rounds = max(map(len, parts))
    for r in range(rounds):
        now = [(i, *p[r]) for i, p in enumerate(parts) if len(p) > r]
        rows = np.array([i for i, _, _ in now])
        top = max(len(terms[t][1]) + k for _, t, k in now)
        more = np.zeros((top, len(now), sums.shape[2]), np.uint64)
        bytes_ = more.view(np.uint8)
        for j, (_, t, k) in enumerate(now):
            at, own = terms[t]
            bytes_[k : k + len(own), j, at] = own
        if len(now) == len(queries):
            _add(sums, more, top)
        else:
            some = sums[:, rows]
            _add(some, more, top)
            sums[:, rows] = some
    return sums


def best(sums: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and scores of the ``k`` highest scores above 0 of each query; of equal scores the first places."""
    sure, open_ = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums, axis=0)
    for s in sums[::-1]:
        with_bit = sure | (open_ & s)
        n = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)[:, None]
        # Too many have the bit: only they stay open.  Too few: they are sure of a place.  Just enough: nobody else has one.
        sure, open_ = np.where(n > k, sure, with_bit), np.where(n > k, open_ & s, np.where(n < k, open_ & ~s, np.uint64(0)))
    out = []
    for i in range(len(sure)):
        first, rest = (np.flatnonzero(np.unpackbits(x[i].view(np.uint8), bitorder="little")) for x in (sure, open_))
        place = np.append(first, rest[: max(0, k - len(first))])
        bits = (sums[:, i, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
        out.append((place, (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)))
    return out


def search(index: DataFrame, queries: dict[int | None, list[tuple[int, int]]], k: int = BEST) -> DataFrame:
    """query, doc_id, score: of each block the ``k`` best documents of every query [(term, times)]."""
    sent = index.sparkSession.sparkContext.broadcast(list(queries.items()))

    def found(ids: np.ndarray, nulls: int, terms: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        asked = [(q, here) for q, p in sent.value if (here := [(t, n) for t, n in p if t in terms])]
        asked.sort(key=lambda x: -len(x[1]))
        for lo in range(0, len(asked), TOGETHER):
            part = asked[lo : lo + TOGETHER]
            got = best(add_up(terms, [p for _, p in part], len(ids)), k)
            place, score = (np.concatenate(x) for x in zip(*got))
            query = [q for (q, _), (p, _) in zip(part, got) for _ in p]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids[place], pa.int64(), mask=place >= len(ids) - nulls), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, nulls, terms = None, None, 0, {}
        for b in batches:
            for number, term, at, own in zip(*(b.column(c).to_pylist() for c in range(4))):
                if number != current:
                    if terms:
                        yield from found(ids, nulls, terms)
                    current, terms = number, {}
                if term == IDS:
                    ids, nulls = np.frombuffer(own, np.int64), int(np.frombuffer(at, np.int32)[0])
                else:
                    where = np.frombuffer(at, np.uint16)
                    terms[term] = where, np.frombuffer(own, np.uint8).reshape(-1, len(where))
        if terms:
            yield from found(ids, nulls, terms)

    return index.repartition("block").sortWithinPartitions("block", "term").mapInArrow(run, "query long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` highest-scoring documents of each item, over all documents."""
    asked = stored(query_terms(items), "search-queries")
    groups = max(1, -(-asked.count() // group_rows))
    docs, out = id_text(docs, id_col, text_col), None
    for g in range(groups):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(groups)) == g).collect()
        terms = sorted({r["term"] for r in part})
        number, queries = {t: i for i, t in enumerate(terms)}, defaultdict(list)
        for r in part:
            queries[r["query"]].append((number[r["term"]], r["n"]))
        rows = stored(counted(docs, Vocabulary(terms)), "search-terms")
        index = stored(impact_index(rows, totals(rows, len(terms)), block), "search-index")
        found = search(index, dict(queries), k)
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("item_id"), "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM w WHERE len(terms) > 0
), s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d
), p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY r, term
), q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), f AS (SELECT term, count(*)::BIGINT AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term
), i AS (
  SELECT r, doc_id, p.term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) AS impact
  FROM p JOIN f USING (term), s
), x AS (SELECT q.item_id, i.r, any_value(i.doc_id) AS doc_id, sum(q.times * i.impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.r
), y AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM y WHERE rank <= 20
"""
