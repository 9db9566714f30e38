"""MinHash near-duplicates (operator 3): ProbMinHash, banding, exact verification, connected classes.

A document is the weighted set of its five-word shingles, a shingle that occurs c times weighing 1 + ln c, so that one
phrase repeated at length doesn't drown the rest (a text of one to four words is one shingle).  ProbMinHash lets every shingle send points of a Poisson process whose rate is its
weight into ``BANDS * ROWS`` registers and stops once no later point can win; two documents agree in a register with
the probability of their probability Jaccard similarity.  Documents that agree in a whole band are candidates, and a
candidate is a link when its exact probability Jaccard, which is the plain Jaccard where no shingle repeats, is 0.8 or
more.  A class is a connected component of links.

Exact copies are merged before anything is compared.  In each band bucket all members are compared with the smallest
id.  Where a bucket then still holds several classes, sketches are held against each other across them, block by
block: first each member's ``NEAREST`` most similar others are verified, then, across the classes that are left,
everything that can still be a link.  A pair can't be one if its registers agree too seldom (by over 4.5 standard
deviations), or if a bitmap of the shingles shows too large a difference (a sure bound).
A bucket of thousands of copies costs few comparisons a member, and no group is held in one task.  What can be lost: of
pairs at a similarity of exactly 0.8 banding misses 6 in 100,000, the cut at 4.5 deviations 3 in a million more.

Results: one row per row of the table with the smallest doc_id of its class.  Texts without words (null, empty, blank)
and rows without an id link with nothing; rows that repeat an id are one document; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import components, id_text, materialise, table

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
NEAREST, BLOCK, BITS = 2, 512, 2048
SLICE, SLICE_TEXTS = 2 << 20, 2048
U = np.uint64


def shingles(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of each distinct shingle, ordered by text and hash."""
    start, end, of = W.words(raw, at)
    word = W.hashes(raw, start, end)
    key = W.windows(word, size)
    inside = of[size - 1 :] == of[: len(key)]
    texts, keys = [of[: len(key)][inside]], [key[inside]]
    n_words = np.bincount(of, minlength=len(at) - 1)
    for n in range(1, size):
        short = np.flatnonzero(n_words == n)
        if len(short):
            keys.append(W.windows(word, n)[np.searchsorted(of, short)] ^ U(n))
            texts.append(short)
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, key = text[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    where = np.flatnonzero(first)
    return text[where], key[where], np.diff(np.append(where, len(key)))


def damped(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def prob_min_hash(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The element that won each register of each of ``n`` texts (ProbMinHash with early termination)."""
    best = np.full(n * registers, np.inf)
    seen = []
    t, at, e, w = np.zeros(len(key)), text, key, weight.astype(float)
    turn = 0
    while len(at):
        turn += 1
        u = W.mix(e + U(turn * 0x9E3779B97F4A7C15 % 2**64))
        t = t - np.log(((u >> U(11)).astype(float) + 0.5) * 2.0**-53) / w
        slot = at * registers + ((W.mix(u) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        near = t < best[slot]
        np.minimum.at(best, slot[near], t[near])
        seen.append((slot[near], t[near], e[near]))
        go = t < best.reshape(n, registers).max(1)[at]  # the next point comes later still
        t, at, e, w = t[go], at[go], e[go], w[go]
    out = np.zeros(n * registers, U)
    for slot, t, e in seen:
        won = t == best[slot]
        out[slot[won]] = e[won]
    return out.reshape(n, registers)


def band_keys(raw: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit key for each band of each text, a sketch (bitmap, sizes, band keys, a byte a register), and whether the text has words at all."""
    n = len(at) - 1
    text, key, weight = shingles(raw, at)
    won = prob_min_hash(text, key, damped(weight), n, bands * rows).reshape(n, bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=U), (n, 1))
    for r in range(rows):
        out = W.mix(out * U(0xD6E8FEB86659FD93) + won[:, :, r])
    size = np.bincount(text, minlength=n)
    bits = np.zeros((n, BITS), bool)
    bits[text, (key % U(BITS)).astype(np.int64)] = True
    extra = np.bincount(text, weights=damped(weight), minlength=n) - size
    sizes = np.stack([size, extra], axis=1).astype(np.float32).view(np.uint8)
    agreed = (W.mix(won) >> U(56)).astype(np.uint8).reshape(n, -1)
    return out, np.hstack([np.packbits(bits, axis=1), sizes, out.astype(np.uint32).view(np.uint8), agreed]), size > 0


def can_link(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Of rows of sketches whether the pairs may be links: bits that differ are shingles that differ.

    With S shingles in both texts together, D of them in one only, and weights that exceed 1 by E in all, J_P is at
    most (S - D + 2E) / (S + D); D is at least the number of bits that differ.
    """
    sizes = [x[:, BITS // 8 : BITS // 8 + 8].copy().view(np.float32).astype(float) for x in (a, b)]
    apart = np.bitwise_count(a[:, : BITS // 8] ^ b[:, : BITS // 8]).sum(1)
    both, extra = (sizes[0] + sizes[1]).T
    return both - apart + 2 * extra >= (similarity - 1e-4) * (both + apart)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as sorted keys and weights."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if x.max() == 1 == y.max():
        return len(both) / (len(a) + len(b) - len(both))
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    xi, yi = x[i].astype(float), y[j].astype(float)
    order = np.argsort(xi / yi, kind="stable")
    xi, yi = xi[order], yi[order]
    above = only_x + np.cumsum(xi[::-1])[::-1] - xi  # equal ratios may count on either side: the terms are equal
    below = only_y + np.cumsum(yi)
    return float((1 / (above / xi + below / yi)).sum())


def _pack(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Per text: how many shingles, their sorted hashes, and their counts unless all are 1."""
    text, key, count = shingles(raw, at)
    edge = np.searchsorted(text, np.arange(len(at)))
    out = []
    for lo, hi in zip(edge[:-1], edge[1:]):
        c = count[lo:hi].astype(np.uint32)
        out.append(len(c).to_bytes(4, "little") + key[lo:hi].tobytes() + (c.tobytes() if len(c) and c.max() > 1 else b""))
    return out


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of a packed text; counts are left out where all are 1."""
    n = int.from_bytes(b[:4], "little")
    key = np.frombuffer(b, U, n, 4)
    return key, damped(np.frombuffer(b, np.uint32, n, 4 + 8 * n)) if len(b) > 4 + 8 * n else np.ones(n)


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in W.slices(at, SLICE):
        for a in range(lo, hi, SLICE_TEXTS):
            yield a, min(hi, a + SLICE_TEXTS)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tkey (identity of the text) and band keys of the rows that have an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = W.buffers(b.column(1))
            for lo, hi in _slices(at):
                keys, sketch, some = band_keys(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bands, rows)
                flat = pa.array(keys[some].view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                part = b.slice(lo, hi - lo).filter(pa.array(some))
                bytes_ = pa.array([x.tobytes() for x in sketch[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists, bytes_], ["doc_id", "tkey", "bands", "sketch"])

    keyed = docs.where("doc_id is not null").withColumn("tkey", F.unhex(F.md5("text")))
    return keyed.mapInArrow(run, "doc_id long, tkey binary, bands array<long>, sketch binary")


def packed_shingles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = W.buffers(b.column(1))
            for lo, hi in _slices(at):
                packed = _pack(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["doc_id", "sh"])

    return docs.mapInArrow(run, "doc_id long, sh binary")


def _verify(pairs: DataFrame, shingled: DataFrame, similarity: float) -> DataFrame:
    """Of the candidate pairs (a, b) those that are links.  The spread-out side joins first; AQE splits a hot leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            keep = []
            for a, sa, sb in zip(b.column("a").to_pylist(), b.column("sa"), b.column("sb")):
                if a != last:
                    last, left = a, _unpack(sa.as_py())
                keep.append(probability_jaccard(*left, *_unpack(sb.as_py())) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (shingled.select(F.col("doc_id").alias(k), F.col("sh").alias(f"s{k}")) for k in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _across(label: DataFrame, similarity: float, bands: int, rows: int, nearest: int | None) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different classes whose sketches come near enough, or the nearest of them.

    ``label`` has key, rep, c (class), n (members of the bucket) and sketch.  A bucket of over ``BLOCK`` members is
    dealt into blocks, and each pair of blocks is a group of its own.
    """
    keys, head, registers = BITS // 8 + 8, BITS // 8 + 8 + 4 * bands, bands * rows
    least = similarity - 4.5 * (similarity * (1 - similarity) / registers) ** 0.5
    label = label.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = label.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", "sketch")

    def group(key, own, rep, c, sketch):
        left = right = np.flatnonzero(own == own.min())
        if own.max() != own.min():
            right = np.flatnonzero(own == own.max())
        for lo in range(0, len(left), 64):
            rows = left[lo : lo + 64]
            near = (sketch[rows][:, None, head:] == sketch[right][None, :, head:]).mean(2)
            near[c[rows][:, None] == c[right][None, :]] = -1
            if nearest is None or nearest >= near.shape[1]:
                x, y = np.nonzero(near >= least)
            else:
                top = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
                x, y = np.repeat(np.arange(len(rows)), nearest), top.ravel()
                good = near[x, y] >= least
                x, y = x[good], y[good]
            good = can_link(sketch[rows[x]], sketch[right[y]], similarity)
            if nearest is None and left is right:
                good &= rows[x] < right[y]
            if nearest is None:  # a pair that shares several buckets is reported in the first
                of_x, of_y = (sketch[z][:, keys:head].copy().view(np.uint32) for z in (rows[x], right[y]))
                shared = of_x == of_y
                good &= of_x[np.arange(len(x)), shared.argmax(1)] == np.uint32(key & 0xFFFFFFFF)
            a, b = rep[rows[x[good]]], rep[right[y[good]]]
            yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _with_end(batches):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            ids = [t.column(k).to_numpy() for k in ("key", "i", "j")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            edges = [0, *cut.tolist(), *([t.num_rows] if b is None else [])]
            own, rep, c = (t.column(k).to_numpy() for k in ("own", "rep", "c"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, head + registers)
            out = [p for x, y in zip(edges[:-1], edges[1:]) for p in group(int(ids[0][x]), own[x:y], rep[x:y], c[x:y], sketch[x:y])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in out])) for k in (0, 1)], ["a", "b"])
            rest = t.slice(edges[-1])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, class_id (smallest id of the class), kept (the row carries that id) for every row."""
    docs = id_text(docs, id_col, text_col)
    signed = materialise(signatures(docs, bands, rows))
    reps = materialise(signed.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    member = reps.select("rep", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
    bucket = materialise(member.join(shared, "key").select("key", "rep", "least"))

    # Texts move once, and only those that share a band with another one go on.
    shingled = materialise(packed_shingles(docs.join(bucket.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])))

    new = materialise(bucket.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct())
    links, tried, found = materialise(_verify(new, shingled, similarity)), new, None
    for nearest in (NEAREST, None):
        found = components(links) if found is None else found
        label = bucket.join(found, bucket["rep"] == found["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
        several = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        label = label.join(several.select("key", "n"), "key").join(reps.select("rep", "sketch"), "rep")
        new = materialise(_across(label, similarity, bands, rows, nearest).distinct().join(tried, ["a", "b"], "left_anti"))
        if new.isEmpty():
            continue
        more = materialise(_verify(new, shingled, similarity))
        if not more.isEmpty():
            # Members of a class are linked to its id only: what was settled isn't worked out again.
            links, tried, found = materialise(found.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b").union(more)), tried.union(new), None
        else:
            tried = tried.union(new)
    found = components(links) if found is None else found
    classed = reps.join(found, reps["rep"] == found["node"], "left").select("tkey", F.coalesce("component", "rep").alias("class_id"))
    # An id that carries several texts is one document: its classes are one.
    ids = signed.select("doc_id", "tkey").join(classed, "tkey").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(ids, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.coalesce("class_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
