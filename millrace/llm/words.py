"""Vectorised words of many texts at once: boundaries and 64-bit word hashes from UTF-8 bytes, without a Python loop a word.

A word is a longest run of bytes other than space, tab, LF, VT, FF and CR, that is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Words longer than this are hashed one by one by a library, shorter ones eight bytes at a time for all words together.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts and the last ends."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray, between: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its text; ``between`` marks the bytes that belong to no word."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    gap = between[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    cut = at[1:-1]
    first[cut[cut < n]] = True  # a text starts a word of its own
    start = np.flatnonzero(first & ~gap)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[cut[cut > 0] - 1] = True
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.  Every eight bytes pass through ``mix`` before the next come in, so that no family of
    words collides by its structure; words of equal length of up to eight bytes never collide."""
    size = end - start
    out, eights = mix(size.astype(np.uint64) * U(0x9FB21C651E98DF25)), _eights(raw)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] ^ (eights[start[live] + at] & _KEEP[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return out


def same(raw: np.ndarray, start: np.ndarray, end: np.ndarray, raw2: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether the words at the same index are equal, byte by byte."""
    size = end - start
    out, a, b = size == end2 - start2, _eights(raw), _eights(raw2)
    live, at = np.flatnonzero(out & (size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        equal = ((a[start[live] + at] ^ b[start2[live] + at]) & _KEEP[np.minimum(left, 8)]) == 0
        out[live[~equal]] = False
        live, at = live[equal & (left > 8)], at + 8
    for i in np.flatnonzero(out & (size > LONG)):
        out[i] = np.array_equal(raw[start[i] : end[i]], raw2[start2[i] : end2[i]])
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0xD6E8FEB86659FD93) ^ (b + U(0x9E3779B97F4A7C15)))


def windows(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, over the whole array; callers drop those that leave a text.

    Runs of 1, 2, 4, ... words are joined pair by pair, mixed at every step.
    """
    n = len(word)
    if n < size:
        return np.zeros(0, np.uint64)
    out, done, part, span = None, 0, word, 1
    while True:
        if size & span:
            out = part if out is None else _joined(out[: n - done - span + 1], part[done:])
            done += span
        if done == size:
            return mix(out)
        part, span = _joined(part[:-span], part[span:]), 2 * span


def slices(at: np.ndarray, size: int):
    """Runs of consecutive texts of about ``size`` bytes together; a longer text is a run of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi
