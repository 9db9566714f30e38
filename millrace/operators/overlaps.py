"""Trigram overlaps of many pairs of texts at once: a bitmap of trigrams for each text, and bits counted pair by pair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words of bitmaps that are worked on at once.
_AT_ONCE = 1 << 21


class Trigrams:
    """Distinct trigrams of normalized texts (an empty text has one, a shorter one is its own), as bitmaps and sizes.

    Only trigrams that several texts have get a bit.
    """

    def __init__(self, texts: Sequence[str]):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(self.length)])
        of = np.repeat(np.arange(len(texts)), np.maximum(self.length - 2, 0))
        start = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(self.length - 2, 0))])[:-1], np.maximum(self.length - 2, 0)) + at[of]
        three = (points[start] << np.uint64(42)) | (points[start + 1] << np.uint64(21)) | points[start + 2] if len(of) else np.zeros(0, np.uint64)
        short = np.flatnonzero(self.length < 3)
        # Trigrams stay below 2**63; texts of up to two characters are told apart from them, and by length, by higher bits.
        own = np.array([(1 << 63) | (len(texts[i]) << 60) | sum(ord(c) << 21 * k for k, c in enumerate(texts[i])) for i in short], np.uint64)
        gram, number = np.unique(np.concatenate([three, own]), return_inverse=True)
        pair = np.unique(np.concatenate([of, short]) * max(1, len(gram)) + number)
        text, number = pair // max(1, len(gram)), pair % max(1, len(gram))
        self.size = np.bincount(text, minlength=len(texts))
        many = np.bincount(number, minlength=len(gram)) > 1
        bit = np.cumsum(many) - 1
        text, bit = text[many[number]], bit[number[many[number]]]
        words = int(many.sum()) // 64 + 1
        self.bits = np.zeros((len(texts), words), np.uint64)
        edge = np.searchsorted(text, np.arange(len(texts) + 1))
        step = max(1, (_AT_ONCE * 8) // (words * 64))
        for lo in range(0, len(texts), step):
            hi = min(len(texts), lo + step)
            flat = np.zeros((hi - lo, words * 64), bool)
            flat[text[edge[lo] : edge[hi]] - lo, bit[edge[lo] : edge[hi]]] = True
            self.bits[lo:hi] = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many trigrams texts ``i`` and ``j``, two different rows, share, pair by pair."""
        out, step = np.zeros(len(i), np.int64), max(1, _AT_ONCE // self.bits.shape[1])
        for lo in range(0, len(i), step):
            part = slice(lo, lo + step)
            out[part] = np.bitwise_count(self.bits[i[part]] & self.bits[j[part]]).sum(axis=1, dtype=np.int64)
        return out

    def smaller(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.minimum(self.size[i], self.size[j])


def millionths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole to six places, halves up, in millionths."""
    return (2_000_000 * part + whole) // np.maximum(2 * whole, 1)
