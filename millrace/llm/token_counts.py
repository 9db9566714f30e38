"""Token counts (operator 2): lengths only, batches balanced by bytes, long texts cut at safe boundaries.

Results: one row per row of the table; a null text counts as empty (0 bytes, 0 tokens); repeated rows stay repeated;
null ids stay null; columns other than the id and the text are not read, whatever their names; an empty table gives
an empty result.  Texts are never truncated.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import words as W
from millrace.llm.common import id_text, table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of text that are worked on at once, and distinct pieces that a task remembers.
BATCH_BYTES, REMEMBER = 4 << 20, 1 << 20


def safe_cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and before ASCII white space that follows a character surely not white space.

    The byte-level pre-tokenizer never joins a character that isn't white space to white space after it, nor looks
    back, so the pieces' counts add up to the text's.  "Surely": printable ASCII, or a two-byte character whose lead
    byte is above 0xC2; all of Unicode's white space lies elsewhere.
    """
    n = len(raw)
    cut = np.zeros(n, bool)
    white = W._GAP[raw]
    solid = (raw > 0x20) & (raw < 0x7F)
    solid[1:] |= (raw[:-1] > 0xC2) & (raw[:-1] < 0xE0)
    cut[1:] = white[1:] & solid[:-1]
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


class _PieceCounter:
    """Counts of whole texts from a tokenizers file; each distinct piece is encoded once while it is remembered, by its bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known = Tokenizer.from_file(path), {}
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = self.tok.pre_tokenizer
        self.cuttable = type(pre).__name__ == "ByteLevel" and self.tok.normalizer is None and not pre.add_prefix_space and not any(
            t.lstrip or t.rstrip or any(map(str.isspace, t.content)) for t in self.tok.get_added_tokens_decoder().values()
        )

    def plain(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.cuttable:
            data = raw.tobytes()
            return np.array(self.plain([data[a:b].decode() for a, b in zip(at[:-1], at[1:])]), np.int64)
        start = safe_cuts(raw, at)
        if not len(start):
            return np.zeros(len(at) - 1, np.int64)
        end = np.append(start[1:], len(raw))
        _, first, which = np.unique(W.hashes(raw, start, end), return_index=True, return_inverse=True)
        # The hash only gathers pieces: what counts is the piece itself, byte by byte.
        alike = W.same(raw, start, end, raw, start[first][which], end[first][which])
        data, known = raw.tobytes(), self.known
        piece = lambda i: data[start[i] : end[i]]
        pieces = [piece(i) for i in first.tolist()]
        new = [p for p in pieces if p not in known] + [p for i in np.flatnonzero(~alike) if (p := piece(i)) not in known]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            known.update(zip(part, self.plain([p.decode() for p in part])))
        each = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))[which]
        for i in np.flatnonzero(~alike):
            each[i] = known[piece(i)]
        sums = np.zeros(len(start) + 1, np.int64)
        np.cumsum(each, out=sums[1:])
        if len(known) > REMEMBER:
            known.clear()
        edge = np.searchsorted(start, at)
        return sums[edge[1:]] - sums[edge[:-1]]


class _SentencePieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        data = raw.tobytes()
        return np.array([len(x) for x in self.tok.encode([data[a:b].decode() for a, b in zip(at[:-1], at[1:])], num_threads=1)], np.int64)


def counter(path: str):
    return (_SentencePieceCounter if path.endswith(".model") else _PieceCounter)(path)


def lengths(count, texts: pa.Array, batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text; ``count`` gets about ``batch_bytes`` at a time, longer texts in several parts."""
    raw, at = W.buffers(texts)
    size, tokens = np.diff(at), np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + batch_bytes, "right")) - 1)
        part, part_at = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        if hi == lo + 1 and len(part) > 2 * batch_bytes and getattr(count, "cuttable", False):
            cuts = safe_cuts(part, part_at)
            for a, b in zip(edges := [0, *_spread(cuts, batch_bytes)], [*edges[1:], len(part)]):
                tokens[lo] += count(part[a:b], np.array([0, b - a]))[0]
        else:
            tokens[lo:hi] = count(part, part_at)
        lo = hi
    return size, tokens


def _spread(cuts: np.ndarray, step: int) -> list[int]:
    """Of the safe cuts, some that lie at least ``step`` apart."""
    out, last = [], 0
    while (i := int(np.searchsorted(cuts, last + step))) < len(cuts):
        last = int(cuts[i])
        out.append(last)
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, as the library of the file at ``tokenizer_path`` counts.

    The path must be readable on every executor (an installed file or one sent with ``addFile``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            size, tokens = lengths(count, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
