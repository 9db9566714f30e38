"""Quality classifier (operator 9): regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the pooled diagonal; a document's score is the logistic of
the difference of the two Mahalanobis log-densities (plus log priors), computed with Cholesky factors cached in the
fitted model.  The model is fitted on at most ``FIT_ROWS`` labelled rows (a documented bound); every document is scored.

Results: one row per row of the table; null and empty texts get the score of their (all zero) statistics; repeated
rows get equal scores; null ids are held out; other columns are not read.  Without labels of both classes the score
is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import held_out, id_text, labelled_sample, table

FIT_ROWS, SHRINKAGE, SLICE = 20_000, 0.1, 4 << 20
NAMES = ("words", "word_bytes", "upper", "symbols", "bang_ends", "bare_symbols", "doubled", "repeated_triples", "lines", "digits", "stops", "symbol_ends", "pipes")
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0x80)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SYMBOL = np.isin(_BYTE, list(b"!#$%&*+/<=>@[\\]^_`{|}~"))
_STOP = np.isin(_BYTE, list(b".?!,;:"))


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of NAMES per text, transformed: logarithms of sizes, square roots of shares."""
    n = len(at) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(raw):
        return out

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    start, end, of = W.words(raw, at)
    word = W.hashes(raw, start, end)
    count = lambda mask, of=of: np.bincount(of[mask], minlength=n)
    n_words, n_bytes = np.bincount(of, minlength=n), np.diff(at)
    words1, bytes1 = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    ends = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    starts = raw[start] if len(start) else ends
    same = np.zeros(len(of), bool)
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    triple = W.windows(word, 3)
    inside = of[2:] == of[:-2]
    t_of, t_key = of[:-2][inside], triple[inside]
    again = 0
    if len(t_key):
        key = t_key ^ W.mix(t_of.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        twice = np.zeros(len(key), bool)
        twice[order[1:]] = key[order[1:]] == key[order[:-1]]
        again = np.bincount(t_of[twice], minlength=n)
    letters = per_text(_LETTER[raw])
    shares = (
        per_text(_UPPER[raw]) / np.maximum(letters, 1),
        per_text(_SYMBOL[raw]) / bytes1,
        count(ends == 33) / words1,
        count(_SYMBOL[starts] & _SYMBOL[ends]) / words1,
        count(same) / words1,
        again / words1,
        per_text(raw == 10) / words1,
        per_text(_DIGIT[raw]) / bytes1,
        count(_STOP[ends]) / words1,
        count(_SYMBOL[ends]) / words1,
        per_text(raw == 124) / words1,
    )
    out[:, 0], out[:, 1] = np.log1p(n_words), np.log1p(n_bytes / words1)
    for k, x in enumerate(shares, 2):
        out[:, k] = np.sqrt(x)
    return out


def all_statistics(texts: pa.Array) -> np.ndarray:
    raw, at = W.buffers(texts)
    parts = [statistics(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in W.slices(at, SLICE)]
    return np.vstack(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes; ``share`` alone where a class is missing."""

    share: float
    mean: np.ndarray | None = None
    white: np.ndarray | None = None
    constant: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.share)
        log = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.mean, self.white, self.constant)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    share = float(y.mean()) if len(y) else 0.5
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(share)
    groups = [x[y == c] for c in (0, 1)]
    within = np.vstack([g - g.mean(0) for g in groups])
    diagonal = within.var(0) + 1e-4
    mean, white, constant = [], [], []
    for g in groups:
        lower = np.linalg.cholesky((1 - shrinkage) * np.cov(g.T, bias=True) + shrinkage * np.diag(diagonal))
        mean.append(g.mean(0))
        white.append(np.linalg.inv(lower))
        constant.append(np.log(len(g) / len(x)) - np.log(np.diag(lower)).sum())
    return Discriminant(share, *map(np.array, (mean, white, constant)))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learns from labelled rows whose crc32 remainder modulo 3 is not 1; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = all_statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", 3, 1, fit_rows).mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "y"], kind="stable")  # the same sums whatever the partitions
    x = np.vstack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["y"].to_numpy(), shrinkage)


def quality_scorer(model: Discriminant):
    """A Column function text -> score that Arrow batches feed."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(all_statistics(pa.array(text, pa.large_string()))))

    return score


def score_quality(docs: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(all_statistics(b.column(1))))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
