"""Toxicity (operator 10): weak supervision.

Many voters vote toxic, clean or nothing on a document: lexicons of insults written down here, one for each theme and
language; families of word stems proposed on labelled training rows, in whatever language (a stem that toxic documents
hold far more often than others joins the voter of its beginning, so that related words speak as one); and patterns of
shouting, stress and plain length.  A generative label model estimates how each voter votes in each class and which
voters depend on each other: given the class, votes form a tree in which each depends on one other (the tree of
largest conditional mutual information), and expectation maximisation over the counts of vote patterns fits tree and
tables together.  The labels anchor it: half of a pattern's class mass is what its rows' labels say, half what the
model says.  By likelihood alone the classes of a large sample are whatever splits the votes best, such as the language
of the insults.  A linear classifier is trained on the model's posteriors and scores every document, also those on
which no voter speaks.

Fitting reads at most ``FIT_ROWS`` labelled rows (a documented bound, which also bounds the stems); every document is
scored over its whole text.

Results: one row per row of the table; null and empty texts get the score of a document without evidence; repeated
rows get equal scores; null ids are held out; other columns are not read.  Without labels of both classes the score
is the share of label 1 (0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.common import held_out, id_text, labelled_sample, table

FIT_ROWS, SLICE = 20_000, 4 << 20
#: A stem enters the lexicon with this many documents of different texts, and this share of them toxic (smoothed), if chance
#: would bring so many toxic ones together for less than one stem of all that are tried.
LEAST_DOCS, LEAST_SHARE, FAMILIES, PREFIXES = 5, 0.9, 4, (4, 5, 6, 7, 8)
#: Insults by theme and language, whole words.
THEMES = (
    "idiot idiots moron morons stupid dumb imbecile fool foolish dimwit halfwit brainless retard retarded",
    "worthless pathetic loser losers trash garbage scum clown failure nobody useless rubbish vermin",
    "disgusting filthy vile gross repulsive sickening revolting creep pervert",
    "bitch bastard asshole dick fuck fucking shit slut whore",
    "die kill hate hang rot",
    "dumm idiotin trottel depp vollidiot schwachkopf versager abschaum dreck widerlich ekelhaft arschloch hurensohn",
    "idiote imbécile crétin débile abruti nul minable ordure dégoûtant connard salaud merde",
    "idiota imbécil estúpido tonto inútil basura asqueroso escoria cabrón mierda payaso patético",
)
_B = np.arange(256)
_BETWEEN = ~(((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 0x80))
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_KINDS = (None, *PREFIXES)


def stems(raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For whole words and each prefix length: the index of the text, the hash of the stem, and that of its beginning, of every word."""
    raw = _LOWER[raw]
    start, end, of = W.words(raw, at, _BETWEEN)
    out = []
    family = W.hashes(raw, start, np.minimum(start + 4, end))
    for size in _KINDS:
        long = slice(None) if size is None else end - start >= size
        stop = end[long] if size is None else start[long] + size
        out.append((of[long], W.hashes(raw, start[long], stop) ^ np.uint64(size or 0), family[long]))
    return out


def _themes() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, k) for k, theme in enumerate(THEMES) for w in theme.split()]
    raw = "".join(w for w, _ in words).encode()
    sizes = np.array([len(w.encode()) for w, _ in words])
    stop = np.cumsum(sizes)
    keys = W.hashes(np.frombuffer(raw, np.uint8), stop - sizes, stop) ^ np.uint64(0)
    order = np.argsort(keys)
    return keys[order], np.array([k for _, k in words])[order]


_THEME_KEYS, _THEME_OF = _themes()


@dataclass(frozen=True)
class Lexicon:
    """Sorted stem hashes, the voter each belongs to, and its log-odds."""

    keys: np.ndarray
    voter: np.ndarray
    odds: np.ndarray

    @property
    def voters(self) -> int:
        return FAMILIES * len(_KINDS)


def _per_slice(texts: pa.Array, work) -> np.ndarray:
    raw, at = W.buffers(texts)
    parts = [work(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in W.slices(at, SLICE)]
    return np.vstack(parts) if parts else np.zeros((0, 0))


def evidence(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: hits of each family of stems and each theme, then words, shouting, exclamations, summed log-odds and distinct stems hit."""

    def work(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        x = np.zeros((n, lexicon.voters + len(THEMES) + 5))
        found = stems(raw, at)
        for of, key, _ in found:
            if not len(lexicon.keys) or not len(key):
                continue
            i = np.minimum(np.searchsorted(lexicon.keys, key), len(lexicon.keys) - 1)
            hit = lexicon.keys[i] == key
            np.add.at(x, (of[hit], lexicon.voter[i[hit]]), 1)
            once = np.unique(np.stack([of[hit], i[hit]]), axis=1)
            np.add.at(x[:, -2], once[0], lexicon.odds[once[1]])
            np.add.at(x[:, -1], once[0], 1)
        first = lexicon.voters
        i = np.minimum(np.searchsorted(_THEME_KEYS, found[0][1]), len(_THEME_KEYS) - 1)
        hit = _THEME_KEYS[i] == found[0][1]
        np.add.at(x, (found[0][0][hit], first + _THEME_OF[i[hit]]), 1)
        first += len(THEMES)
        x[:, first] = np.bincount(found[0][0], minlength=n)
        for k, mask in enumerate(((raw >= 65) & (raw <= 90), raw == 33), 1):
            sums = np.concatenate([[0], np.cumsum(mask)])
            x[:, first + k] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
        return x

    return _per_slice(texts, work)


def votes(x: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing; a lexicon voter that misses says nothing, the patterns may speak for clean."""
    n = x.shape[1] - 5
    v = np.zeros((len(x), n + 4), np.int8)
    v[:, :n] = x[:, :n] > 0
    words, shout, bang, hits = x[:, n], x[:, n + 1], x[:, n + 2], x[:, n + 4]
    v[:, n] = np.where(hits >= 2, 1, np.where(hits == 0, -1, 0))
    v[:, n + 1] = np.where((hits == 0) & (words >= 40), -1, 0)
    v[:, n + 2] = np.where(shout > 0.3, 1, 0)
    v[:, n + 3] = np.where(bang > 0.05, 1, 0)
    return v


@dataclass(frozen=True)
class LabelModel:
    """Log-likelihood ratio of each vote given its parent's vote (voter, parent's vote, vote), parents (-1: none), prior log-odds."""

    ratio: np.ndarray
    parent: np.ndarray
    prior: float

    def evidence(self, v: np.ndarray) -> np.ndarray:
        z = np.zeros(len(v))
        for j, pa_ in enumerate(self.parent):
            z += self.ratio[j, 1 if pa_ < 0 else v[:, pa_].astype(int) + 1, v[:, j].astype(int) + 1]
        return z

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return _odds(self.evidence(v) + self.prior)


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _balanced(z: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The prior with which the posteriors add up to the class's share."""
    low, high = -200.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if (_odds(z + middle) * counts).sum() > share * counts.sum() else (middle, high)
    return (low + high) / 2


def _tree(joint: list[np.ndarray], least: float) -> np.ndarray:
    """Parents of the largest tree by mutual information given the class; links that tell less than ``least`` are left out."""
    voters = joint[0].shape[0]
    total = sum(j[0, :, 0, :].sum() for j in joint)
    info = np.zeros((voters, voters))
    for m in joint:  # (voter, vote, voter, vote) masses of one class
        both = m.transpose(0, 2, 1, 3) + 1e-9
        both = both / both.sum((2, 3), keepdims=True)
        apart = both.sum(3, keepdims=True) * both.sum(2, keepdims=True)
        info += (both * np.log(both / apart)).sum((2, 3)) * m[0, :, 0, :].sum() / total
    np.fill_diagonal(info, 0)
    parent, best, inside = np.full(voters, -1), info[0].copy(), np.zeros(voters, bool)
    near = np.zeros(voters, int)
    inside[0] = True
    while not inside.all():
        j = int(np.argmax(np.where(inside, -1, best)))
        parent[j] = near[j] if best[j] * total >= least else -1
        inside[j] = True
        closer = info[j] > best
        best, near = np.where(closer, info[j], best), np.where(closer, j, near)
    return parent


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, share: float, known: np.ndarray, rounds: int = 50) -> LabelModel:
    """EM over distinct vote patterns, their counts and the share of label 1 among each one's rows, where it starts and which
    keeps half of the mass; posteriors are held to the class's share."""
    voters = patterns.shape[1]
    onehot = np.stack([patterns == k for k in (-1, 0, 1)], axis=2).reshape(len(patterns), -1).astype(float)
    p = known
    for _ in range(rounds):
        mass = (p + known) / 2
        joint = [(onehot.T @ (onehot * (q * counts)[:, None])).reshape(voters, 3, voters, 3) for q in (1 - mass, mass)]
        parent = _tree(joint, 6.0)
        ratio = np.zeros((voters, 3, 3))
        for j, pa_ in enumerate(parent):
            like = []
            for m in joint:
                alone = np.diag(m[j, :, j, :]) + 0.5
                table = np.tile(alone, (3, 1)) if pa_ < 0 else m[pa_, :, j, :] + 2 * alone / alone.sum()
                like.append(table / table.sum(1, keepdims=True))
            ratio[j] = np.log(like[1] / like[0])
        model = LabelModel(ratio, parent, 0.0)
        model = LabelModel(ratio, parent, _balanced(model.evidence(patterns), counts, share))
        new = model.posterior(patterns)
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return model


def linear_features(x: np.ndarray) -> np.ndarray:
    n = x.shape[1] - 5
    words = np.maximum(x[:, n], 1)
    themes = n - len(THEMES)
    hits = np.column_stack([x[:, :themes].reshape(len(x), -1, FAMILIES).sum(2), x[:, themes:n].sum(1)])
    return np.column_stack(
        [np.ones(len(x)), np.log1p(hits), hits / words[:, None], np.log1p(x[:, n]), x[:, n + 1], x[:, n + 2], np.log1p(x[:, n + 3]), np.log1p(x[:, n + 4]), x[:, n + 3] / words]
    )


def fit_linear(f: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Ridge logistic regression on soft labels by Newton steps; returns weights and the features' scales."""
    scale = np.maximum(f.std(0), 1e-6)
    scale[0] = 1
    z, w = f / scale, np.zeros(f.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (q * (1 - q) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (p - q) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w, scale


@dataclass(frozen=True)
class ToxicityModel:
    share: float
    lexicon: Lexicon | None = None
    labels: LabelModel | None = None
    weights: np.ndarray | None = None
    scale: np.ndarray | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.lexicon is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.zeros(0)
        z = linear_features(evidence(texts, self.lexicon)) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _mine(sample: DataFrame, share: float) -> Lexicon:
    """Documents of each class that hold a stem, counted in Spark; the stems that toxic documents hold far more often.

    Copies of a text count once: all their words go together, whatever they mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = W.buffers(b.column("text"))
            y = b.column("y").to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(at, SLICE):
                for kind, (of, key, family) in enumerate(stems(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])):
                    order = np.lexsort((of, key))
                    of, key, family = of[order], key[order], family[order]
                    first = np.ones(len(key), bool)
                    first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                    keys, at_key, which = np.unique(key[first], return_index=True, return_inverse=True)
                    toxic = np.bincount(which, weights=y[lo + of[first]], minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array((family[first][at_key] % np.uint64(FAMILIES)).astype(np.int32)), pa.array(toxic),
                            pa.array(np.bincount(which, minlength=len(keys))),
                        ],
                        ["kind", "key", "family", "toxic", "docs"],
                    )

    once = sample.groupBy("text").agg(F.max("y").alias("y"))
    counted = once.mapInArrow(run, "kind int, key long, family int, toxic long, docs long").groupBy("kind", "key").agg(F.max("family").alias("family"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    smooth = (F.col("toxic") + 0.5 * share) / (F.col("docs") + 0.5)
    # Stems in LEAST_DOCS of the sample's documents at least: their number is bounded by the sample's words.
    tried = counted.agg(F.sum(F.when(F.col("docs") >= LEAST_DOCS, 1).otherwise(0)).alias("tried"))
    top = counted.where((F.col("toxic") >= LEAST_DOCS) & (smooth >= LEAST_SHARE)).crossJoin(F.broadcast(tried)).toPandas()
    q = top["toxic"].to_numpy() / top["docs"].to_numpy()
    # Chernoff's bound on so many toxic documents at the sample's share.
    chance = top["docs"].to_numpy() * (q * np.log(q / share) + (1 - q) * np.log(np.maximum(1 - q, 1e-9) / (1 - share)))
    top = top[chance >= np.log(np.maximum(top["tried"].to_numpy(float), 1))]
    order = np.argsort(key := top["key"].to_numpy(np.int64).view(np.uint64))
    voter = top["kind"].to_numpy(np.int64) * FAMILIES + top["family"].to_numpy(np.int64)
    p = (top["toxic"].to_numpy() + 0.5 * share) / (top["docs"].to_numpy() + 0.5)
    odds = np.log(p / np.maximum(1 - p, 1e-3)) - np.log(share / (1 - share))
    return Lexicon(key[order], voter[order], odds[order])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns from labelled rows whose crc32 remainder modulo 5 is not 0; ``docs`` has doc_id and text."""
    sample = labelled_sample(docs, labels, "toxic", 5, 0, fit_rows)
    n, toxic = sample.agg(F.count("*"), F.sum("y")).first()
    toxic = int(toxic or 0)
    if toxic < 2 or n - toxic < 2:
        return ToxicityModel(toxic / n if n else 0.0)
    share = toxic / n
    lexicon = _mine(sample, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = evidence(b.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.vstack(rows["x"].to_list())
    patterns, which, counts = np.unique(votes(x), axis=0, return_inverse=True, return_counts=True)
    known = np.bincount(which.ravel(), weights=rows["y"].to_numpy(), minlength=len(patterns)) / counts
    model = fit_label_model(patterns, counts, share, known)
    return ToxicityModel(share, lexicon, model, *fit_linear(linear_features(x), model.posterior(patterns)[which.ravel()]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
