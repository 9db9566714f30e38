"""Embedding near-dedup (operator 5): a forest of random-projection trees with spill, exact comparison within leaves.

Each tree splits at the median of a random projection, recursively; vectors within a margin of the median go both ways,
so near pairs rarely part.  A node that the margin would mostly duplicate is a dense group and stays whole.  The trees
are fitted on a sample of at most ``SAMPLE`` vectors (a documented bound); every vector is indexed by every tree.  Leaves
that the whole table fills beyond ``GROWN`` times their size are split further by their own members, round by round.
Within a leaf all pairs are compared by cosine in double precision; a large leaf is dealt into blocks, and each pair of
blocks is a group of its own, so no leaf is held in one task.  A pair that meets in several leaves counts in the first.
Exact copies are merged beforehand and counted by weight.

Results: one row per row of the table.  Vectors that are null, zero or hold null or non-finite components, rows without
an id, and vectors of different lengths link with nothing; rows that repeat an id and vector are one vector; labels and
other columns are not read.  Recall against brute force is measured in the tests (at least 0.9).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import components, materialise, small, table

COSINE, TREES, LEAF, BLOCK, SAMPLE, COMPONENTS, SPILLED = 0.95, 6, 400, 1024, 20_000, 4_000_000, 0.5
#: A leaf of so many times its size is split on; directions a round to choose from; leaves (24 bytes each) to broadcast.
GROWN, DIRECTIONS, BROADCAST_LEAVES = 4, 256, 1_000_000


@dataclass(frozen=True)
class Tree:
    """Per inner node: direction, median, children (negative: leaf -1 - id); ids of leaves go on from tree to tree."""

    direction: np.ndarray
    median: np.ndarray
    child: np.ndarray
    root: int

    def leaves(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they fall into, several a row where they spill."""
        rows, node, out = np.arange(len(x)), np.full(len(x), self.root), []
        while len(rows):
            done = node < 0
            out.append((rows[done], -1 - node[done]))
            rows, node = rows[~done], node[~done]
            off = np.einsum("ij,ij->i", x[rows], self.direction[node]) - self.median[node]
            low, high = off <= margin, off >= -margin
            rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([self.child[node[low], 0], self.child[node[high], 1]])
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def margin_of(cosine: float, dims: int) -> float:
    """Half the typical distance of a just-linked pair along a random direction."""
    return 0.5 * np.sqrt(2 - 2 * cosine) / np.sqrt(dims)


def grow(sample: np.ndarray, total: int, trees: int, leaf: int, cosine: float, seed: int = 11) -> list[Tree]:
    rng, margin, out, leaves = np.random.default_rng(seed), margin_of(cosine, sample.shape[1]), [], 0
    enough = max(8, leaf * len(sample) / max(total, 1))
    for _ in range(trees):
        direction, median, child = [], [], []

        def split(x: np.ndarray) -> int:
            nonlocal leaves
            if len(x) > enough:
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x @ d
                m = float(np.median(p))
                low, high = p <= m + margin, p >= m - margin
                if (low & high).mean() <= SPILLED and max(low.sum(), high.sum()) < len(x):
                    me = len(direction)
                    direction.append(d), median.append(m), child.append([0, 0])
                    child[me] = [split(x[low]), split(x[high])]
                    return me
            leaves += 1
            return -leaves

        root = split(sample)
        out.append(Tree(np.array(direction).reshape(-1, sample.shape[1]), np.array(median), np.array(child, np.int64).reshape(-1, 2), root))
    return out


def _unit(b: pa.Array, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(b.to_pylist()), np.float64).reshape(len(b), dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and the bytes of the vector in double precision, of vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x + 0.0  # one zero
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append((x / np.abs(x).max()).tobytes() if not np.isfinite((x * x).sum()) or (x * x).sum() < 1e-200 else x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def _compare(x: np.ndarray, y: np.ndarray, seen_x: np.ndarray, seen_y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each pair links and has not met in an earlier leaf."""
    return (x @ y.T >= cosine) & ((seen_x.astype(np.float32) @ seen_y.T.astype(np.float32)) == 0)


def _group(leaf: int, own, rep, weight, x, held: list, cosine: float):
    """(rep, links) of this group and (a, b) edges that span what it links."""
    # Only earlier leaves that hold several of the group's vectors can have shown a pair of them.
    of = np.repeat(np.arange(len(rep)), [len(h) for h in held])
    found, which, members = np.unique(np.concatenate([np.asarray(h, np.int64) for h in held]), return_inverse=True, return_counts=True)
    used = (members > 1) & (found < leaf)
    hit = used[which]
    seen = np.zeros((len(rep), used.sum()), bool)
    seen[of[hit], (np.cumsum(used) - 1)[which[hit]]] = True
    one = own.min() == own.max()
    left = np.flatnonzero(own == own.min())
    right = left if one else np.flatnonzero(own == own.max())
    linked = _compare(x[left], x[right], seen[left], seen[right], cosine)
    if one:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(rep), np.int64)
    links[left] += linked @ weight[right]
    if not one:
        links[right] += linked.T @ weight[left]
    some = links > 0
    label = np.arange(len(rep))
    while some.any():
        new, far = label.copy(), len(rep)
        new[left] = np.minimum(new[left], np.where(linked, label[right][None, :], far).min(1, initial=far))
        new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], far).min(0, initial=far))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return rep[some], links[some], rep[label[some]]


def _comparer(dims: int, cosine: float):
    def compare(t: pa.Table) -> pa.Table:
        x, held = _unit(t.column("v").combine_chunks(), dims), t.column("held").to_pylist()
        a, n, b = _group(t.column("leaf")[0].as_py(), *(t.column(k).to_numpy() for k in ("own", "rep", "weight")), x, held, cosine)
        return pa.table({"a": a, "n": n, "b": b})

    return compare


def near_duplicates(
    rows: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = rows.select(rows[f"`{id_col}`"].cast("long").alias("vec_id"), rows[f"`{vector_col}`"].alias("v"))
    spark = rows.sparkSession
    usable = materialise(_usable(rows).distinct().withColumn("vkey", F.unhex(F.md5("v"))))
    reps = materialise(usable.groupBy("vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")))
    shapes = [r["d"] for r in reps.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    counted = edges = None
    for dims in shapes:  # vectors of one length at a time; a table has one as a rule
        own = reps.where(F.octet_length("v") == 8 * dims)
        total = own.count()
        picked = own.orderBy(F.xxhash64("vkey"), "rep").limit(max(1, min(sample, COMPONENTS // dims))).select("v").toArrow()
        forest = grow(_unit(picked.column("v").combine_chunks(), dims), total, trees, leaf, cosine)
        leafed = _refined(materialise(_leaves(own, forest, dims, cosine)), GROWN * leaf, dims, cosine)
        per_leaf = materialise(leafed.groupBy("leaf").agg(F.count("*").alias("n")))
        dealt = leafed.join(small(per_leaf, BROADCAST_LEAVES), "leaf").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        dealt = dealt.where("n > 1").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "held", "v")

        found = materialise(dealt.groupBy("leaf", "i", "j").applyInArrow(_comparer(dims, cosine), "a long, n long, b long"))
        part = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        counted, edges = (part, found) if counted is None else (counted.union(part), edges.union(found))
    if counted is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    label = components(edges.select("a", "b"))
    classed = (
        reps.select("vkey", "rep", "weight").join(counted, "rep", "left").join(label, reps["rep"] == label["node"], "left")
        .select("vkey", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    ids = usable.select("vec_id", "vkey").join(classed, "vkey").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(ids, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _leaves(reps: DataFrame, forest: list[Tree], dims: int, cosine: float) -> DataFrame:
    """A row for each vector and leaf it is in, with all leaves that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("v"), dims)
            parts = [t.leaves(x, margin_of(cosine, dims)) for t in forest]
            row, leaf = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            edge = np.searchsorted(row, np.arange(len(x) + 1))
            held = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(leaf.astype(np.int64))).take(pa.array(row))
            taken = [b.column(k).take(pa.array(row)) for k in ("rep", "weight", "v")]
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), *taken[:2], held, taken[2]], ["leaf", "rep", "weight", "held", "v"])

    return reps.select("rep", "weight", "v").mapInArrow(run, "leaf long, rep long, weight long, held array<long>, v binary")


def _projected(rows: DataFrame, turn: int, dims: int) -> DataFrame:
    """Adds ``p``, the place of each vector along one of the round's directions, which its leaf's id picks."""
    directions = np.random.default_rng(1000 + turn).standard_normal((DIRECTIONS, dims))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = b.column("leaf").to_numpy()
                p = np.einsum("ij,ij->i", _unit(b.column("v"), dims), directions[leaf % DIRECTIONS])
                yield b.append_column("p", pa.array(p))

    return rows.mapInArrow(run, "leaf long, rep long, weight long, v binary, p double")


def _refined(leafed: DataFrame, most: int, dims: int, cosine: float) -> DataFrame:
    """``leafed`` with its leaves of over ``most`` vectors split by random projections at their own members' medians.

    The sample bounds how deep the trees are, so without this leaves would grow with the table.  Medians are approximate
    and merged before the shuffle; no leaf is gathered anywhere.  As in the trees, vectors within the margin go both
    ways, and a leaf that the margin would mostly duplicate stays whole.  Ids of new leaves are hashes: two that are
    equal make one leaf, which costs comparisons and no link.
    """
    margin, closed, open_, turn = margin_of(cosine, dims), [], leafed.drop("held"), 0
    while True:
        large = materialise(open_.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if large.isEmpty():
            break
        placed = _projected(open_.join(small(large.select("leaf"), BROADCAST_LEAVES), "leaf", "left_semi").select("leaf", "rep", "weight", "v"), turn, dims)
        spread = placed.groupBy("leaf").agg(F.percentile_approx("p", F.array(*(F.lit(k / 100) for k in range(101))), 500).alias("q"), F.min("p").alias("lo"), F.max("p").alias("hi"))
        middle = F.col("q")[50]
        spilled = F.size(F.filter("q", lambda x: F.abs(x - F.col("q")[50]) <= margin)) / 101
        cuts = materialise(spread.where((spilled <= SPILLED) & (F.col("lo") < middle - margin) & (F.col("hi") > middle + margin)).select("leaf", middle.alias("m")))
        if cuts.isEmpty():
            break
        cuts = small(cuts, BROADCAST_LEAVES)
        side = lambda k, test: F.when(test, F.xxhash64("leaf", F.lit(k)))
        sides = F.array_compact(F.array(side(0, F.col("p") <= F.col("m") + margin), side(1, F.col("p") >= F.col("m") - margin)))
        closed.append(open_.join(cuts, "leaf", "left_anti").select("leaf", "rep", "weight", "v"))
        open_ = materialise(placed.join(cuts, "leaf").select(F.explode(sides).alias("leaf"), "rep", "weight", "v"))
        turn += 1
    if not closed:
        return leafed
    rows = open_
    for part in closed:
        rows = rows.unionByName(part)
    rows = materialise(rows.dropDuplicates(["leaf", "rep"]))
    held = rows.groupBy("rep").agg(F.collect_set("leaf").alias("held"))  # a vector's copies: few a tree
    return materialise(rows.join(held, "rep").select("leaf", "rep", "weight", "held", "v"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
