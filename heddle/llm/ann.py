"""Nearest neighbours by inner product: vantage-point trees over shards of bounded size, cut by pivots.

Vectors go to the nearest of a bounded number of pivots, drawn by a hash; a pivot's vectors form one shard, or
several dealt by a hash where they are many. A query first searches the trees of its own pivot. Its 20th best there
is what others must reach: it goes on only to pivots whose ball (centre c, radius R) may hold better, as no inner
product in it is over q.c + |q| R.

Largest inner product becomes smallest distance by one more coordinate sqrt(M**2 - |x|**2), M the
shard's largest norm (0 for queries). A shard's tree splits at the median distance to a vantage point;
a child is skipped if the triangle inequality, its slack multiplied by `factor`, shows that nothing in
it can beat the 20th best so far; so is a ball, by its radius times `factor`. Factor 1 gives exact results (the
default); less prunes more. How much either prunes is up to the vectors: in many dimensions without clusters, nothing.

Queries travel in blocks; a pair of a block and a shard is one bounded task, and a query gathers k rows from each
shard that it meets. Scores are sums of products in double precision, coordinate by coordinate, so equal vectors
tie exactly and the smaller id goes first.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do null ids; a query meets only vectors of its own dimension; ids that repeat are all candidates,
but for rows with the query's own id; a query with no candidate gives no row; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm import common

K = 20
#: Every 20th id is a query.
EVERY = 20
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Pivots of a dimension, at most.
PIVOTS = 512
LEAF = 256
FACTOR = 1.0
#: What two orders of summation may differ by, for unit vectors; relative to the norms otherwise.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """True if a vector is not null, empty or zero and all its components are finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first coordinate to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


class VantageTree:
    """A tree over the rows of x; ids break ties."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.scanned = ids, x, 0
        self.norm = np.sqrt((x * x).sum(1))
        self.most = float(self.norm.max())
        self.lift()
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (lo, hi) of a leaf, or (vantage row, radius of the inner half, inner, outer)
        self.root = self._grow(0, len(x), leaf)

    def lift(self) -> None:
        self.lifted = np.c_[self.x, np.sqrt(np.maximum(self.most**2 - self.norm**2, 0))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "lifted"}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.lift()

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        if hi - lo <= leaf:
            self.nodes.append((lo, hi))
            return len(self.nodes) - 1
        own = self.order[lo:hi]
        # the row farthest from the first one sees the others at many distances
        v = own[np.argmax(((self.lifted[own] - self.lifted[own[0]]) ** 2).sum(1))]
        d = np.sqrt(((self.lifted[own] - self.lifted[v]) ** 2).sum(1))
        half = len(own) // 2
        at = np.argpartition(d, half)
        self.order[lo:hi] = own[at]
        inner, outer = d[at[:half]].max(), d[at[half:]].min()
        node = len(self.nodes)
        self.nodes.append(())
        a = self._grow(lo, lo + half, leaf)
        b = self._grow(lo + half, hi, leaf)
        self.nodes[node] = (v, inner, outer, a, b)
        return node

    def search(self, qids: np.ndarray, q: np.ndarray, k: int = K, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score): each query's k best in this tree, in no order; least: scores under it aren't wanted.

        `scanned` counts the products taken in leaves.
        """
        n = len(q)
        lifted = np.c_[q, np.zeros(n)]
        qn = np.sqrt((q * q).sum(1))
        slack = SLACK * qn * self.most
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), np.iinfo(np.int64).max)
        worst = np.full(n, -np.inf) if least is None else least.copy()

        def reach(rows: np.ndarray) -> np.ndarray:
            """How far a better vector may be: |q - x|**2 = |q|**2 + M**2 - 2 q.x."""
            far = qn[rows] ** 2 + self.most**2 - 2 * (worst[rows] - slack[rows])
            return np.sqrt(np.maximum(far, 0))

        def leaf(lo: int, hi: int, rows: np.ndarray) -> None:
            own = self.order[lo:hi]
            self.scanned += len(own) * len(rows)
            rough = q[rows] @ self.x[own].T
            i, j = np.nonzero(rough >= (worst[rows] - slack[rows])[:, None])
            r, x = rows[i], own[j]
            other = self.ids[x] != qids[r]
            r, x = r[other], x[other]
            if not len(r):
                return
            score = dots(q[r], self.x[x])
            hit, inv = np.unique(r, return_inverse=True)
            # each query's old best and new ones, best first
            rr = np.concatenate([np.repeat(np.arange(len(hit)), k), inv])
            ss = np.concatenate([best[hit].ravel(), score])
            ii = np.concatenate([who[hit].ravel(), self.ids[x]])
            order = np.lexsort((ii, -ss, rr))
            rr, ss, ii = rr[order], ss[order], ii[order]
            place = np.arange(len(rr)) - np.searchsorted(rr, rr)
            top = place < k
            best[hit] = ss[top].reshape(len(hit), k)
            who[hit] = ii[top].reshape(len(hit), k)
            worst[hit] = np.maximum(worst[hit], best[hit, -1])

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(self.nodes[node]) == 2:
                leaf(*self.nodes[node], rows)
                return
            v, inner, outer, a, b = self.nodes[node]
            d = np.sqrt(((lifted[rows] - self.lifted[v]) ** 2).sum(1))
            near = d <= (inner + outer) / 2
            visit(a, rows[near])
            visit(b, rows[~near])
            # inner rows lie within `inner` of v, outer ones beyond `outer`
            left = rows[near]
            visit(b, left[outer - d[near] <= factor * reach(left) + SLACK])
            right = rows[~near]
            visit(a, right[d[~near] - inner <= factor * reach(right) + SLACK])

        visit(self.root, np.arange(n))
        r, c = np.nonzero(best > -np.inf)
        return r, who[r, c], best[r, c]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _packed(df: DataFrame, keys: list[str], columns: list[str], build: int = 0) -> DataFrame:
    """A row (keys, blob) for each group of rows (keys, vec_id, vector, ...); build: the blob is a tree with such leaves, else
    it has the ids, the vectors as a matrix, and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, keys, 1):
            t = t.combine_chunks()
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            cut = np.flatnonzero(new)
            for lo, hi in zip(cut, [*cut[1:], t.num_rows], strict=True):
                part = t.slice(lo, hi - lo).combine_chunks()
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("vector").chunk(0))
                blob = pickle.dumps(VantageTree(ids, x, build) if build else (ids, x, *[part.column(c).to_numpy() for c in columns[2:]]), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([int(c[lo])], pa.int32()) for c in cols] + [pa.array([blob], pa.binary())], [*keys, "blob"])

    d = df.repartition(*keys).sortWithinPartitions(*keys)
    return common.stored(common.map_arrow(d.select(*keys, *columns), run, ", ".join(f"{k} int" for k in keys) + ", blob binary", 4096), "packed")


def _blocks(queries: DataFrame, rows: int) -> DataFrame:
    """(dim, cell, block, blob): queries (dim, cell, vec_id, vector, least) of a cell in blocks of some `rows`."""
    sizes = queries.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    d = queries.join(F.broadcast(common.stored(sizes, "sizes")), ["dim", "cell"])  # a row for each pivot
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), "blocks").cast("int"))
    return _packed(d, ["dim", "cell", "block"], ["vec_id", "vector", "least"])


def _searched(blocks: DataFrame, trees: DataFrame, parts: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, dim, vec_id, score): the k best of each query in each tree of the cell that its block is sent to.

    parts: (dim, cell, parts), how many trees a cell has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, queries, tree in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                ids, q, least = pickle.loads(queries.as_py())
                r, who, score = pickle.loads(tree.as_py()).search(ids, q, k, factor, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(np.full(len(r), dim, np.int32)), pa.array(who), pa.array(score)], ["query_id", "dim", "vec_id", "score"])

    sent = blocks.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = sent.select("dim", "cell", "part", F.col("blob").alias("queries")).join(trees.withColumnRenamed("blob", "tree"), ["dim", "cell", "part"])
    return common.map_arrow(pairs.select("dim", "queries", "tree"), run, "query_id long, dim int, vec_id long, score double", 1)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pivots_of(vectors: DataFrame, most: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension: a vector for each shard_rows, `most` at most, the first by a hash."""
    sizes = {r.dim: min(most, -(-r["count"] // shard_rows)) for r in vectors.groupBy("dim").count().collect()}  # a row for each dimension
    w = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(17), "vec_id", "vector"))
    drawn = vectors.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(sizes.values(), default=0)).collect()
    return {dim: np.unique(np.array([r.vector for r in drawn if r.dim == dim and r.n <= n]), axis=0) for dim, n in sizes.items()}


def celled(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors (vec_id, vector, dim) with cell, the number of the nearest pivot, its distance, and the vector's norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x, c = _matrix(own.column("vector")), pivots[int(dim)]
                cell = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
                far = np.sqrt(((x - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], [*own.schema.names, "cell", "far", "norm"])

    return common.map_arrow(vectors.select("vec_id", "vector", "dim"), run, "vec_id long, vector array<double>, dim int, cell int, far double, norm double", 4096)


def onward(queries: DataFrame, pivots: dict[int, np.ndarray], balls: dict[int, np.ndarray], factor: float) -> DataFrame:
    """(dim, cell, vec_id, vector, least): each query (dim, cell, vec_id, vector, least) for each other cell that may hold better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                q, c, (radius, norm) = _matrix(own.column("vector")), pivots[int(dim)], balls[int(dim)]
                length = np.sqrt((q * q).sum(1))[:, None]
                bound = np.minimum(q @ c.T + factor * length * radius[None, :], length * norm[None, :]) + SLACK * length * norm.max()
                go = bound >= own.column("least").to_numpy()[:, None]
                go[np.arange(len(q)), own.column("cell").to_numpy()] = False
                go[:, norm == 0] = False  # pivots without vectors
                for cell in np.flatnonzero(go.any(0)):
                    part = own.take(pa.array(np.flatnonzero(go[:, cell])))
                    yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(np.full(len(part), cell, np.int32)), part.column("vec_id"), part.column("vector"), part.column("least")], ["dim", "cell", "vec_id", "vector", "least"])

    return common.map_arrow(queries.select("dim", "cell", "vec_id", "vector", "least"), run, "dim int, cell int, vec_id long, vector array<double>, least double", 4096)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, most: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) with vec_id divisible by
    `every`, the k other rows of largest inner product; equal scores go by the smaller vec_id."""
    v = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    v = v.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dim"))
    pivots = pivots_of(v, most, shard_rows)
    d = common.stored(celled(v, pivots), "celled")
    cells = d.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.max("far").alias("radius"), F.max("norm").alias("norm"))
    cells = common.stored(cells, "cells")
    balls = {dim: np.zeros((2, len(c))) for dim, c in pivots.items()}
    for r in cells.collect():  # a row for each pivot
        balls[r.dim][:, r.cell] = r.radius, r.norm
    parts = F.broadcast(cells.select("dim", "cell", "parts"))  # a row for each pivot
    dealt = d.join(parts, ["dim", "cell"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "vec_id", "vector"), "parts").cast("int"))
    trees = _packed(dealt, ["dim", "cell", "part"], ["vec_id", "vector"], leaf)
    # of rows that share a query's id, the one with the least vector is the query
    asked = d.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min(F.struct("vector", "cell")).alias("m"))
    asked = common.stored(asked.select("vec_id", "dim", "m.vector", "m.cell"), "asked")
    none = F.lit(float("-inf"))
    home = common.stored(_best(_searched(_blocks(asked.withColumn("least", none), block_rows), trees, parts, k, factor), k, "query_id", "dim"), "home").drop("rank")
    least = home.groupBy(F.col("query_id").alias("vec_id"), "dim").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = asked.join(least, ["vec_id", "dim"], "left").withColumn("least", F.coalesce("kth", none))
    away = common.stored(onward(known, pivots, balls, factor), "away")
    found = home.unionByName(_searched(_blocks(away, block_rows), trees, parts, k, factor))
    return _best(found, k, "query_id").select("query_id", "rank", "vec_id", "score")
