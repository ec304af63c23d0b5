"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. A fixed random rotation spreads that
distance over the coordinates, which are cut into low-dimensional blocks; each block has a budget in
proportion to its dimensions. Two linked vectors keep within budget in one block at least, so a range
join of every block finds every link. In a block, a vector goes to the grid cells (of its first `axes`
coordinates) that its range touches, and is at home in one of them.

The join has two steps. The first ships a block's coordinates alone, in whole 128ths of the range, and finds
the vectors that have another within budget in the block; a cell's rows meet by finer cells of as many of the
block's other coordinates as their number calls for. Rounding only adds to what it admits. The second takes
whole vectors of those alone, few but for true near copies: a pair counts in the cell where one is at home,
in the first block that admits it, and is verified exactly in double precision.

Copies fall together first, told by 128 bits of a hash (copies that it told apart would still be linked).
Cells over `limit` rows are cut into chunks, and pairs of chunks go to different tasks. A task emits a link
count for each vector and a spanning set of links, never all pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows of null
label, link with nothing; they get a row with n_links 0 and their own class. Labels of any type are equal if
their text is. Vectors of different dimensions link with nothing; repeated ids are rows of their own; a null
vec_id is never a class id; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import ann, common, simhash

COSINE = 0.98
BLOCK_DIMS = 8
AXES = 2
LIMIT = 2048
#: Room for rounding in the rotated coordinates, of unit vectors.
EASE = 1e-6
#: Candidate pairs verified at a time; their vectors are gathered.
PAIRS = 32_768
#: Parts of the range that a shipped coordinate counts in, and coordinates of a shipped block (zeros fill up).
PARTS = 128
WIDE = BLOCK_DIMS + BLOCK_DIMS // 2
#: Rows that are broadcast.
FEW = 100_000


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cuts(dims: int, width: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    """Blocks of about width coordinates that cover all."""
    n = max(1, round(dims / width))
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _turned(own: pa.RecordBatch, turns: dict[int, np.ndarray]) -> np.ndarray:
    """Rotated unit vectors of rows of one dimension."""
    x = ann._matrix(own.column("vector"))
    dim = x.shape[1]
    if dim not in turns:
        turns[dim] = rotation(dim)
    return (x / np.sqrt(ann.dots(x, x))[:, None]) @ turns[dim]


def _touched(y: np.ndarray, reach: float, axes: int, one_sided: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their cells as codes, whether at home) for each cell, of the first axes, that ranges touch.

    one_sided: on the first axis a range reaches down only, so of two rows within reach one meets the other's home.
    """
    side = 2 * reach  # a range touches two cells an axis at most
    y = y[:, :axes]
    low, high, home = (np.floor(v / side).astype(np.int64) for v in (y - reach, y + reach, y))
    if one_sided:
        high[:, 0] = home[:, 0]
    for step in np.ndindex(*[2] * y.shape[1]):
        cell = low + np.array(step)
        rows = np.flatnonzero((cell <= high).all(1))
        cell = cell[rows]
        code = np.zeros(len(rows), dtype=np.int64)
        for a in range(y.shape[1]):  # coordinates of unit vectors: a few hundred cells an axis at most
            code = code * 65_536 + cell[:, a] + 32_768
        if len(rows):
            yield rows, code, (cell == home[rows]).all(1)


def cells(vectors: DataFrame, cosine: float, width: int, axes: int) -> DataFrame:
    """A row (node, label, dim, block, cell, home, times, vector) for each cell that a vector's range touches in its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                y = _turned(own, turns)
                wanted = own.column("blocks")
                of = np.repeat(np.arange(len(own)), wanted.value_lengths().to_numpy())
                wanted = wanted.flatten().to_numpy()
                for block, (lo, hi) in enumerate(cuts(int(dim), width)):
                    mine = of[wanted == block]
                    reach = np.sqrt((2 - 2 * cosine) * (hi - lo) / dim + EASE)
                    for rows, code, home in _touched(y[mine, lo:hi], reach, min(axes, hi - lo), False) if len(mine) else ():
                        part = own.take(pa.array(mine[rows]))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("node"), part.column("label"), part.column("dim"), pa.array(np.full(len(rows), block, np.int32)), pa.array(code)]
                            + [pa.array(home), part.column("times"), part.column("vector")],
                            ["node", "label", "dim", "block", "cell", "home", "times", "vector"],
                        )

    kind = vectors.schema["vector"].dataType.simpleString()
    schema = f"node long, label string, dim int, block int, cell long, home boolean, times long, vector {kind}"
    return common.map_arrow(vectors.select("node", "label", "dim", "times", "vector", "blocks"), run, schema, 4096)


def parts(vectors: DataFrame, cosine: float, width: int, axes: int) -> DataFrame:
    """A row (key, node, block, home, z) for each cell that a vector's range touches, in all its blocks.

    key: a hash of label, dimension, block and cell. z: the block's coordinates, 2 bytes each, in parts of the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                y = _turned(own, turns)
                for block, (lo, hi) in enumerate(cuts(int(dim), width)):
                    reach = np.sqrt((2 - 2 * cosine) * (hi - lo) / dim + EASE)
                    z = np.zeros((len(own), max(WIDE, width * 2)), dtype="<i2")
                    # cutting off what is far out only brings it nearer
                    z[:, : hi - lo] = np.clip(np.round(y[:, lo:hi] / reach * PARTS), -32_000, 32_000)
                    for rows, code, home in _touched(y[:, lo:hi], reach, min(axes, hi - lo), True):
                        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(z.shape[1] * 2), len(rows), [None, pa.py_buffer(z[rows].tobytes())])
                        part = own.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("node"), part.column("label"), part.column("dim"), pa.array(np.full(len(rows), block, np.int32)), pa.array(code), pa.array(home), held.cast(pa.binary())],
                            ["node", "label", "dim", "block", "cell", "home", "z"],
                        )

    out = common.map_arrow(vectors.select("node", "label", "dim", "vector"), run, "node long, label string, dim int, block int, cell long, home boolean, z binary", 4096)
    return out.select(F.xxhash64("label", "dim", "block", "cell").alias("key"), "node", "block", "home", "z")


def fine_pairs(z: np.ndarray, group: np.ndarray, home: np.ndarray, side: np.ndarray, axes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a row, a row at home) of a group whose ranges share a finer cell, in pieces; those within range are all among them.

    z: coordinates in units of the range. Rows of side 1 meet side 2, those of side 0 each other.
    """
    at_home = np.bincount(group[home], minlength=group.max() + 1)
    # each more axis leaves some 0.57 of the pairs and doubles the cells that a row looks up
    depth = np.round(np.log(2 * np.maximum(at_home, 1)) / 1.25).astype(int).clip(0, min(6, z.shape[1] - axes))
    reach = 1 + 1 / PARTS
    for k in np.unique(depth):
        rows = np.flatnonzero((depth[group] == k) & (at_home[group] > 0))
        sub = z[:, axes : axes + k]
        own = rows[home[rows]]
        # a cell's code is linear in its numbers, so that the next cell of an axis is a fixed step away; it wraps, and cells that agree by chance only add pairs
        steps = np.array([pow(6_364_136_223_846_793_005, a + 1, 1 << 64) for a in range(k)], dtype=np.uint64)

        def code(who: np.ndarray, cell: np.ndarray) -> np.ndarray:
            return group[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (cell.astype(np.int64).view(np.uint64) * steps).sum(1, dtype=np.uint64)

        held = code(own, np.floor(sub[own] / 2))
        order = np.argsort(held, kind="stable")
        held, own = held[order], own[order]
        low, high = (np.floor((sub[rows] + r) / 2) for r in (-reach, reach))
        base = code(rows, low)
        two = ((high > low) << np.arange(k)).sum(1)  # the axes on which a row touches a second cell
        for bits in range(1 << int(k)):
            ok = np.flatnonzero((two & bits) == bits)
            key = base[ok] + steps[[a for a in range(k) if bits >> a & 1]].sum(dtype=np.uint64)
            start = np.searchsorted(held, key, "left")
            hit = held[np.minimum(start, len(held) - 1)] == key
            who, key, start = rows[ok[hit]], key[hit], start[hit]
            n = np.searchsorted(held, key, "right") - start
            ends = np.cumsum(n)
            at = 0
            while at < len(who):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                i = np.repeat(who[at:to], n[at:to])
                j = own[np.repeat(start[at:to] - np.r_[0, np.cumsum(n[at:to])[:-1]], n[at:to]) + np.arange(len(i))]
                meet = (i != j) & ((side[i] == 0) | (side[i] != side[j]))
                yield i[meet], j[meet]
                at = to


def admitted(vectors: DataFrame, cosine: float, width: int, axes: int, limit: int) -> DataFrame:
    """(node, blocks): the vectors that have another within a block's budget, and those blocks."""
    keys = ["key", "gi", "gj"]
    dealt = common.paired_chunks(parts(vectors, cosine, width, axes), ["key"], "node", limit)
    budget = (1 + np.sqrt(max(WIDE, width * 2)) / PARTS + 1e-4) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, keys, 8192):
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            held = t.column("z").combine_chunks()
            z = np.frombuffer(b"".join(held.to_pylist()), dtype="<i2").reshape(t.num_rows, -1) / np.float32(PARTS)
            mark = np.zeros(t.num_rows, dtype=bool)
            for i, j in fine_pairs(z, np.cumsum(new), t.column("home").to_numpy(), t.column("side").to_numpy(), axes):
                open_ = ~(mark[i] & mark[j])
                i, j = i[open_], j[open_]
                gap = z[i] - z[j]
                near = np.einsum("ij,ij->i", gap, gap) <= budget
                mark[i[near]] = mark[j[near]] = True
            if mark.any():
                yield t.select(["node", "block"]).filter(pa.array(mark)).combine_chunks().to_batches()[0]

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "block", "home", "side", "z")
    found = common.map_arrow(dealt, run, "node long, block int", 8192)
    return found.groupBy("node").agg(F.collect_set("block").alias("blocks"))  # as many as a vector has blocks, at most


def matched(x: np.ndarray, y: np.ndarray, block: int, spans: list[tuple[int, int]], cosine: float, i0: int, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of rows, of cols; positions in x) that block admits, no earlier block does, and whose cosine is high enough."""
    budget = 2 - 2 * cosine
    lo, hi = spans[block]
    a, b = y[rows, lo:hi], y[cols, lo:hi]
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(far <= budget * (hi - lo) / y.shape[1] + EASE)
    i, j = rows[i], cols[j]
    keep = i < j if i0 == 0 else np.ones(len(i), dtype=bool)
    i, j = i[keep], j[keep]
    norm = np.sqrt(ann.dots(x, x))
    found = [_verified(x, y, norm, block, spans, cosine, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _verified(x: np.ndarray, y: np.ndarray, norm: np.ndarray, block: int, spans: list[tuple[int, int]], cosine: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for at, (lo, hi) in enumerate(spans[: block + 1]):
        # the same test wherever a pair is met, so exactly one block counts it
        gap = y[i, lo:hi] - y[j, lo:hi]
        within = ann.dots(gap, gap) <= (2 - 2 * cosine) * (hi - lo) / y.shape[1] + EASE / 2
        i, j = (i[within], j[within]) if at == block else (i[~within], j[~within])
    ok = ann.dots(x[i], x[j]) / (norm[i] * norm[j]) >= cosine
    return i[ok], j[ok]


def join(vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK_DIMS, axes: int = AXES, limit: int = LIMIT) -> DataFrame:
    """Of distinct vectors (node, label, dim, times, vector): rows (a, b, links).

    links 0: a link between nodes a and b, enough of them to connect what links connect.
    links > 0: so many linked rows (by times) of node a, of those met in one task; b is null.
    """
    near = common.stored(admitted(vectors, cosine, width, axes, limit), "admitted")
    near = F.broadcast(near) if near.count() <= FEW else near.hint("merge")
    keys = ["label", "dim", "block", "cell", "gi", "gj"]
    dealt = common.paired_chunks(common.stored(cells(vectors.join(near, "node"), cosine, width, axes), "cells"), keys[:4], "node", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for t in common.whole_groups(batches, keys, 2048):
            t = t.combine_chunks()
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.ones(t.num_rows, dtype=bool)
            if t.num_rows > 1:
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            cut = np.flatnonzero(new)
            nodes, times = t.column("node").to_numpy(), t.column("times").to_numpy()
            home, side = t.column("home").to_numpy(), t.column("side").to_numpy()
            out_a, out_b, out_n = [], [], []
            for lo, hi in zip(cut, [*cut[1:], t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                x = ann._matrix(t.column("vector").slice(lo, hi - lo).combine_chunks())
                dim, block = x.shape[1], int(cols[2][lo])
                if dim not in turns:
                    turns[dim] = rotation(dim)
                y = (x / np.sqrt(ann.dots(x, x))[:, None]) @ turns[dim]
                s = side[lo:hi]
                alone = cols[4][lo] == cols[5][lo]
                left = np.arange(hi - lo) if alone else np.flatnonzero(s == 1)
                right = left if alone else np.flatnonzero(s == 2)
                count = np.zeros(hi - lo, dtype=np.int64)
                first = np.arange(hi - lo)
                for at in range(0, len(left), 512):
                    i, j = matched(x, y, block, cuts(dim, width), cosine, 0 if alone else 1, left[at : at + 512], right)
                    # a pair that several cells share counts where the other one is at home
                    np.add.at(count, i, times[lo:hi][j] * home[lo:hi][j])
                    np.add.at(count, j, times[lo:hi][i] * home[lo:hi][i])
                    first = simhash.union_labels(hi - lo, i, j, first)
                moved = np.flatnonzero(first != np.arange(hi - lo))
                out_a += [nodes[lo:hi][moved], nodes[lo:hi][count > 0]]
                out_b += [nodes[lo:hi][first[moved]], np.full((count > 0).sum(), -1)]
                out_n += [np.zeros(len(moved), dtype=np.int64), count[count > 0]]
            if sum(map(len, out_a)):
                b = np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(b, pa.int64(), mask=b < 0), pa.array(np.concatenate(out_n))], ["a", "b", "links"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "home", "side", "times", "vector")
    return common.map_arrow(dealt, run, "a long, b long, links long", 4096)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, width: int = BLOCK_DIMS, axes: int = AXES, limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of embeddings (vec_id, embedding, label)."""
    e = embeddings.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string"))
    exact = e.schema["embedding"].dataType.elementType.simpleString() in ("float", "double")
    vector = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    e = e.withColumn("vector", F.when(ann.usable("embedding") & F.col("label").isNotNull(), vector)).drop("embedding")
    # two hashes tell vectors apart; rows that take no part have none
    e = e.withColumns({f"h{i}": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(i), "vector")) for i in (1, 2)})
    same = e.where("vector is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    # a node is a distinct vector of a label; ids are dealt without a shuffle and then written
    same = common.stored(same.withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = common.stored(join(same.select("node", "label", F.size("vector").alias("dim"), "times", "vector"), cosine, width, axes, limit), "links")
    same = same.drop("vector")
    roots = common.components(found.where("links = 0").select("a", "b"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    joined = common.stored(roots.withColumnRenamed("v", "node").join(same.select("node", "rep"), "node"), "joined")
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    classes = same.join(joined.join(least, "root").select("node", "least"), "node", "left").join(counts, "node", "left")
    classes = classes.select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("least", "rep").alias("class"))
    out = e.select("vec_id", "label", "h1", "h2").join(classes, ["label", "h1", "h2"], "left").withColumn("component_id", F.coalesce("class", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
