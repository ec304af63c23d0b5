"""SimHash near-duplicates: fingerprints of word shingles, linked by Hamming distance through BK-trees.

Distinct fingerprints are dealt into shards by the pigeonhole rule: of `radius + 1` blocks of bits, two
fingerprints within `radius` agree in one block at least, so each block value is a shard and no pair
is lost. A shard holds a BK-tree (children keyed by integer Hamming distance to the parent); a probe
follows only edges within the radius. Shards are not broadcast whole: a tree would meet every probe
of the corpus, which grows with its square; a probe is sent to its own radius + 1 shards instead.
A shard over `limit` fingerprints is cut into chunks, and pairs of chunks go to different tasks.

Edge cases: a null or wordless text has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle; repeated rows each get a row; a null doc_id is never a class id
(a class of null ids alone has a null id); an empty table gives an empty result; other columns of the
input are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import common

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tree.
LIMIT = 16_384


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of words; one of the whole text if it has fewer words, none if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64 values."""
    return majority(hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): fp is the fingerprint as a signed long; th, a hash of the text, tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, fp long")


class Forest:
    """One BK-tree for each group, all in arrays; built and searched level by level."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """fp: uint64, distinct within a group; group: sorted codes from 0."""
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.root = first[group] if n else first
        parent = self.root.copy()
        self.edge = np.zeros(n, dtype=np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        rest = np.flatnonzero(np.arange(n) != self.root) if n else np.zeros(0, dtype=np.int64)
        while len(rest):
            d = np.bitwise_count(fp[rest] ^ fp[parent[rest]]).astype(np.int64)
            slot = parent[rest] * 65 + d
            _, at, inv = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[at]  # the first of each slot hangs there; the others go down to it
            self.edge[child] = d[at]
            links.append((parent[child], child))
            down = np.ones(len(rest), dtype=bool)
            down[at] = False
            parent[rest[down]] = child[inv[down]]
            rest = rest[down]
        parents = np.concatenate([p for p, _ in links]) if links else np.zeros(0, dtype=np.int64)
        kids = np.concatenate([c for _, c in links]) if links else np.zeros(0, dtype=np.int64)
        order = np.argsort(parents, kind="stable")
        self.kids, self.levels = kids[order], links
        self.start = np.searchsorted(parents[order], np.arange(n + 1))

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """Each subtree's label if all of it has the same, else -1."""
        out = label.copy()
        for p, c in reversed(self.levels):
            bad = p[out[c] != label[p]]
            out[bad] = -1
        return out

    def near(self, probe: np.ndarray, root: np.ndarray, radius: int, label: np.ndarray | None = None, whole: np.ndarray | None = None, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probe index, node) of all pairs within radius. With label: subtrees whole in a probe's own label are passed over.
        most: pairs taken at a time; each may reach some 30 children, so this bounds memory."""
        todo = [(np.arange(len(probe)), root)]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[most:], node[most:]), (q[:most], node[:most])]
                continue
            if label is not None:
                keep = whole[node] != label[q]
                q, node = q[keep], node[keep]
            if not len(q):
                continue
            d = np.bitwise_count(probe[q] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            n = self.start[node + 1] - self.start[node]
            has = n > 0
            q, node, d, n = q[has], node[has], d[has], n[has]
            if not len(q):
                continue
            at = np.repeat(self.start[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            kid = self.kids[at]
            ok = np.abs(self.edge[kid] - np.repeat(d, n)) <= radius
            todo.append((np.repeat(q, n)[ok], kid[ok]))


def union_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b), from the given labels on."""
    label = np.arange(n) if label is None else label.copy()
    while len(a):
        la, lb = label[a], label[b]
        diff = la != lb
        a, b, la, lb = a[diff], b[diff], la[diff], lb[diff]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def spanning(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that connect within each group what pairs within radius connect.

    A group of side 0 is matched with itself; else side 2 probes the trees of side 1. Links of one bit
    are merged first; later searches then pass over subtrees that are whole in the probe's component,
    so dense balls of near copies don't cost all their pairs.
    """
    tree = np.flatnonzero(side < 2)
    code, at = np.unique(group[tree], return_inverse=True)
    order = np.argsort(at, kind="stable")
    tree, at = tree[order], at[order]
    forest = Forest(fp[tree], at)
    first = np.searchsorted(at, np.arange(len(code)))
    probe = np.flatnonzero(side != 1)
    where = np.searchsorted(code, group[probe])
    known = where < len(code)
    known[known] = code[where[known]] == group[probe[known]]
    probe, where = probe[known], where[known]
    label = np.arange(len(fp))
    for r in sorted({min(1, radius), radius}):
        a, b = [], []
        for q, node in forest.near(fp[probe], first[where], r, label[probe], forest.uniform(label[tree])):
            a.append(probe[q])
            b.append(tree[node])
        if a:
            label = union_labels(len(fp), np.concatenate(a), np.concatenate(b), label)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return moved, label[moved]


def links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints fps.fp that connect all pairs within radius."""
    blocks = radius + 1
    width = 64 // blocks
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width if i < blocks - 1 else 1 << (64 - i * width)) - 1).alias("part"))
        for i in range(blocks)
    ])).alias("k")).select("fp", "k.block", "k.part")
    dealt = common.paired_chunks(keyed, ["block", "part"], "fp", limit)
    keys = ["block", "part", "gi", "gj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, keys, 65_536):
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            signed = t.column("fp").to_numpy()
            a, b = spanning(signed.view(np.uint64), np.cumsum(new), t.column("side").to_numpy(), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys).select("fp", *keys, "side")
    return common.map_arrow(dealt, run, "a long, b long", 20_000)


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, th, fp, class, component_id), a row for each row of docs (doc_id, text)."""
    own = common.stored(fingerprints(docs, shingle), "fingerprints")
    # copies fall together before anything is compared
    fps = common.stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = common.components(common.stored(links(fps, radius, limit), "links"))
    joined = common.stored(roots.join(fps, roots.v == fps.fp).select("fp", "root", "rep"), "joined")
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "root").select("fp", "root", "least")
    of = fps.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("class"), F.coalesce("least", "rep").alias("component_id"))
    return own.join(of, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs (doc_id, text)."""
    return classes(docs, shingle, radius, limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """One row of docs for each class of near copies: its smallest doc_id's, with all columns.

    Rows that share a doc_id are told apart by their texts: each belongs to its own text's class. Of a class's rows
    of the smallest id, the one with the least hash of the text stays; of rows equal in id and text, any one.
    Rows of null doc_id have no class id to be told apart by and all stay.
    """
    return first_of(docs, classes(docs, shingle, radius, limit))


def first_of(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their class (of: doc_id, th, class, component_id), and those without an id."""
    first = of.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("th").alias("__t"), F.count("*").alias("n"))
    first = common.stored(first.select(F.col("doc_id").alias("__id"), "__t", "n"), "first")
    # the ids grow with the corpus: always a shuffle join, never a broadcast
    hashed = docs.withColumn("__th", F.xxhash64("text"))
    kept = hashed.join(first.hint("merge"), (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__th") == F.col("__t")), "left_semi")
    if first.where("n > 1").limit(1).count():  # repeats of an id
        kept = kept.dropDuplicates(["doc_id", "__th"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
