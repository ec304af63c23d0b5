"""SimHash near-duplicates at a given Jaccard similarity of word shingles: BK-trees in shards, verified exactly.

Texts of the same shingle set fall together first. Each set has WORDS fingerprints of 64 bits: the first is the
SimHash of its shingles' hashes, the others of the same hashes mixed anew. Sets of similarity 0.8 differ by some
15 % of the bits, so sets are candidates if their first fingerprints are within RADIUS bits and all of them
together within WHOLE. No pigeonhole rule reaches that far with blocks that tell texts apart, so shards are named by
some of the fingerprints' bits, in as many tables as it takes: a set goes to one shard of each table. In a
shard sets fall into buckets by further bits, again in several tables, and each bucket is a BK-tree over the first
fingerprints, in which each set finds those within the radius, passing over subtrees that links already connect with it.

Classes of candidates are then verified on whole sets: members of a class are held against each other until links
of similar sets connect them or no pair is left. A class of more than `limit` members is first held against
its smallest, and those left apart from it are dealt out in chunks, with each other and with the rest.

What can lose a pair at the threshold: that it shares no bucket (simulated: 1 of 100,000 among 230,000 sets, 0 of 30,000
among 13,500,000) and, by calculation, that it is over the radii (some 4e-7). Sets of a few shingles differ in more bits
than their similarity tells: five shingles and four of them by 19 % (27 of 100,000 and 59 of 30,000 share no bucket).

Edge cases: words are as in simhash; a null or wordless text has the empty set, and all of these are copies;
a text of fewer words than a shingle is one shingle; a null doc_id is never a class id and links nothing;
an empty table gives an empty result. Sets are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of a set.
WORDS = 4
W = [f"w{i}" for i in range(WORDS)]
#: Bits in which the first fingerprints, and all together, of similar sets may differ.
RADIUS, WHOLE = 26, 72
#: The chance that sets of the least similarity agree in a bit.
SAME = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: The chance that a pair at the least similarity shares no bucket; the chance that it does in a shard that it shares.
LOSS, FOUND = 1e-6, 0.95
#: Sets in a shard and in a bucket, if none were alike.
SHARD, BUCKET = 131_072, 64
#: Sets of a shard in one chunk.
CHUNK = 262_144
#: Members of a class in one chunk, and pairs of one member in one task.
LIMIT = 1_000
#: Ids that are broadcast; beyond that a shuffle join.
FEW = 500_000

_rng = np.random.default_rng(42)
_MIX = _rng.integers(0, 2**63, (WORDS - 1, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.arange(8, dtype=np.uint64)[:, None]
_LOW = np.uint64(0x0101010101010101)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(simhash.hashes(text, shingle))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def fingerprints(s: np.ndarray) -> np.ndarray:
    """WORDS SimHash fingerprints (uint64) of a set of hashes; a bit is set if it is in over half of them."""
    counts = np.zeros((WORDS, 8, 8), dtype=np.int64)
    for at in range(0, len(s), 255):  # eight counters of a byte each in a word
        part = s[at : at + 255]
        mixed = part * _MIX
        mixed ^= mixed >> np.uint64(32)
        h = np.concatenate([part[None], mixed * _MIX])
        counts += ((h[:, None] >> _LANES) & _LOW).sum(2).view(np.uint8).reshape(WORDS, 8, 8)
    return np.packbits((counts * 2 > len(s)).transpose(0, 2, 1), axis=2, bitorder="little").reshape(WORDS, 8).copy().view("<u8")[:, 0]


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, fp, w0, ...): th a hash of the text, fp tells the shingle set, w are its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(2)]
            fp = np.array([set_id(s) for s in sets], dtype=np.uint64).view(np.int64)
            w = np.array([fingerprints(s) for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), *[pa.array(x) for x in w.T.copy()]], ["doc_id", "th", "fp", *W])

    schema = "doc_id long, th long, fp long, " + ", ".join(f"{w} long" for w in W)
    return common.map_arrow(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, schema)


def tables_for(bits: int, share: float, loss: float) -> int:
    """Tables of keys of so many bits, in each of which a pair at the threshold is found with the given share of shared keys."""
    return math.ceil(math.log(loss) / math.log1p(-(SAME**bits) * share)) if SAME**bits * share < 1 else 1


def shard_bits(n: int) -> np.ndarray:
    """(tables, bits): the bits that name shards of n sets; the same bit comes again only when all have been used."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / SHARD)))
    tables = tables_for(bits, FOUND, LOSS)
    rng = np.random.default_rng(1)
    return np.concatenate([rng.permutation(64 * WORDS) for _ in range(-(-bits * tables // (64 * WORDS)))])[: bits * tables].reshape(tables, bits)


def bucket_bits(n: int, seed: int) -> np.ndarray:
    """(tables, bits): the bits that name buckets of a shard of n sets."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(64 * WORDS)[:bits] for _ in range(tables_for(bits, 1, 1 - FOUND))], dtype=np.int64)


def tree_links(words: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that connect what candidate pairs of words (n, WORDS) that share a bucket connect; each is a candidate pair."""
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    label = np.arange(n)

    def link(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        x = words[a] ^ words[b]
        near = (np.bitwise_count(x).sum(1, dtype=np.int64) <= WHOLE) & (np.bitwise_count(x[:, 0]) <= RADIUS)
        a, b = a[near], b[near]
        while len(a):  # of each label's links to smaller ones, one
            at = np.unique(np.maximum(label[a], label[b]), return_index=True)[1]
            found.append((a[at], b[at]))
            label = simhash.union_labels(n, a[at], b[at], label)
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
        return label

    for bits in bucket_bits(n, seed):
        code = np.zeros(n, dtype=np.int64)
        for i, bit in enumerate(bits.tolist()):
            code |= (words[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) << i
        order = np.lexsort((words[:, 0], code))
        code, w0 = code[order], words[order, 0]
        new = np.r_[True, code[1:] != code[:-1]]
        bucket = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        for quarter in range(4):  # a large group of near copies is mostly within reach of one of these
            label = link(order[start + size * quarter // 4][bucket], order, label)
        # a tree holds each first fingerprint once, for all sets that have it
        own = np.r_[True, (code[1:] != code[:-1]) | (w0[1:] != w0[:-1])]
        first = np.flatnonzero(own)
        stop = np.r_[first[1:], n]
        forest = simhash.Forest(w0[first], bucket[first])
        of = label[order]
        one = np.where(np.minimum.reduceat(of, first) == np.maximum.reduceat(of, first), of[first], -1)
        for q, node in forest.near(w0, np.searchsorted(first, start)[bucket], RADIUS, of, forest.uniform(one)):
            several = stop[node] - first[node]
            j = np.repeat(first[node] - np.r_[0, np.cumsum(several)[:-1]], several) + np.arange(several.sum())
            i = np.repeat(q, several)
            label = link(order[i[j > i]], order[j[j > i]], label)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def candidates(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links of nodes (fp, w0, ...), distinct in fp, that connect all candidate pairs that share a bucket."""
    n = nodes.count()
    tables = shard_bits(n)

    def key(t: int) -> Column:
        out = F.lit(t << len(tables[t])).cast("long")
        for i, bit in enumerate(tables[t].tolist()):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(W[bit // 64], bit % 64).bitwiseAND(F.lit(1).cast("long")), i))
        return out

    keyed = nodes.select("fp", *W, F.explode(F.array(*[key(t) for t in range(len(tables))])).alias("key"))
    keys = ["key", "gi", "gj"]
    dealt = common.paired_chunks(keyed, ["key"], "fp", chunk).select("fp", *W, *keys)
    # shards take long for their bytes, so they aren't put together by bytes
    dealt = dealt.repartition(min(max(1, n * len(tables) // 20_000), tables.size << 6), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, keys, 8_192):
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            fp = t.column("fp").to_numpy()
            words = np.stack([t.column(w).to_numpy() for w in W], axis=1).view(np.uint64)
            edges = [0, *np.flatnonzero(new).tolist(), t.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                a, b = tree_links(words[lo:hi], int(cols[0][lo]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi][a]), pa.array(fp[lo:hi][b])], ["a", "b"])

    return common.map_arrow(dealt, run, "a long, b long", 8_192)


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) of the wanted (fp, rep): the shingle sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(0)]
            fp = np.array([set_id(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    ids = common.stored(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    ids = F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge")
    # rows that share an id may hold other sets, or one twice
    made = common.map_arrow(docs.join(ids, "doc_id", "left_semi").select("text"), run, "fp long, hashes binary")
    return made.groupBy("fp").agg(F.first("hashes").alias("hashes"))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return common_ >= least * (len(a) + len(b) - common_)


def verified(pairs: DataFrame, sets: DataFrame, least: float, limit: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [similar(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), least) for x, y in zip(t.column(2), t.column(3), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    hot = pairs.groupBy("a").count().where(F.col("count") > limit).select("a", F.ceil(F.col("count") / limit).alias("shares"))
    hot = common.stored(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= 20_000 else hot  # rows of a few bytes; beyond that a shuffle join
    shares = F.coalesce("shares", F.lit(1))
    mine = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")).join(pairs.select("a").distinct().hint("merge"), "a", "left_semi").join(hot, "a", "left")
    mine = mine.select("a", F.explode(F.sequence(F.lit(1), shares)).alias("share"), "x")
    dealt = pairs.join(hot, "a", "left").select("a", "b", (F.pmod(F.xxhash64("b"), shares) + 1).alias("share"))
    both = dealt.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    both = both.join(mine.hint("merge"), ["a", "share"])
    return common.map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long", 64)


def spanning(sets: list[np.ndarray], words: np.ndarray, side: np.ndarray, label: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links (index pairs) that connect what similar candidate pairs of words (n, WORDS) connect; side as in common.paired_chunks."""
    code, at = np.unique(words[:, 0], return_inverse=True)  # a tree holds each first fingerprint once, for all sets that have it
    label = np.unique(label, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(code) + 1))
    forest = simhash.Forest(code, np.zeros(len(code), dtype=np.int64))
    of = label[order]
    one = np.where(np.minimum.reduceat(of, start[:-1]) == np.maximum.reduceat(of, start[:-1]), of[start[:-1]], -1)
    a, b = [], []
    for q, node in forest.near(words[:, 0], np.zeros(len(words), dtype=np.int64), RADIUS, label.copy(), forest.uniform(one)):
        several = start[node + 1] - start[node]
        i = np.repeat(q, several)
        j = order[np.repeat(start[node] - np.r_[0, np.cumsum(several)[:-1]], several) + np.arange(several.sum())]
        open_ = (j > i) & (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[open_], j[open_]
        bits = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64)
        nearest = np.argsort(bits, kind="stable")[: np.count_nonzero(bits <= WHOLE)]
        for x, y in zip(i[nearest].tolist(), j[nearest].tolist(), strict=True):
            if label[x] != label[y] and similar(sets[x], sets[y], least):
                a.append(x)
                b.append(y)
                label[label == label[y]] = label[x]
    return a, b


def dealt_chunks(apart: DataFrame, limit: int) -> DataFrame:
    """Rows (key, fp, ..., label) of classes, dealt to (key, gi, gj) as by common.paired_chunks, but for pairs within the label that is the key.

    Members labelled by their class's smallest are connected already, so their chunks meet those of the other members alone.
    """
    held = F.col("label") == F.col("key")
    sizes = apart.groupBy("key").agg(F.count_if(held).alias("in"), F.count_if(~held).alias("out")).where(F.col("in") + F.col("out") > limit)
    sizes = common.stored(sizes.select("key", F.ceil(F.col("in") / limit).cast("int").alias("ins"), F.ceil(F.col("out") / limit).cast("int").alias("outs")), "hot")
    n = sizes.count()
    if n == 0:
        return apart.withColumns({"gi": F.lit(0), "gj": F.lit(0), "side": F.lit(0)})
    ins, chunks = F.coalesce("ins", F.lit(0)), F.coalesce(F.col("ins") + F.col("outs"), F.lit(1))
    hashed = F.xxhash64(F.lit(7), "fp")
    own = F.when(F.col("ins").isNull(), 0).when(held, F.pmod(hashed, ins)).otherwise(ins + F.pmod(hashed, chunks - ins)).cast("int")
    out = apart.join(F.broadcast(sizes) if n <= 20_000 else sizes, "key", "left").withColumn("own", own)  # rows of a few bytes; beyond that a shuffle join
    out = out.withColumn("other", F.explode(F.sequence(F.when(F.col("own") < ins, ins).otherwise(0), chunks - 1)))
    return out.withColumns({
        "gi": F.least("own", "other"),
        "gj": F.greatest("own", "other"),
        "side": F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2),
    }).drop("ins", "outs", "own", "other")


def crossed(apart: DataFrame, sets: DataFrame, least: float, limit: int) -> DataFrame:
    """(a, b): links between members (key, fp, w0, ..., label) of a class that connect its similar pairs of different labels."""
    keys = ["key", "gi", "gj"]
    dealt = dealt_chunks(apart, limit)
    # a few members may take long, so they aren't put together by bytes
    dealt = dealt.join(sets.hint("merge"), "fp").repartition(max(1, dealt.count() // 500), *keys).sortWithinPartitions(*keys).select("fp", *W, *keys, "side", "label", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, keys, 256):
            cols = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(t.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            fp, side, label, held = t.column("fp").to_numpy(), t.column("side").to_numpy(), t.column("label").to_numpy(), t.column("hashes")
            words = np.stack([t.column(w).to_numpy() for w in W], axis=1).view(np.uint64)
            edges = [0, *np.flatnonzero(new).tolist(), t.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                a, b = spanning([np.frombuffer(held[i].as_py(), "<u8") for i in range(lo, hi)], words[lo:hi], side[lo:hi], label[lo:hi], least)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi][a]), pa.array(fp[lo:hi][b])], ["a", "b"])

    return common.map_arrow(dealt, run, "a long, b long", 64)


def classes(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, th, class, component_id) of docs (doc_id, text): classes that pairs of similarity of at least `least` connect."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    own = common.stored(signed(docs, shingle), "signed")
    nodes = common.stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(w).alias(w) for w in W]), "nodes")
    empty = int(np.uint64(set_id(np.zeros(0, dtype="<u8"))).view(np.int64))
    found = common.stored(candidates(nodes.where(F.col("fp") != empty).select("fp", *W)), "candidates")
    near = common.stored(common.components(found), "near")
    members = common.stored(near.join(nodes.hint("merge"), F.col("v") == F.col("fp")).select(F.col("root").alias("key"), "fp", *W, "rep"), "members")
    sets = whole_sets(docs, members.select("fp", "rep"), shingle).join(members.select("fp").hint("merge"), "fp", "left_semi")
    sets = common.stored(sets, "sets")

    hot = members.groupBy("key").count().where(F.col("count") > limit).select("key")
    pairs = common.stored(members.join(hot.hint("merge"), "key", "left_semi").where("fp <> key").select(F.col("key").alias("a"), F.col("fp").alias("b")), "pairs")
    apart = members.select("key", "fp", *W, F.col("fp").alias("label"))
    links = pairs
    if not pairs.isEmpty():
        links = common.stored(verified(pairs, sets, least, limit), "links")
        roots = links.select(F.col("b").alias("v"), F.col("a").alias("root"))  # stars
        labelled = apart.drop("label").join(roots.hint("merge"), F.col("fp") == F.col("v"), "left").select("key", "fp", *W, F.coalesce("root", "fp").alias("label"))
        open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        apart = common.stored(labelled.join(open_.hint("merge"), "key", "left_semi"), "apart")
    links = common.stored(links.union(crossed(apart, sets, least, limit)), "all_links")

    roots = common.components(links)
    joined = common.stored(nodes.select("fp", "rep").join(roots.hint("merge"), F.col("fp") == F.col("v"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("class")), "joined")
    of = joined.join(joined.groupBy("class").agg(F.min("rep").alias("component_id")).hint("merge"), "class").select("fp", "class", "component_id")
    return own.select("doc_id", "th", "fp").join(of.hint("merge"), "fp").select("doc_id", "th", "class", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, component_id) of the rows of docs (doc_id, text) that have an id."""
    return classes(docs, shingle, least, limit).select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near copies, as simhash.keep_first."""
    return simhash.first_of(docs, classes(docs, shingle, least))
