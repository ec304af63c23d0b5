"""Graph operators over edge tables (src, dst). Iterations are joins; each round is written to the shared folder.

The transactions are the multigraph; pairs() collapses them. Nothing here collects a graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions import scans
from heddle.functions.columns import legs
from heddle.session import shipped, stored


def pairs(t: DataFrame, drop_self_loops: bool = False) -> DataFrame:
    """(src, dst, total_usd, n_txns, first_ts, last_ts, n_illicit) of each ordered pair of accounts."""
    d = t.where("src <> dst") if drop_self_loops else t
    return d.groupBy("src", "dst").agg(
        F.sum("amt_usd").alias("total_usd"), F.count("*").alias("n_txns"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.sum(F.col("is_laundering").cast("long")).alias("n_illicit"),
    )


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(node, deg_out, deg_in): distinct counterparties each way, without self-loops."""
    p = e.where("src <> dst").select("src", "dst").distinct()
    both = p.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.node").agg(F.sum("x.o").alias("deg_out"), F.sum("x.i").alias("deg_in"))


#: Edges that one task takes.
FEW = 1_000_000


def _same(a: DataFrame, columns: list[str], last: tuple | None) -> tuple[tuple, bool]:
    now = tuple(a.select(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())
    return now, now == last


def _in_one_task(e: DataFrame, find: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(node, component) of the nodes of e (a, b), at most FEW edges, by a function of the numbers of nodes and the edges' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.string()), ("b", pa.string())]))
        both = pa.chunked_array(t.column("a").chunks + t.column("b").chunks, pa.string())
        names, at = np.unique(both.to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        label = find(len(names), at[: t.num_rows], at[t.num_rows :])
        for lo in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 50_000], pa.string()), pa.array(names[label[lo : lo + 50_000]], pa.string())], ["node", "component"])

    return stored(shipped(e.select("a", "b").coalesce(1)).mapInArrow(run, "node string, component string"), "labelled")


def _least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each is connected with."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            return label
        label = low


def _least_strongly_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each one's strongly connected component: two passes, along the edges and back."""

    def ways(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(u, kind="stable")
        return v[order].tolist(), np.searchsorted(u[order], np.arange(n + 1)).tolist()

    to, start = ways(a, b)
    at, seen, ended = start[:n], bytearray(n), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = 1
        stack = [root]
        while stack:
            v = stack[-1]
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    seen[w] = 1
                    stack.append(w)
            else:
                ended.append(stack.pop())
    to, start = ways(b, a)
    label = np.full(n, -1)
    for root in reversed(ended):
        if label[root] >= 0:
            continue
        label[root] = root
        members, stack = [root], [root]
        while stack:
            v = stack.pop()
            for w in to[start[v] : start[v + 1]]:
                if label[w] < 0:
                    label[w] = root
                    members.append(w)
                    stack.append(w)
        label[members] = min(members)
    return label


def weakly_connected(e: DataFrame, rounds: int = 100, few: int = FEW) -> DataFrame:
    """(node, component, size): the component is named by its smallest node. Isolated nodes come in as self-loops.

    Large stars and small stars in turn; a round halves a chain, so rounds are logarithmic. Up to `few` edges
    one task does the same at once.
    """
    every = stored(nodes(e), "nodes")
    cur = stored(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "star")
    if cur.count() <= few:
        done = _in_one_task(cur.toDF("a", "b"), _least_connected)
        return _sized(every.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    last = None
    for _ in range(rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        last, done = _same(cur, ["u", "v"], last)
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    out = every.join(cur.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return _sized(out)


def _sized(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return labels.join(sizes, "component").select("node", "component", "size")


def _spread(labels: DataFrame, e: DataFrame, rounds: int, hops: int = 3) -> DataFrame:
    """labels (node, label) with each label lowered to the smallest that reaches the node along e (a -> b); a round goes hops edges far."""
    last = None
    for _ in range(rounds):
        for _ in range(hops):
            sent = e.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("got"))
            labels = labels.join(sent, F.col("node") == F.col("b"), "left").select("node", F.least("label", "got").alias("label"))
        labels = stored(labels, "labels")
        last, done = _same(labels, ["node", "label"], last)
        if done:
            return labels
    raise RuntimeError("labels did not settle")


def strongly_connected(e: DataFrame, rounds: int = 1000, few: int = FEW) -> DataFrame:
    """(node, component, size), named by the smallest node.

    Nodes without a way in or out are set aside; the others take the smallest label that reaches them, and
    those that a label's own node is reached back from, within the label, form its component. Repeat with the rest.
    Once no more than `few` edges are left, one task finishes with the same result.
    """
    every = stored(nodes(e), "nodes")
    rest = stored(e.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    for _ in range(rounds):
        n = rest.count()
        if n <= few:
            last = _in_one_task(rest, _least_strongly_connected).select("node", F.col("component").alias("label"))
            found = last if found is None else found.union(last)
            break
        while True:  # trim
            rest = stored(rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "trimmed")
            left = rest.count()
            if left == n:
                break
            n = left
        if not n:
            break
        at = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        color = _spread(stored(at.select("node", F.col("node").alias("label")), "colors"), rest, rounds)
        ca, cb = (color.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        inside = stored(rest.join(ca, "a").join(cb, "b").where("la = lb").select("a", "b", F.col("la").alias("label")), "inside")
        # backward from each label's own node
        reached = stored(color.where("node = label"), "reached")
        size = reached.count()
        while True:
            grown = reached
            for _ in range(3):
                more = inside.join(grown.select(F.col("node").alias("b"), F.col("label")), ["b", "label"], "left_semi").select(F.col("a").alias("node"), "label")
                grown = grown.union(more).distinct()
            reached = stored(grown, "reached")
            now = reached.count()
            if now == size:
                break
            size = now
        found = reached if found is None else found.union(reached)
        found = stored(found, "components")
        gone = reached.select("node")
        rest = stored(rest.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
    if found is None:
        return _sized(every.select("node", F.col("node").alias("component")))
    found = found.select("node", F.col("label").alias("component"))
    return _sized(every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def nontrivial_scc_edges(e: DataFrame) -> DataFrame:
    """Edges within strongly connected components of two nodes or more, with the component."""
    scc = strongly_connected(e).where("size > 1")
    a = scc.select(F.col("node").alias("src"), F.col("component").alias("c"))
    b = scc.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    return e.where("src <> dst").join(a, "src").join(b, "dst").where("c = d").withColumnRenamed("c", "component").drop("d")


def component_labels(e: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(node, scc, wcc) of all nodes; nodes of `every` without an edge are components of their own."""
    loops = every.select(F.col("node").alias("src"), F.col("node").alias("dst")) if every is not None else None
    e = e.select("src", "dst").union(loops) if loops is not None else e.select("src", "dst")
    s = strongly_connected(e).select("node", F.col("component").alias("scc"))
    return s.join(weakly_connected(e).select("node", F.col("component").alias("wcc")), "node")


def pagerank(e: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-8, stop: bool = True) -> DataFrame:
    """(node, pagerank, pagerank_scaled) over distinct pairs without self-loops; dangling mass is spread evenly.

    Iterates until the summed change is under N * tol; with stop=False runs max_iter rounds. Scaled: 1 is the average.
    """
    p = stored(e.where("src <> dst").select("src", "dst").distinct(), "pairs")
    every = stored(nodes(p).join(p.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")), "node", "left"), "nodes")
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("pagerank_scaled"))
    ranks = every.select("node", "out", F.lit(1.0 / n).alias("x"))
    for i in range(max_iter):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("x"))), F.lit(0.0))).first()[0]
        sent = p.join(ranks.select(F.col("node").alias("src"), (F.col("x") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = ranks.join(sent, "node", "left").select("node", "out", (alpha * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - alpha) / n).alias("x"), F.col("x").alias("was"))
        new = stored(new, "ranks")
        moved = new.agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0]
        ranks = new.drop("was")
        if stop and moved < n * tol:
            break
    else:
        if stop:
            raise RuntimeError("PageRank did not converge")
    return ranks.select("node", F.col("x").alias("pagerank"), (F.col("x") * n).alias("pagerank_scaled"))


def clustering(e: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering) on the undirected simple graph.

    Edges point from lower to higher degree, so a node has at most about sqrt(2 * edges) ways out and wedges stay few.
    """
    u = stored(e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "undirected")
    deg = stored(u.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    da, db = (deg.select(F.col("node").alias(x), F.col("degree").alias(f"d{x}")) for x in "ab")
    up = u.join(da, "a").join(db, "b").withColumn("forward", (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))))
    up = stored(up.select(F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("y")), "oriented")
    wedges = up.join(up.select("x", F.col("y").alias("z")), "x").where("y <> z").join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    tri = wedges.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = deg.join(tri, "node", "left").fillna(0, ["triangles"])
    return d.withColumn("clustering", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))))


def ego(t: DataFrame, account: str, k: int = 2, start: Column | str | None = None, end: Column | str | None = None, max_nodes: int = 300, max_edges: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The k-hop neighbourhood of an account: nodes (node, hop, is_centre) and the transactions between them.

    Both directions, no self-loops, times inclusive. Each hop's newcomers go by their largest single amount
    to the nodes of the hop before, until max_nodes are in; edges are the max_edges largest. An unknown
    account gives empty results.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    spark: SparkSession = t.sparkSession
    d = t.where("src <> dst")
    if start is not None:
        d = d.where(F.col("timestamp") >= (F.lit(start).cast("timestamp") if isinstance(start, str) else start))
    if end is not None:
        d = d.where(F.col("timestamp") <= (F.lit(end).cast("timestamp") if isinstance(end, str) else end))
    members, frontier = [(account, 0)], [account]
    for hop in range(1, k + 1):
        room = max_nodes - len(members)
        if room <= 0 or not frontier:
            break
        # the frontier, at most max_nodes accounts, goes into the scan's filter
        near = legs(d.where(F.col("src").isin(frontier) | F.col("dst").isin(frontier)), "amt_usd").where(F.col("acc").isin(frontier))
        new = near.where(~F.col("other").isin([x for x, _ in members])).groupBy("other").agg(F.max("amt_usd").alias("best"))
        frontier = [r.other for r in new.orderBy(F.desc("best"), "other").limit(room).collect()]
        members += [(x, hop) for x in frontier]
    if len(members) == 1 and d.where((F.col("src") == account) | (F.col("dst") == account)).limit(1).isEmpty():
        members = []
    inside = [x for x, _ in members]
    n = spark.createDataFrame(members, "node string, hop int").withColumn("is_centre", F.col("node") == account)
    edges = d.where(F.col("src").isin(inside) & F.col("dst").isin(inside))
    return n, edges.orderBy(F.desc("amt_usd"), "txn_id").limit(max_edges)


def degree_histogram(e: DataFrame) -> DataFrame:
    """(direction, degree, n): how many nodes have each number of counterparties."""
    d = degrees(e)
    both = d.select(F.explode(F.array(F.struct(F.lit("out").alias("direction"), F.col("deg_out").alias("degree")), F.struct(F.lit("in").alias("direction"), F.col("deg_in").alias("degree")))).alias("x"))
    return both.where("x.degree > 0").groupBy("x.direction", "x.degree").agg(F.count("*").alias("n"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """(size, n): how many components (node, component, size) have each size."""
    return labels.groupBy("component").agg(F.first("size").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def component_summary(labels: DataFrame) -> DataFrame:
    c = labels.groupBy("component").agg(F.count("*").alias("size"))
    big = F.col("size") > 1
    return c.agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.count_if(big).alias("nontrivial"), F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).alias("nodes_in_nontrivial"))


def scc_share(t: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, transactions, in_nontrivial_scc, share_pct) of all and of laundering transactions between accounts: how many run
    within a strongly connected component of two nodes or more. labels: (node, component, size), of strongly_connected."""
    big = labels.where("size > 1")
    a, b = (big.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in ("src", "dst"))
    p = pairs(t, drop_self_loops=True).join(a, "src", "left").join(b, "dst", "left")
    inside = F.coalesce(F.col("c_src") == F.col("c_dst"), F.lit(False))
    rows = p.select(inside.alias("inside"), F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.col("n_txns").alias("n")), F.struct(F.lit("laundering").alias("kind"), F.col("n_illicit").alias("n")))).alias("x"))
    g = rows.groupBy("x.kind").agg(F.sum("x.n").alias("transactions"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("x.n"))), F.lit(0)).alias("in_nontrivial_scc"))
    return g.withColumn("share_pct", 100 * F.try_divide("in_nontrivial_scc", "transactions"))


def numbered_pairs(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ix) of all accounts, numbered from 0 in their order, and the pairs as (s, d, n, ill) of such numbers."""
    p = pairs(t, drop_self_loops=True)
    ids = stored(scans.positions(nodes(p), ["node"], "ix"), "numbered")
    s, d = (ids.select(F.col("node").alias(k), F.col("ix").alias(n)) for k, n in (("src", "s"), ("dst", "d")))
    return ids, p.join(s, "src").join(d, "dst").select("s", "d", F.col("n_txns").alias("n"), F.col("n_illicit").alias("ill"))


def illicit_context(t: DataFrame) -> DataFrame:
    """Counts of accounts with a laundering transaction, of accounts one hop off, and of the pairs around them."""
    d = t.where("src <> dst")
    bad = legs(d.where("is_laundering = 1")).select("acc").distinct()
    p = d.groupBy("src", "dst").agg(F.max(F.col("is_laundering").cast("int")).alias("bad"))
    s, r = (bad.select(F.col("acc").alias(x), F.lit(1).alias(f"b_{x}")) for x in ("src", "dst"))
    near = p.join(s, "src", "left").join(r, "dst", "left").where("b_src = 1 or b_dst = 1")
    around = near.select(F.explode(F.array("src", "dst")).alias("acc")).distinct()
    counts = near.agg(F.count("*").alias("context_pairs"), F.coalesce(F.sum("bad"), F.lit(0)).alias("illicit_pairs"))
    return counts.select("*", around.agg(F.count("*")).scalar().alias("context_accounts"), bad.agg(F.count("*")).scalar().alias("illicit_accounts"))


def top_by(df: DataFrame, keys: list[str], value: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of each group with the largest value."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
