import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import scans
from heddle.operators import anomaly, features, graph, profile, scoring, supervised, views

S, H = dt.datetime(2022, 9, 1), lambda d, h: dt.datetime(2022, 9, d, h)
NET = [(0, "A", "B", H(1, 10), 100, 1), (1, "B", "C", H(1, 11), 95, 1), (2, "C", "A", H(1, 12), 90, 1), (3, "C", "A", H(2, 12), 10, 0),
       (4, "D", "A", H(1, 9), 500, 0), (5, "E", "F", H(3, 9), 50, 0), (6, "A", "A", H(4, 9), 5, 0), (7, "G", "A", H(10, 9), 1, 0)]


@pytest.fixture(scope="module")
def net(spark):
    rows = [(i, s, d, ts, float(u), y, "ACH", "US Dollar", "US Dollar", float(u)) for i, s, d, ts, u, y in NET]
    return spark.createDataFrame(rows, "txn_id long, src string, dst string, timestamp timestamp, amt_usd double, is_laundering int, payment_format string, pay_ccy string, recv_ccy string, amt_paid double").cache()


def test_pairs(net):
    p = {(r.src, r.dst): r for r in graph.pairs(net).collect()}
    assert len(p) == 7 and (p["C", "A"].n_txns, p["C", "A"].total_usd, p["C", "A"].n_illicit) == (2, 100, 1)
    assert graph.pairs(net, drop_self_loops=True).count() == 6


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.component, set()).add(r.node)
    return out


def test_components(net):
    assert [g for g in groups(graph.strongly_connected(net)).values() if len(g) > 1] == [{"A", "B", "C"}]
    assert sorted(map(sorted, groups(graph.weakly_connected(net)).values())) == [["A", "B", "C", "D", "G"], ["E", "F"]]
    assert {(r.src, r.dst) for r in graph.nontrivial_scc_edges(net).collect()} == {("A", "B"), ("B", "C"), ("C", "A")}
    s = graph.component_summary(graph.strongly_connected(net)).first()
    assert (s.n, s.largest, s.nontrivial, s.nodes_in_nontrivial) == (5, 3, 1, 3)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(1)
    for n, m in ((12, 14), (40, 55)):
        e = [(f"n{a:02d}", f"n{b:02d}") for a, b in rng.integers(0, n, (m, 2))]
        reach = {f"n{i:02d}": {f"n{i:02d}"} for i in range(n)}
        for _ in range(n):
            for a, b in e:
                for v in reach.values():
                    if a in v:
                        v.add(b)
        seen = {x for p in e for x in p}
        want = {x: min(y for y in seen if y in reach[x] and x in reach[y]) for x in seen}
        got = {r.node: r.component for r in graph.strongly_connected(spark.createDataFrame(e, "src string, dst string")).collect()}
        assert got == want


def test_labels_with_isolated_node(spark):
    e = spark.createDataFrame([("0", "1"), ("1", "2"), ("2", "0"), ("3", "0")], "src string, dst string")
    every = spark.createDataFrame([(str(i),) for i in range(5)], "node string")
    got = {r.node: (r.scc, r.wcc) for r in graph.component_labels(e, every).collect()}
    assert got == {"0": ("0", "0"), "1": ("0", "0"), "2": ("0", "0"), "3": ("3", "0"), "4": ("4", "4")}


def test_ego(net):
    def ego(*a, **b):
        return {r.node: r.hop for r in graph.ego(net, *a, **b)[0].collect()}

    assert set(ego("D", 1)) == {"D", "A"}
    two = ego("D", 2)
    assert set(two) == {"D", "A", "B", "C", "G"} and two["B"] == 2
    assert len(ego("E", 3)) == 2
    assert "G" not in ego("A", 1, start="2022-09-01", end="2022-09-02 23:59:00")
    few = ego("A", 1, max_nodes=3)
    assert len(few) == 3 and "D" in few and "G" not in few
    n, e = graph.ego(net, "nobody")
    assert n.count() == 0 and e.count() == 0
    with pytest.raises(ValueError, match="negative"):
        graph.ego(net, "A", -1)


def test_pagerank_and_clustering(spark, net):
    r = {x.node: x.pagerank for x in graph.pagerank(net, tol=1e-6).collect()}
    names = sorted(r)
    ix = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for s, d in {(s, d) for _, s, d, *_ in NET if s != d}:
        m[ix[d], ix[s]] = 1
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), 1 / len(names))
    x = np.full(len(names), 1 / len(names))
    for _ in range(500):
        x = 0.85 * m @ x + 0.15 / len(names)
    assert [r[n] for n in names] == pytest.approx(x.tolist(), abs=1e-4)
    c = {x.node: x.clustering for x in graph.clustering(net).collect()}
    assert c["B"] == 1.0 and c["A"] == pytest.approx(2 / 12) and c["E"] == 0


def test_account_features(spark):
    rows = [(0, "A", "P", H(1, 10), 1000.0, "ACH", "US Dollar"), (1, "P", "B", H(1, 11), 990.0, "ACH", "US Dollar"), (2, "A", "C", H(2, 10), 200.0, "Cheque", "Euro"), (3, "A", "A", H(2, 12), 50.0, "Reinvestment", "US Dollar")]
    t = spark.createDataFrame([(i, s, d, ts, u, f, "US Dollar", r, u) for i, s, d, ts, u, f, r in rows], "txn_id long, src string, dst string, timestamp timestamp, amt_usd double, payment_format string, pay_ccy string, recv_ccy string, amt_paid double")
    f = features.account_features(t)
    r = {x.acc: x for x in f.collect()}
    assert set(r) == set("APBC")
    a = r["A"]
    assert (a.deg_out, a.n_out, a.n_self_loops, a.usd_out_sum, a.usd_out_max, a.share_fmt_ach) == (2, 2, 1, 1200, 1000, 0.5)
    assert r["P"].ratio_out_in == pytest.approx(0.99) and r["P"].median_dwell_hours == 1 and r["P"].has_both_directions == 1
    assert r["B"].has_both_directions == 0 and r["C"].cross_ccy_share == 1
    assert not any(v is None for x in r.values() for v in x)
    found = spark.createDataFrame([("fan_out", ["A", "P"]), ("temporal_cycle", ["A", "B"]), ("fan_out", ["P"])], "detector string, account_ids array<string>")
    h = features.detector_counts(f, found)
    g = {x.acc: x for x in features.detector_counts(h, found).collect()}
    assert (g["A"].hits_fan_out, g["A"].hits_temporal_cycle, g["P"].hits_fan_out, g["C"].hits_pass_through) == (1, 1, 2, 0)
    z = features.standardised(h, ["acc"])
    means = z.agg(*[F.avg(c) for c in z.columns if c != "acc"]).first()
    assert max(abs(x) for x in means) < 1e-9
    anom = g and h.select("acc", F.lit(0.5).alias("iforest"), F.col("n_out").cast("double").alias("ensemble"))
    s = scoring.account_scores(h, anom, t.withColumns({"score": F.lit(0.3), "is_laundering": F.lit(0)}))
    x = {r.acc: r for r in s.collect()}
    assert x["A"].reasons[0] == "in a time-ordered cycle (x1)" and len(x["C"].reasons) == 3 and 0 < x["A"].risk <= 1


def test_transaction_features_see_only_the_past(spark):
    day = lambda d: S + dt.timedelta(days=d)
    rows = [("A", "B", day(0), 100.0, "US Dollar", 0), ("A", "B", day(0), 50.0, "US Dollar", 0), ("A", "C", day(2), 200.0, "Euro", 0), ("X", "A", day(2.5), 70.0, "US Dollar", 0), ("A", "B", day(10), 10.0, "US Dollar", 1), ("A", "A", day(10), 5.0, "US Dollar", 0)]
    t = spark.createDataFrame([(s, d, ts, u, p, "US Dollar", y, i, u, "ACH") for i, (s, d, ts, u, p, y) in enumerate(rows)], "src string, dst string, timestamp timestamp, amt_usd double, pay_ccy string, recv_ccy string, is_laundering int, txn_id long, amt_paid double, payment_format string")
    r = {x.txn_id: x for x in features.transaction_features(t).collect()}
    assert all(r[i].snd_out_cnt_30d == 0 and r[i].rcv_in_cnt_30d == 0 for i in (0, 1))
    assert (r[2].snd_out_cnt_1d, r[2].snd_out_cnt_7d, r[2].snd_out_cnt_30d, r[2].snd_out_usd_7d, r[2].snd_out_dcp_7d, r[2].pair_seen_before) == (0, 2, 2, 150, 1, 0)
    assert (r[3].rcv_out_cnt_7d, r[3].rcv_in_cnt_30d, r[3].snd_in_cnt_30d) == (3, 0, 0)
    assert (r[4].snd_out_cnt_7d, r[4].snd_out_cnt_30d, r[4].pair_seen_before, r[4].rcv_in_cnt_30d) == (0, 3, 1, 2)
    assert r[4].snd_out_xc_share_30d == pytest.approx(1 / 3) and r[5].is_self_loop == 1
    assert r[0].log_amt_usd == pytest.approx(np.log1p(100)) and r[0].weekday == 4
    early = features.transaction_features(t.where("txn_id <= 3")).collect()
    assert sorted(map(tuple, early)) == sorted(tuple(r[i]) for i in range(4))


def test_ranks_and_split(spark):
    d = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)], "a double, b double")
    assert sorted(x.ensemble for x in anomaly.mean_rank(d, ["a", "b"]).collect()) == pytest.approx([1 / 3, 2 / 3, 1])
    tied = scans.mean_ranks(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double"), "v", "r")
    assert sorted(x.r for x in tied.collect()) == pytest.approx([0.5, 0.5, 1])
    t = spark.createDataFrame([(S + dt.timedelta(days=i), i) for i in range(10)], "timestamp timestamp, txn_id long")
    s = [x.split for x in supervised.temporal_split(t).orderBy("txn_id").collect()]
    assert s == ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_scans_over_many_bins(spark):
    d = spark.range(1000).select((F.col("id") % 500).cast("double").alias("x"), "id")
    b = scans.binned(d, F.col("x"), 50)
    assert b.select("__bin").distinct().count() > 10
    sizes = d.groupBy("x").count()
    whole = scans.binned
    try:
        scans.binned = lambda df, by, per_bin=0: whole(df, by, 40)
        got = {r.x: r["count"] for r in scans.global_sums(sizes, "x", ["count"], descending=False).collect()}
        at = [r["at"] for r in scans.positions(d, ["x", "id"], "at").orderBy("x", "id").collect()]
    finally:
        scans.binned = whole
    assert got == {float(i): 2 * (i + 1) for i in range(500)} and at == list(range(1000))


def test_anomaly_models(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (300, 3)), [[9, 9, 9]]]
    d = spark.createDataFrame([(f"n{i}", *map(float, r)) for i, r in enumerate(x)], "acc string, a double, b double, c double")
    f = {r.acc: r.iforest for r in anomaly.isolation_forest(d, "acc", ["a", "b", "c"], trees=50).collect()}
    assert max(f, key=f.get) == "n300"
    z = anomaly.principal_components(d, "acc", ["a", "b", "c"], 3)
    lof = {r.acc: r.lof for r in anomaly.local_outlier_factor(z, "acc", 10).collect()}
    assert max(lof, key=lof.get) == "n300" and np.median(list(lof.values())) == pytest.approx(1, abs=0.1)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    nn = np.argsort(far, 1)[:, :10]
    dist = np.take_along_axis(far, nn, 1)
    lrd = 1 / (np.maximum(dist, dist[nn][:, :, -1]).mean(1) + 1e-10)
    assert [lof[f"n{i}"] for i in range(len(x))] == pytest.approx((lrd[nn].mean(1) / lrd).tolist(), rel=1e-6)


def test_views(net):
    r = views.account_transactions(net, "A").collect()
    assert [x.txn_id for x in r] == [4, 0, 2, 3, 7] and [x.direction for x in r] == ["in", "out", "in", "in", "in"]
    f = views.money_flows(net, "A", 2, 1).collect()
    assert {(x.direction, x.level, x.src, x.dst) for x in f} == {("out", 1, "A", "B"), ("out", 2, "B", "C"), ("in", 1, "D", "A"), ("in", 1, "C", "A"), ("in", 2, "B", "C")}
    assert profile.scale(net).first().n_accounts == 7
    assert profile.sample_keeping_positives(net, 0.0).count() == 3 and profile.sample_by_class(net, 2, 3).count() == 5


def test_empty_graph(net):
    none = net.where("false")
    assert graph.strongly_connected(none).count() == 0 and graph.weakly_connected(none).count() == 0
    assert graph.pagerank(none).count() == 0 and graph.clustering(none).count() == 0


def test_density_clusters(spark):
    from heddle.operators import clusters

    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 0.3, (80, 2)), rng.normal(5, 0.3, (60, 2)), rng.uniform(-10, 15, (12, 2))]
    z = spark.createDataFrame([(f"n{i:03d}", list(map(float, r))) for i, r in enumerate(x)], "acc string, z array<double>")
    tree = clusters.spanning_tree(z, "acc", 10, block=64).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(far, 1)[:, 9]
    m = np.maximum(far, np.maximum(core[:, None], core[None]))
    inside, rest, total = {0}, set(range(1, len(x))), 0.0
    while rest:  # Prim
        w, j = min((min(m[i, j] for i in inside), j) for j in rest)
        total += w
        inside.add(j)
        rest.remove(j)
    assert len(tree) == len(x) - 1 and sum(r.weight for r in tree) == pytest.approx(total)
    got = {r.acc: r for r in clusters.hdbscan(z, "acc", smallest=10, small=70).collect()}
    score = [got[f"n{i:03d}"] for i in range(len(x))]
    assert np.mean([r.hdbscan_flag for r in score[:80]]) < 0.1 and np.median([r.hdbscan for r in score[:80]]) < 0.6
    assert np.mean([r.hdbscan >= 0.75 for r in score[80:140]]) > 0.9  # a small cluster
    assert np.mean([r.hdbscan_flag for r in score[140:]]) > 0.6
    with pytest.raises(ValueError, match="at most"):
        clusters.hdbscan(z, "acc", most=10)
