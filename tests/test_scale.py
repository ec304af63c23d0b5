"""Forms that are cut for scale, against plain ones."""

import datetime as dt
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import session
from heddle.config import Detectors
from heddle.functions import names, scans
from heddle.operators import detectors, graph

T0 = dt.datetime(2022, 9, 1)


@pytest.fixture(scope="module")
def rows():
    """Payments among few accounts, a hub among them, at few times and amounts, so that windows and bands have members on their edges."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(700):
        src, dst = rng.integers(0, 14, 2)
        if i % 4 == 0:
            dst = 0
        elif i % 4 == 1:
            src = 0
        out.append((i, f"A{src:02d}", f"A{dst:02d}", T0 + dt.timedelta(hours=int(rng.integers(0, 40)) * 12), float(rng.choice([0.0, 80.0, 100.0, 119.9999, 120.0, 125.0, 1000.0]))))
    return out


@pytest.fixture(scope="module")
def t(spark, rows):
    return spark.createDataFrame(rows, "txn_id long, src string, dst string, timestamp timestamp, amt_usd double").cache()


def paths(rows, days):
    window = dt.timedelta(days=days)
    e = [r for r in rows if r[1] != r[2]]
    return [(a, b) for a in e for b in e if a[2] == b[1] and a[3] < b[3] <= a[3] + window and a[1] != b[2]]


@pytest.mark.parametrize("days", [7, 0.5, 1.3])
def test_two_hop_paths(t, rows, days):
    got = sorted((r.t1, r.t2) for r in detectors.two_hop_paths(t, Detectors(scatter_gather_window_days=days)).collect())
    assert got == sorted((a[0], b[0]) for a, b in paths(rows, days)) and got


def test_gather_scatter_forms_no_paths(t, rows):
    cfg = Detectors(scatter_gather_window_days=1, scatter_gather_min_paths=4, max_txns_per_finding=50)
    want = {}
    for a, b in paths(rows, 1):
        want.setdefault(a[2], []).append((a, b))
    want = {i: p for i, p in want.items() if len({a[1] for a, _ in p}) >= 4 and len({b[2] for _, b in p}) >= 4}
    got = {r.account_ids[0]: r for r in detectors.gather_scatter(t, cfg).collect()}
    assert set(got) == set(want) and want
    for i, p in want.items():
        ids = sorted({a[0] for a, _ in p}) + sorted({b[0] for _, b in p})
        assert list(got[i].txn_ids) == ids[:50] and got[i].total_usd == pytest.approx(sum(a[4] for a, _ in p))
        assert list(got[i].account_ids) == [i, *sorted({a[1] for a, _ in p}), *sorted({b[2] for _, b in p})]
        assert (got[i].start_ts, got[i].end_ts) == (min(a[3] for a, _ in p), max(b[3] for _, b in p))


def loops(rows, bound, days, tol):
    e = sorted((r for r in rows if r[1] != r[2]), key=lambda r: r[3])
    out, window = [], dt.timedelta(days=days)

    def grow(path):
        first, last = path[0], path[-1]
        for r in e:
            if r[1] == last[2] and last[3] < r[3] <= first[3] + window and first[4] * (1 - tol) <= r[4] <= first[4] * (1 + tol):
                if r[2] == first[1]:
                    out.append(tuple(x[0] for x in [*path, r]))
                elif len(path) + 1 < bound and r[2] not in {x[1] for x in path}:
                    grow([*path, r])

    for r in e:
        grow([r])
    return sorted(out)


@pytest.mark.parametrize(("bound", "days", "tol"), [(4, 2, 0.2), (3, 3, 0.0), (2, 5, 1.5), (3, 0.5, 0.2)])
def test_cycles(t, rows, bound, days, tol):
    cfg = Detectors(cycle_length_bound=bound, cycle_window_days=days, amount_tolerance=tol)
    got = sorted(tuple(r.txn_ids) for r in detectors.temporal_cycles(t, cfg).collect())
    assert got == loops(rows, bound, days, tol) and got


def test_cycles_over_the_cap_are_reported_and_kept(t, rows, caplog):
    cfg = Detectors(cycle_length_bound=2, cycle_window_days=2, max_cycles_per_component=0)
    with caplog.at_level(logging.WARNING):
        assert detectors.temporal_cycles(t, cfg).count() == len(loops(rows, 2, 2, 0.2))
    assert any("cap hit" in r.message for r in caplog.records)


def test_components_in_one_task_or_many(spark):
    rng = np.random.default_rng(7)
    e = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 120, (150, 2))] + [("x", "x"), ("y", "n000")]
    d = spark.createDataFrame(e, "src string, dst string")
    for f in (graph.strongly_connected, graph.weakly_connected):
        one, many = (sorted(map(tuple, f(d, few=few).collect())) for few in (10_000, 0))
        assert one == many and max(x[2] for x in one) > 2


def test_scc_share_and_numbered_pairs(spark):
    rows = [(i, s, d, T0, 1.0, y) for i, (s, d, y) in enumerate([("A", "B", 1), ("B", "A", 0), ("B", "C", 0), ("C", "C", 1), ("A", "B", 0), ("D", "E", 1)])]
    t = spark.createDataFrame(rows, "txn_id long, src string, dst string, timestamp timestamp, amt_usd double, is_laundering int")
    got = {r.kind: (r.transactions, r.in_nontrivial_scc, r.share_pct) for r in graph.scc_share(t, graph.strongly_connected(t)).collect()}
    assert got == {"all": (5, 3, 60.0), "laundering": (2, 1, 50.0)}
    ids, p = graph.numbered_pairs(t)
    assert [r.node for r in ids.orderBy("ix").collect()] == list("ABCDE")
    assert sorted(map(tuple, p.collect())) == [(0, 1, 2, 1), (1, 0, 1, 0), (1, 2, 1, 0), (3, 4, 1, 1)]


def test_positions_in_the_order_of_names(spark, monkeypatch):
    whole = scans.binned
    monkeypatch.setattr(scans, "binned", lambda df, by, per_bin=0: whole(df, by, 30))
    d = spark.range(200).select(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("name"), "id")
    got = [(r.name, r.id) for r in scans.positions(d, ["name", "id"], "at").orderBy("at").collect()]
    assert got == sorted(got) and len(got) == 200


def test_names_settle_as_handing_them_out_in_order_would(spark, monkeypatch):
    monkeypatch.setattr(names, "name_of", lambda a, salt=0: f"name {(sum(map(ord, a)) * 7 + salt * 13) % 97}")
    ids = [f"acc{i}" for i in range(60)]
    want, taken = {}, set()
    for a in sorted(ids):
        salt = next(s for s in range(1000) if names.name_of(a, s) not in taken)
        want[a] = names.name_of(a, salt)
        taken.add(want[a])
    assert names.aliases(ids) == want


def test_shared_folder_off_local_mode(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
