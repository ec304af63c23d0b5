import datetime as dt

import pytest
from pyspark.sql import functions as F

from heddle import schemas
from heddle.config import Detectors
from heddle.operators import detectors, evaluation

T0 = dt.datetime(2022, 9, 1)
CFG = Detectors(fan_percentile=90, fan_min_degree=5)


def network():
    e = []

    def add(src, dst, hours, usd):
        e.append((src, dst, T0 + dt.timedelta(hours=hours), float(usd), len(e), "US Dollar", "US Dollar"))

    def loop(name, hours, usd):
        for i in range(3):
            add(f"{name}{i + 1}", f"{name}{(i + 1) % 3 + 1}", hours[i], usd[i])

    loop("V", (1, 2, 3), (1000, 950, 900))
    loop("W", (5, 4, 6), (1000, 1000, 1000))
    loop("X", (7, 8, 9), (1000, 1000, 3000))
    loop("Y", (10, 370, 730), (1000, 1000, 1000))
    for i in range(8):
        add("F", f"FO{i}", 20 + i / 2, 100 + i)
    for i in range(8):
        add(f"FI{i}", "G", 30 + i / 2, 100 + i)
    for i in range(3):
        add("S", f"I{i}", 40 + i, 1000)
        add(f"I{i}", "D", 50 + i, 990)
    for i in range(3):
        add(f"GS{i}", "H", 60 + i, 500)
        add("H", f"GD{i}", 70 + i, 495)
    for src, dst, h, usd in (("PA", "P", 80, 5000), ("PB", "P", 90, 5000), ("P", "PC", 81, 4990), ("P", "PD", 91, 4995), ("RA", "R", 80, 5000), ("RB", "R", 90, 5000), ("R", "RC", 200, 100), ("R", "RD", 210, 100)):
        add(src, dst, h, usd)
    add("P", "P", 100, 9999)
    return e


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(network(), "src string, dst string, timestamp timestamp, amt_usd double, txn_id long, pay_ccy string, recv_ccy string").cache()


def test_findings_have_one_schema(t):
    f = detectors.run_all(t, CFG)
    assert [x.name for x in f.schema] == [x.name for x in schemas.FINDINGS]
    rows = f.collect()
    assert {r.detector for r in rows} == set(schemas.DETECTORS)
    loops = {r.txn_id for r in t.where("src = dst").collect()}
    assert not any(loops & set(r.txn_ids) for r in rows)


def test_cycles(t):
    (r,) = detectors.temporal_cycles(t, CFG).collect()
    assert list(r.account_ids) == ["V1", "V2", "V3"] and list(r.txn_ids) == [0, 1, 2]
    assert 0.5 <= r.score <= 1 and r.total_usd == 2850 and r.detail == "3 hops, max amount deviation 10.0%"
    assert detectors.temporal_cycles(t, Detectors(cycle_length_bound=2)).count() == 0
    assert detectors.temporal_cycles(t, CFG, narrow=False).count() == 1


def test_fans(t):
    (out,), (inn,) = detectors.fan_out(t, CFG).collect(), detectors.fan_in(t, CFG).collect()
    assert out.account_ids[0] == "F" and len(out.txn_ids) == 8 and out.score > 0 and len(out.account_ids) == 9
    assert inn.account_ids[0] == "G" and out.txn_ids[0] == max(out.txn_ids)  # the largest amount first


def test_sliding_distinct_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("AB"), rng.choice("uvwxyz"), rng.randrange(0, 20) * 3_600_000_000 * 6) for _ in range(400)]
    d = spark.createDataFrame(rows, "k string, other string, us long")
    got = sorted(map(tuple, detectors.sliding_distinct(d, 1).collect()))
    day = 86_400_000_000
    want = sorted((k, us, len({o for j, o, u in rows if j == k and us - day <= u <= us})) for k, _, us in rows)
    assert got == want


def test_two_hop_structures(t):
    (sg,) = detectors.scatter_gather(t, CFG).collect()
    assert list(sg.account_ids) == ["S", "I0", "I1", "I2", "D"] and len(sg.txn_ids) == 6 and sg.score == 0.5
    (gs,) = detectors.gather_scatter(t, CFG).collect()
    assert gs.account_ids[0] == "H" and gs.detail == "3 sources -> hub -> 3 destinations"
    # a first payment counts once for each second hop
    assert gs.total_usd == 500 * 9
    few = Detectors(max_intermediary_txns=2)
    assert detectors.gather_scatter(t, few).count() == 0
    assert {r.acc for r in detectors.intermediaries(t, few).where("not ok").collect()} == {"H"}


def test_pass_through(t):
    found = {r.account_ids[0] for r in detectors.pass_through(t, CFG).collect()}
    assert "P" in found and "R" not in found


def test_empty_input(spark, t):
    assert detectors.run_all(t.where("false"), CFG).count() == 0


def test_evaluation(spark):
    f = spark.createDataFrame([("temporal_cycle", [1, 2, 3]), ("fan_out", [10])], "detector string, txn_ids array<long>")
    p = spark.createDataFrame([(0, "CYCLE", "Max 3 hops", i) for i in (1, 2, 3, 4)] + [(1, "FAN-OUT", "", 10), (1, "FAN-OUT", "", 11)], "attempt_id int, typology string, detail string, txn_id long")
    y = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (11, 1), (3, 0), (10, 0)], "txn_id long, is_laundering int")
    r = {x.typology: x for x in evaluation.typology_recall(f, p).collect()}
    assert (r["CYCLE"].temporal_cycle, r["FAN-OUT"].temporal_cycle, r["FAN-OUT"].fan_out, r["ALL"].any_detector) == (1, 0, 1, 1)
    d = {x.detector: x for x in evaluation.detector_precision(f, y, p).collect()}
    assert d["temporal_cycle"].precision == pytest.approx(2 / 3) and d["temporal_cycle"].finding_precision == 1
    assert d["fan_out"].n_laundering == 0 and d["ANY"].n_findings == 2 and d["ANY"].finding_precision is None
    assert [tuple(x) for x in evaluation.cycle_recall_by_hops(f, p).collect()] == [("3", 1, 1.0)]
    assert {x.size_bucket: x.detected for x in evaluation.recall_by_size(f, p).collect()} == {"1-2": 1.0, "3-5": 1.0}
    s = y.withColumn("p", F.lit(1.0)).withColumnRenamed("is_laundering", "y")
    rt = {x.typology: x.n_test_txns for x in evaluation.recall_by_typology(s.union(spark.createDataFrame([(99, 1, 0.0)], s.schema)), p, 0.5).collect()}
    assert rt == {"CYCLE": 3, "FAN-OUT": 1, "UNATTRIBUTED": 1, "ALL": 5}


def test_attempts_of_any_size_have_a_bucket(spark):
    f = spark.range(1_200).agg(F.lit("fan_out").alias("detector"), F.collect_list("id").alias("txn_ids"))
    p = spark.range(4_002).select(F.when(F.col("id") < 1_001, 0).when(F.col("id") < 4_001, 1).otherwise(2).alias("attempt_id"), F.lit("STACK").alias("typology"), F.col("id").alias("txn_id"))
    assert sorted(tuple(x) for x in evaluation.recall_by_size(f, p).collect()) == [("1-2", 1, 0.0), (">10", 2, 0.5)]


def test_score_metrics(spark):
    def frame(y, s):
        return spark.createDataFrame(list(zip(y, s, strict=True)), "y int, score double")

    d = frame([1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1])
    assert {r.k: pytest.approx(r.precision) for r in evaluation.precision_at(d, [1, 3, 50]).collect()} == {1: 1, 3: 2 / 3, 50: 0.4}
    tied = frame([1, 0, 1, 0, 0], [0.5] * 5)
    assert evaluation.precision_at(tied, [2]).first().precision == pytest.approx(0.4)
    e = frame([0, 0, 1, 1, 0, 1], [0.1, 0.2, 0.8, 0.9, 0.3, 0.7])
    b = evaluation.best_f1(e).first()
    assert b.f1 == 1.0 and 0.3 < b.threshold <= 0.7
    m = evaluation.metrics_at(e, 0.5, [2])
    assert (m["tp"], m["fp"], m["precision@2"], m["pr_auc"]) == (3, 0, 1, pytest.approx(1))
    assert evaluation.average_precision(d).first()[0] == pytest.approx((1 + 2 / 3) / 2)
