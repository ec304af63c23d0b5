import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from heddle import config
from heddle.config import Supervised
from heddle.functions import columns as C
from heddle.operators import evaluation, profile, scoring, supervised, views

T0 = dt.datetime(2022, 9, 1)


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        usd = float(rng.lognormal(3, 1))
        rows.append((i, T0 + dt.timedelta(hours=i), f"A{i % 9}", f"B{i % 7}", usd, int(rng.random() < (0.6 if usd > 40 else 0.05)), ["ACH", "Wire"][i % 2], "Euro", "Euro", ["train", "val", "test"][min(2, i // 250)]))
    return spark.createDataFrame(rows, "txn_id long, timestamp timestamp, src string, dst string, amt_usd double, is_laundering int, payment_format string, pay_ccy string, recv_ccy string, split string").cache()


@pytest.mark.parametrize("power", [0.0, 0.5])
def test_probabilities(split, power):
    cfg = Supervised(pos_weight_power=power)
    weight = supervised.class_weight(split, cfg)
    model = supervised.fit(split, cfg, rounds=5, depth=3, weight=weight)
    assert (weight == 1) == (power == 0)
    s = scoring.score_transactions(split, supervised.margins(model, split), split, 0.0, weight)
    own = {r.txn_id: r.p for r in model.transform(split).select("txn_id", vector_to_array("probability")[1].alias("p")).collect()}
    for r in s.collect():
        odds = own[r.txn_id] / (1 - own[r.txn_id]) / weight
        assert r.prob == pytest.approx(odds / (1 + odds)) and r.flagged == (r.margin >= 0)


def test_saved_model_says_how_to_score(split, tmp_path):
    model = supervised.fit(split, rounds=3, depth=2)
    supervised.save(model, f"file://{tmp_path}/m", supervised.described(model, split, 0.25, 2.0))
    about = supervised.about(f"file://{tmp_path}/m")
    assert about["threshold"] == 0.25 and about["class_weight"] == 2.0 and about["threshold_is_margin"] and about["features"][0] == "amt_usd"
    assert about["categories"]["payment_format"] == ["ACH", "Wire"] and about["boundaries"]["train"].startswith("2022-09-01")
    a, b = (sorted(map(tuple, supervised.margins(m, split).collect())) for m in (model, supervised.load(f"file://{tmp_path}/m")))
    assert a == b


def test_eras(split):
    d = split.select("timestamp", F.col("is_laundering").alias("y"), F.col("amt_usd").alias("score"))
    got = evaluation.by_era(d, "2022-09-11", 40.0, (10,))
    assert set(got) == {"before_2022-09-11", "from_2022-09-11"} and got["before_2022-09-11"]["n"] == 240
    assert sum(x["n"] for x in got.values()) == 600 and 0 < got["from_2022-09-11"]["precision@10"] <= 1
    assert evaluation.by_era(d.where("y = 0"), "2022-09-11", 40.0) == {}


def test_anomaly_table(spark):
    s = spark.createDataFrame([(f"a{i}", i / 10, int(i > 7), 1 - i / 10) for i in range(10)], "acc string, iforest double, hdbscan_flag int, hdbscan double")
    y = spark.createDataFrame([("a9", 1), ("a5", 1), ("stranger", 1)], "acc string, y int")
    got = {r.method: r for r in evaluation.anomaly_table(s, y, ["iforest", "hdbscan"], (2,), flag="hdbscan_flag").collect()}
    assert set(got) == {"iforest", "hdbscan", "random", "random (expected)"}
    h = got["hdbscan"]
    assert (h.flag_precision, h.flag_recall, h.n_accounts, h.n_illicit) == (0.5, 0.5, 10, 2)
    assert got["iforest"].flag_precision is None and got["iforest"].precision_at_2 == 0.5 and got["random (expected)"].pr_auc == 0.2


def test_texts(spark):
    x = spark.createDataFrame([(0.4,), (999.0,), (1500.0,), (-2.5e6,), (3e9,), (4.2e12,)], "x double")
    assert [r[0] for r in x.select(C.usd_text(F.col("x"))).collect()] == ["$0", "$999", "$1.5K", "$-2.5M", "$3.0B", "$4.2T"]
    r = spark.createDataFrame([(0.5,), (0.9,), (0.99,)], "x double")
    assert [v[0] for v in r.select(C.risk_badge(F.col("x"))).collect()] == ["ROUTINE", "ELEVATED", "HIGH"]
    ids = spark.createDataFrame([("070_100428660",), ("x",), (None,)], "a string")
    assert [v[0] for v in ids.select(C.bank_of(F.col("a"))).collect()] == ["070", "x", None]


def test_views(spark, split):
    scored = split.withColumn("score", F.col("amt_usd") / 1000)
    assert sorted(r.txn_id for r in views.scores_of(scored, [3, 5, 99_999]).collect()) == [3, 5]
    edges = split.where("txn_id < 3")
    found = spark.createDataFrame([("fan_out", [0, 1]), ("fan_in", [1])], "detector string, txn_ids array<long>")
    n = {(r.src, r.dst): r for r in views.network(edges, scored, found).collect()}
    assert len(n) == 3 and [n[f"A{i}", f"B{i}"].detector for i in range(3)] == ["fan_out", "fan_in", None]
    assert views.percentile_of(spark.range(10), "id", 4.0).first().share == 0.4
    assert views.most_common(split, "payment_format").first().n == 300 and views.most_common(split, "src", descending=False).count() == 1
    views.filtered_view(split, "some", "is_laundering = 1")
    assert views.bound(spark, "SELECT * FROM some WHERE payment_format = :f", f="ACH' OR 'a' = 'a").count() == 0
    a = spark.createDataFrame([(1, "CYCLE", 5), (1, "CYCLE", 6), (2, "CYCLE", 7), (3, "STACK", 8)], "attempt_id long, typology string, txn_id long")
    assert sorted(map(tuple, profile.typology_summary(a).collect())) == [("CYCLE", 2, 3), ("STACK", 1, 1)]


def test_published_settings_load(tmp_path):
    (tmp_path / "c.yaml").write_text("""
seed: 42
dataset: {name: HI-Small, kaggle_slug: some/where}
paths: {raw_dir: data/raw, processed_dir: data/processed, models_dir: models, figures_dir: reports/figures, tables_dir: reports/tables}
graph: {ego_max_nodes: 300}
detectors: {cycle_length_bound: 6, max_cycles_per_component: 100000, max_expansions_per_component: 20000000, fan_windows_days: [1, 7], max_txns_per_finding: 500}
anomaly: {min_cluster_size: 50, contamination: 0.01, pca_components: 10, lof_neighbors: 20, precision_at_k: [100, 500, 1000]}
supervised: {train_frac: 0.6, val_frac: 0.2, lookback_days: [1, 7, 30], pos_weight_power: 0.25}
""")
    assert config.load(tmp_path / "c.yaml") == config.Config(dataset=config.Dataset(kaggle_slug="some/where"))
