import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import config, pipeline
from heddle.operators import attribution, supervised, views
from heddle.streaming import bursts


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A small raw data set with planted fans, run through all steps."""
    path = tmp_path_factory.mktemp("root")
    raw = path / "data/raw"
    raw.mkdir(parents=True)
    rng = random.Random(4)
    lines = ["Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"]
    bad = []
    for i in range(900):
        ts = (dt.datetime(2022, 9, 1) + dt.timedelta(minutes=30 * i)).strftime("%Y/%m/%d %H:%M")
        y = int(i % 15 == 0)
        a, b = ("900", f"{i // 15 % 30}") if y else (f"{rng.randrange(40)}", f"{rng.randrange(40)}")
        paid = rng.randrange(10_000, 90_000) / 100 + 200
        pay, recv = ("Euro", "US Dollar") if i % 10 == 1 else ("US Dollar", "US Dollar") if i % 2 else ("Euro", "Euro")
        got = round(paid * 1.2, 2) if pay != recv else paid
        row = f"{ts},01,{a},02,{b},{got},{recv},{paid},{pay},{'Wire' if i % 3 else 'ACH'},{y}"
        lines.append(row)
        if y:
            bad.append(row)
    (raw / "HI-Small_Trans.csv").write_text("\n".join(lines) + "\n")
    blocks = []
    for k in range(0, 30, 5):
        blocks += ["BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 5-degree Fan-Out", *bad[k : k + 5], "END LAUNDERING ATTEMPT - FAN-OUT"]
    blocks += ["BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 3 hops", *bad[30:33], "END LAUNDERING ATTEMPT - CYCLE"]
    (raw / "HI-Small_Patterns.txt").write_text("\n".join(blocks) + "\n")
    cfg = config.Config(anomaly=config.Anomaly(min_cluster_size=5, small_cluster_size=20, pca_components=3, lof_neighbors=5, iforest_estimators=20, precision_at_k=(5,)), detectors=config.Detectors(cycle_length_bound=3, fan_percentile=95), supervised=config.Supervised(lookback_days=(7,)))
    t = pipeline.Tables(spark, f"file://{path}", cfg)
    for step in pipeline.STEPS.values():
        step(t)
    return t


def test_all_steps(root):
    txns = root.read("transactions")
    assert txns.count() == 900 and txns.where("amt_usd is null").count() == 0
    assert root.read("patterns").where("txn_id is null").count() == 0
    found = root.read("findings")
    assert "01_900" in {r.account_ids[0] for r in found.where("detector = 'fan_out'").collect()}
    scores = root.read("account_scores")
    assert scores.count() == root.read("account_features").count() == root.read("anomaly_scores").count()
    assert scores.where("risk is null or size(reasons) = 0").count() == 0
    tx = root.read("transaction_scores")
    assert tx.count() == 900 and {r.split for r in tx.select("split").distinct().collect()} == {"train", "val", "test"}
    assert tx.agg(F.max("score")).first()[0] <= 1
    assert views.findings_of(found, "01_900").count() > 0


def test_attributions_add_up(spark, root):
    model = supervised.load(f"{root.root}/{root.cfg.paths.models_dir}/gbt")
    split = root.read("txn_features_split").where("split = 'test'").limit(40)
    got = attribution.attributions(model, split)
    sums = {r.txn_id: r.s for r in got.groupBy("txn_id").agg(F.sum("shap").alias("s")).collect()}
    base = attribution.expected(attribution.leaves(model))
    for r in supervised.margins(model, split).collect():
        assert sums[r.txn_id] + base == pytest.approx(r.margin, abs=1e-6)
    assert attribution.strongest(got, 3).count() == 3


def test_shapley_is_exact_on_a_small_tree():
    # x0 <= 0.5 ? (x1 <= 0.5 ? 1 : 3) : 10, with half of the rows each way
    parts = [(1.0, [(0, [("le", 0.5)], 0.5), (1, [("le", 0.5)], 0.5)]), (3.0, [(0, [("le", 0.5)], 0.5), (1, [("gt", 0.5)], 0.5)]), (10.0, [(0, [("gt", 0.5)], 0.5)])]
    s = attribution.shapley(parts, np.array([[0.0, 0.0], [1.0, 0.0]]))
    assert attribution.expected(parts) == 6
    assert s == pytest.approx(np.array([[-4.25, -0.75], [4.25, -0.25]]))


def test_streams(spark, tmp_path):
    rows = [("A", f"B{i}", dt.datetime(2022, 9, 1, i), 10.0) for i in range(5)] + [("A", "A", dt.datetime(2022, 9, 1, 6), 1.0), ("C", "D", dt.datetime(2022, 10, 1), 1.0)]
    d = spark.createDataFrame(rows, "src string, dst string, timestamp timestamp, amt_usd double")
    d.write.parquet(f"{tmp_path}/in")
    for name, f, column in (("fan", bursts.fan_counts, "n_others"), ("sessions", bursts.activity_sessions, "n_txns")):
        s = f(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"))
        q = s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).where("acc = 'A'").agg(F.max(column)).first()[0] == 5
