"""The analyses end to end: python -m heddle.pipeline data|features|detect|train ROOT [--config FILE].

Tables are written below ROOT/<processed_dir>, each step's under its own name; a step that has run
already needs a new ROOT, as tables are never rewritten in place.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import config, session
from heddle.functions import scans
from heddle.operators import anomaly, clusters, detectors, evaluation, features, fx, scoring, supervised
from heddle.sources import attempts, transactions

log = logging.getLogger(__name__)


class Tables:
    """Paths of a root's tables."""

    def __init__(self, spark: SparkSession, root: str, cfg: config.Config):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg

    def path(self, name: str) -> str:
        return f"{self.root}/{self.cfg.paths.processed_dir}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        transactions.write(df, self.path(name))
        return self.read(name)

    def report(self, df: DataFrame, name: str) -> None:
        transactions.write_report(df, f"{self.root}/{self.cfg.paths.tables_dir}/{name}")


def data(t: Tables) -> None:
    """Raw files to typed transactions in USD, and attempts matched to them."""
    raw = f"{t.root}/{t.cfg.paths.raw_dir}"
    plain = transactions.ingest(t.spark, f"{raw}/{t.cfg.dataset.transactions_file}", t.path("transactions_raw"))
    pairs = fx.pair_medians(plain)
    rates = fx.chain(pairs)
    for w in fx.warnings(rates, pairs).collect():  # currencies and their pairs
        log.warning("%s: %s %s (expected %s)", w.kind, w.subject, w.value, w.expected)
    t.report(rates, "fx_rates")
    t.report(pairs, "fx_pair_medians")
    done = t.write(fx.to_usd(plain, rates), "transactions")
    listed = attempts.match(attempts.parse(t.spark, f"{raw}/{t.cfg.dataset.patterns_file}"), done)
    t.write(listed, "patterns")


def build_features(t: Tables) -> None:
    txns = t.read("transactions")
    t.write(features.account_features(txns), "account_features")
    t.write(features.transaction_features(txns, t.cfg.supervised.lookback_days), "txn_features")


def anomaly_scores(feats: DataFrame, cfg: config.Anomaly, seed: int, key: str = "acc") -> DataFrame:
    """(key, iforest, lof, hdbscan, hdbscan_flag, ensemble)."""
    z = session.stored(features.standardised(feats, [key]), "z")
    names = [c for c in z.columns if c != key]
    p = session.stored(anomaly.principal_components(z, key, names, cfg.pca_components), "components")
    s = anomaly.isolation_forest(z, key, names, cfg.iforest_estimators, seed)
    s = s.join(anomaly.local_outlier_factor(p, key, cfg.lof_neighbors), key).join(clusters.hdbscan(p, key, cfg.min_cluster_size, cfg.small_cluster_size), key)
    ranked = session.stored(anomaly.mean_rank(session.stored(s, "scores"), ["iforest", "lof", "hdbscan"]), "ensemble")
    # the given share of accounts, by the ensemble, are flagged
    return scans.mean_ranks(ranked, "ensemble", "__at").withColumn("flagged", F.col("__at") > 1 - cfg.contamination).drop("__at")


def detect(t: Tables) -> None:
    txns, listed = t.read("transactions"), t.read("patterns")
    found = t.write(detectors.run_all(txns, t.cfg.detectors), "findings")
    thr = t.cfg.detectors.attempt_detection_threshold
    t.report(evaluation.typology_recall(found, listed, thr), "detector_recall_by_typology")
    t.report(evaluation.detector_precision(found, txns.select("txn_id", "is_laundering"), listed, thr), "detector_precision")
    t.report(evaluation.recall_by_size(found, listed, thr), "detector_recall_by_attempt_size")
    t.report(evaluation.cycle_recall_by_hops(found, listed, thr), "detector_cycle_recall_by_hops")
    full = t.write(features.detector_counts(t.read("account_features"), found), "account_features_full")
    scores = t.write(anomaly_scores(full, t.cfg.anomaly, t.cfg.seed), "anomaly_scores")
    t.report(evaluation.anomaly_table(scores, evaluation.account_labels(txns), ["iforest", "lof", "hdbscan", "ensemble"], t.cfg.anomaly.precision_at_k, seed=t.cfg.seed, flag="hdbscan_flag"), "anomaly_results")


def train(t: Tables) -> None:
    cfg = t.cfg.supervised
    split = t.write(supervised.temporal_split(t.read("txn_features"), cfg.train_frac, cfg.val_frac), "txn_features_split")
    weight = supervised.class_weight(split, cfg)
    model = supervised.fit(split, cfg, seed=t.cfg.seed, weight=weight)
    margins = t.write(supervised.margins(model, split), "margins")
    scored = margins.join(split.select("txn_id", "timestamp", "split", F.col("is_laundering").alias("y")), "txn_id").withColumnRenamed("margin", "score")
    threshold = evaluation.best_f1(scored.where("split = 'val'")).first().threshold
    supervised.save(model, f"{t.root}/{t.cfg.paths.models_dir}/gbt", supervised.described(model, split, threshold, weight))
    ks = t.cfg.anomaly.precision_at_k
    rows = [(part, k, float(v)) for part in ("val", "test") for k, v in evaluation.metrics_at(scored.where(F.col("split") == part), threshold, ks).items()]
    eras = evaluation.by_era(scored.where("split = 'test'"), cfg.era_cut, threshold, ks)
    rows += [(f"test_{era}", k, float(v)) for era, found in eras.items() for k, v in found.items()]
    t.report(t.spark.createDataFrame(rows, "part string, metric string, value double"), "supervised_metrics")
    t.report(t.spark.createDataFrame(supervised.importances(model), "feature string, gain double"), "supervised_feature_importance")
    t.report(evaluation.recall_by_typology(scored.where("split = 'test'").withColumnRenamed("score", "p"), t.read("patterns"), threshold), "supervised_recall_by_typology")
    tx = t.write(scoring.score_transactions(t.read("transactions"), margins, split.select("txn_id", "split"), threshold, weight), "transaction_scores")
    t.write(scoring.account_scores(t.read("account_features_full"), t.read("anomaly_scores"), tx), "account_scores")


STEPS = {"data": data, "features": build_features, "detect": detect, "train": train}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("steps", nargs="+", choices=STEPS)
    p.add_argument("root")
    p.add_argument("--config", type=Path)
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    tables = Tables(session.build(), a.root, config.load(a.config))
    for step in a.steps:
        STEPS[step](tables)


if __name__ == "__main__":
    main()
