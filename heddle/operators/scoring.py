"""Score tables of transactions and accounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle import schemas
from heddle.functions import scans
from heddle.functions.columns import legs
from heddle.operators.features import standardised

# How features and detectors read in reasons.
FRIENDLY = {
    "n_in": "incoming transaction count",
    "n_out": "outgoing transaction count",
    "deg_in": "number of distinct senders",
    "deg_out": "number of distinct recipients",
    "usd_in_sum": "total USD received",
    "usd_in_mean": "mean USD received",
    "usd_in_max": "largest USD received",
    "usd_out_sum": "total USD sent",
    "usd_out_mean": "mean USD sent",
    "usd_out_max": "largest USD sent",
    "span_hours": "activity span",
    "max_txns_24h": "peak transactions in 24h",
    "n_self_loops": "self-loop count",
    "ratio_out_in": "outflow/inflow ratio",
    "median_dwell_hours": "median dwell time",
    "n_counterparties": "number of counterparties",
    "pagerank_scaled": "PageRank",
    "clustering": "clustering coefficient",
    "cross_ccy_share": "cross-currency share",
    "round_share": "round-amount share",
}
DETECTOR_TEXT = {
    "temporal_cycle": "in a time-ordered cycle",
    "fan_out": "fan-out burst",
    "fan_in": "fan-in burst",
    "scatter_gather": "scatter-gather structure",
    "gather_scatter": "gather-scatter hub",
    "pass_through": "pass-through behaviour",
}


def score_transactions(t: DataFrame, margins: DataFrame, split: DataFrame, threshold: float, weight: float = 1.0) -> DataFrame:
    """Transactions with margin, flagged, prob, score (rank share) and split.

    A margin is half the log-odds; prob has the class weight of the training taken off them.
    """
    s = margins.withColumns({"flagged": F.col("margin") >= threshold, "prob": 1 / (1 + F.exp(math.log(weight) - 2 * F.col("margin")))})
    s = scans.mean_ranks(s, "margin", "score").join(split.select("txn_id", "split"), "txn_id", "left")
    cols = ["txn_id", "timestamp", "src", "dst", "amt_usd", "payment_format", "pay_ccy", "recv_ccy", "is_laundering"]
    return t.select(*cols).join(s, "txn_id").select(*cols, "score", "prob", "margin", "flagged", "split")


def account_maxima(scored: DataFrame) -> DataFrame:
    """(acc, max_supervised_score, n_laundering_txns) over both sides of transactions."""
    e = legs(scored, "score", "is_laundering")
    return e.groupBy("acc").agg(F.max("score").alias("max_supervised_score"), F.sum(F.col("is_laundering").cast("long")).alias("n_laundering_txns"))


def reasons(features: DataFrame, top: int = 3, key: str = "acc") -> DataFrame:
    """(key, reasons): detector hits first, then the most extreme standardised features."""
    hits = [c for c in features.columns if c.startswith("hits_")]
    z = standardised(features.drop(*hits), [key])
    named = [c for c in z.columns if c in FRIENDLY]
    z = z.select(key, F.slice(F.sort_array(F.array(*[F.struct(F.abs(F.col(c)).alias("a"), F.lit(-i).alias("i"), F.lit(FRIENDLY[c]).alias("n"), F.col(c).alias("z")) for i, c in enumerate(named)]), asc=False), 1, top).alias("x"))

    def say(x: Column) -> Column:
        return F.format_string("%s unusually %s (z=%+.1f)", x["n"], F.when(x["z"] > 0, "high").otherwise("low"), x["z"])

    found = [F.when(F.col(f"hits_{d}") > 0, F.format_string(f"{DETECTOR_TEXT[d]} (x%d)", F.col(f"hits_{d}"))) for d in schemas.DETECTORS if f"hits_{d}" in hits]
    listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return features.select(key, listed.alias("d")).join(z, key).select(key, F.slice(F.concat("d", F.transform("x", say)), 1, top).alias("reasons"))


def account_scores(features: DataFrame, anomaly: DataFrame, scored: DataFrame) -> DataFrame:
    """A row for each account: anomaly and highest supervised score, risk (mean of both ranks), hits, flows, reasons."""
    hits = [c for c in features.columns if c.startswith("hits_")]
    a = features.join(anomaly, "acc", "left").withColumnRenamed("ensemble", "anomaly_score").join(account_maxima(scored), "acc", "left")
    a = a.withColumns({
        "max_supervised_score": F.coalesce("max_supervised_score", F.lit(0.0)),
        "is_illicit_account": (F.coalesce("n_laundering_txns", F.lit(0)) > 0).cast("int"),
        "__anomaly": F.coalesce("anomaly_score", F.lit(0.0)),
    })
    a = scans.mean_ranks(scans.mean_ranks(a, "__anomaly", "__r1"), "max_supervised_score", "__r2")
    a = a.withColumn("risk", (F.col("__r1") + F.col("__r2")) / 2).join(reasons(features), "acc")
    models = [c for c in ("iforest", "lof", "hdbscan") if c in a.columns]
    return a.select("acc", "anomaly_score", *models, "max_supervised_score", "risk", *hits, F.col("usd_in_sum").alias("usd_in"), F.col("usd_out_sum").alias("usd_out"), "n_in", "n_out", "n_laundering_txns", "is_illicit_account", "reasons")
