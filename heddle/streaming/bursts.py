"""Streaming forms of the window operators: an extension, with approximate distinct counts and late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_counts(t: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 hour", direction: str = "out") -> DataFrame:
    """(window, acc, n_txns, n_others, usd) over sliding event-time windows; n_others is approximate, so state stays small."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    d = t.where("src <> dst").withWatermark("timestamp", late)
    return d.groupBy(F.window("timestamp", window, slide), F.col(key).alias("acc")).agg(F.count("*").alias("n_txns"), F.approx_count_distinct(other).alias("n_others"), F.sum("amt_usd").alias("usd"))


def activity_sessions(t: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(session_window, acc, n_txns, usd): runs of an account's payments with no longer gap between them."""
    d = t.where("src <> dst").withWatermark("timestamp", late)
    return d.groupBy(F.session_window("timestamp", gap), F.col("src").alias("acc")).agg(F.count("*").alias("n_txns"), F.sum("amt_usd").alias("usd"))
