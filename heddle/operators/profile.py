"""Descriptive tables of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import is_round, legs, micros


def scale(t: DataFrame) -> DataFrame:
    accounts = legs(t).agg(F.count_distinct("acc").alias("n_accounts"))
    span = (F.max(micros(F.col("timestamp"))) - F.min(micros(F.col("timestamp")))) / 8.64e10
    return t.agg(F.count("*").alias("n_txns"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), span.alias("days")).select("*", accounts.scalar().alias("n_accounts"))


def rate_by(t: DataFrame, by: Column, name: str) -> DataFrame:
    """(name, n, illicit, rate): transactions and laundering by an expression's values."""
    bad = F.col("is_laundering").cast("long")
    return t.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.sum(bad).alias("illicit"), F.avg(bad.cast("double")).alias("rate"))


def class_balance(t: DataFrame) -> DataFrame:
    n = t.groupBy("is_laundering").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.select("is_laundering", "n", (F.col("n") / total.scalar()).alias("share"))


def cross_currency(t: DataFrame) -> DataFrame:
    x = F.col("pay_ccy") != F.col("recv_ccy")
    return t.groupBy("is_laundering").agg(F.count("*").alias("n"), F.count_if(x).alias("n_cross"), F.avg(x.cast("int")).alias("share"))


def self_loop_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("is_laundering").agg(F.expr("count(*) FILTER (WHERE src = dst)").alias("n_self_loops"))


def round_amounts(t: DataFrame) -> DataFrame:
    a = F.col("amt_paid")
    return t.groupBy("is_laundering").agg(F.avg(is_round(a).cast("int")).alias("round_100"), F.avg(is_round(a, 1.0).cast("int")).alias("whole"))


def per_period(t: DataFrame, unit: str) -> DataFrame:
    return rate_by(t, F.date_trunc(unit, F.col("timestamp")), "period")


def amount_quantiles(t: DataFrame, by: str = "is_laundering", at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Counts, moments and quantiles of amt_usd; quantiles to a rank error of a thousandth of a percent, in bounded memory."""
    q = F.percentile_approx("amt_usd", list(at), 100_000)
    g = t.groupBy(by).agg(F.count("amt_usd").alias("n"), F.avg("amt_usd").alias("mean"), F.stddev("amt_usd").alias("std"), F.min("amt_usd").alias("min"), F.max("amt_usd").alias("max"), q.alias("q"))
    return g.select(by, "n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(at)], "max")


def log_histogram(t: DataFrame, column: str = "amt_usd", per_decade: int = 10, by: str = "is_laundering") -> DataFrame:
    """(by, bin, n): bin is the floor of per_decade * log10, of values above 0."""
    return t.where(F.col(column) > 0).groupBy(by, F.floor(F.log10(column) * per_decade).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sample_keeping_positives(t: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    return t.where((F.col("is_laundering") == 1) | (F.rand(seed) < fraction))


def sample_by_class(t: DataFrame, positives: int, negatives: int, seed: int = 42) -> DataFrame:
    """At most so many rows of each class, drawn evenly."""
    parts = [t.where(F.col("is_laundering") == y).orderBy(F.rand(seed)).limit(n) for y, n in ((1, positives), (0, negatives))]
    return parts[0].union(parts[1])


def typology_summary(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("typology").agg(F.count_distinct("attempt_id").alias("attempts"), F.count("*").alias("n_rows"))
