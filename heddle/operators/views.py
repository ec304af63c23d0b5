"""The queries behind an investigation view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import flows, legs
from heddle.operators import graph


def filtered_view(t: DataFrame, name: str, condition: str = "true") -> DataFrame:
    """Registers the rows of t that hold the condition as a view for SQL, and gives them back."""
    d = t.where(condition)
    d.createOrReplaceTempView(name)
    return d


def bound(spark: SparkSession, text: str, **values: object) -> DataFrame:
    """SQL with its :names bound to values, which are never read as SQL."""
    return spark.sql(text, args=values)


def most_common(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """(column, n): the value with the most rows, or the fewest; ties by value."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n") if descending else F.asc("n"), column).limit(1)


def account_transactions(t: DataFrame, account: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """An account's transactions, no self-loops, times inclusive, with direction and counterparty, by time."""
    d = flows(t).where((F.col("src") == account) | (F.col("dst") == account))
    if start is not None:
        d = d.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        d = d.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    out = F.col("src") == account
    return d.withColumns({"direction": F.when(out, "out").otherwise("in"), "counterparty": F.when(out, F.col("dst")).otherwise(F.col("src"))}).orderBy("timestamp", "txn_id")


def scores_of(scored: DataFrame, ids: list[int]) -> DataFrame:
    wanted = scored.sparkSession.createDataFrame([(i,) for i in ids], "txn_id long")
    return scored.join(F.broadcast(wanted), "txn_id", "left_semi")  # the ids on display


def money_flows(t: DataFrame, account: str, first: int = 8, second: int = 4) -> DataFrame:
    """(direction, level, src, dst, usd, n): the largest flows into and out of an account, two levels each way."""
    d = flows(t).groupBy("src", "dst").agg(F.sum("amt_usd").alias("usd"), F.count("*").alias("n"))
    parts = []
    for direction, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        one = graph.top_by(d.where(F.col(near) == account), [near], "usd", first, [far])
        mid = F.broadcast(one.select(F.col(far).alias(near)))  # `first` rows
        two = graph.top_by(d.join(mid, near, "left_semi").where(F.col(far) != account), [near], "usd", second, [far])
        parts += [x.select(F.lit(direction).alias("direction"), F.lit(level).alias("level"), "src", "dst", "usd", "n") for level, x in ((1, one), (2, two))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def network(edges: DataFrame, scored: DataFrame, findings: DataFrame) -> DataFrame:
    """(src, dst, n, usd, max_score, detector, illicit) of an ego network's pairs; detector: the first by name that covers one of its transactions."""
    seen = findings.select("detector", F.explode("txn_ids").alias("txn_id")).groupBy("txn_id").agg(F.min("detector").alias("detector"))
    e = edges.join(scored.select("txn_id", "score"), "txn_id", "left").join(seen, "txn_id", "left")
    return e.groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.sum("amt_usd").alias("usd"), F.max("score").alias("max_score"), F.min("detector").alias("detector"), F.max(F.col("is_laundering").cast("int")).alias("illicit")
    )


def node_flows(edges: DataFrame) -> DataFrame:
    """(acc, usd_in, usd_out) within an ego network."""
    e = legs(edges, "amt_usd")
    return e.groupBy("acc").agg(*[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("amt_usd"))), F.lit(0.0)).alias(f"usd_{r}") for r in ("in", "out")])


def findings_of(findings: DataFrame, account: str, n: int = 15) -> DataFrame:
    return findings.where(F.array_contains("account_ids", account)).orderBy(F.desc("score"), "detector", "start_ts").limit(n)


def top_accounts(scores: DataFrame, n: int = 50, by: str = "risk") -> DataFrame:
    return scores.orderBy(F.desc(by), "acc").limit(n)


def percentile_of(scores: DataFrame, column: str, value: float) -> DataFrame:
    """(share): the share of rows below a value."""
    return scores.agg(F.avg((F.col(column) < value).cast("int")).alias("share"))
