"""The test tables' events as a transaction network, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCIES = ["US Dollar", "Euro", "Yen", "UK Pound", "Rupee"]
USD = [1.0, 1.17, 0.0095, 1.29, 0.0136]

_CCY = "[" + ", ".join(f"'{c}'" for c in CURRENCIES) + "]"
_USD = "[" + ", ".join(f"{u}::DOUBLE" for u in USD) + "]"

#: Common table expressions that define t, the same transactions in DuckDB's SQL.
T_SQL = f"""
WITH e AS (SELECT event_id, date_trunc('minute', ts) AS ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                  (SELECT max(user_id) + 1 FROM events) AS n FROM events),
t AS (SELECT event_id AS txn_id, ts AS timestamp, 'U' || user_id AS src, 'U' || ((user_id * 7 + k * 13) % n) AS dst, value AS amt_paid,
             event_type AS payment_format, {_CCY}[user_id % 5 + 1] AS pay_ccy,
             {_CCY}[(user_id + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS recv_ccy,
             CASE WHEN event_type = 'error' AND k < 20 THEN 1 ELSE 0 END AS is_laundering,
             value * {_USD}[user_id % 5 + 1] AS amt_usd,
             value * {_USD}[user_id % 5 + 1] / {_USD}[(user_id + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS amt_received
      FROM e),
f AS (SELECT * FROM t WHERE src <> dst),
legs AS (SELECT src AS acc, dst AS other, 'out' AS role, * FROM f UNION ALL SELECT dst, src, 'in', * FROM f)
"""

def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.agg(F.max("user_id") + 1).first()[0]
    k = F.get_json_object("props", "$.k").cast("long")
    ccy = F.array(*[F.lit(c) for c in CURRENCIES])
    usd = F.array(*[F.lit(u) for u in USD])
    pay = (F.col("user_id") % 5).cast("int")
    recv = ((F.col("user_id") + F.when(k % 10 == 0, 1).otherwise(0)) % 5).cast("int")
    return e.select(
        F.col("event_id").alias("txn_id"), F.date_trunc("minute", "ts").alias("timestamp"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("U"), ((F.col("user_id") * 7 + k * 13) % F.lit(n)).cast("string")).alias("dst"),
        F.col("value").alias("amt_paid"), F.col("event_type").alias("payment_format"), F.get(ccy, pay).alias("pay_ccy"), F.get(ccy, recv).alias("recv_ccy"),
        F.when((F.col("event_type") == "error") & (k < 20), 1).otherwise(0).alias("is_laundering"),
        (F.col("value") * F.get(usd, pay)).alias("amt_usd"), (F.col("value") * F.get(usd, pay) / F.get(usd, recv)).alias("amt_received"),
    )
