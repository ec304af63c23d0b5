"""Reading and writing transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import schemas
from heddle.functions import scans
from heddle.functions.columns import node_id


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV, all text, named by position (its header repeats a name)."""
    return spark.read.csv(path, header=True, schema=schemas.RAW, enforceSchema=True)


def typed(raw: DataFrame) -> DataFrame:
    """Numbered rows with types, account ids and the self-loop flag; a bad value raises."""
    t = scans.numbered(raw, "txn_id")
    return t.select(
        F.col("txn_id").cast("long"),
        F.to_timestamp("timestamp", schemas.TIMESTAMP_FORMAT).alias("timestamp"),
        "from_bank", "from_acct", "to_bank", "to_acct",
        node_id(F.col("from_bank"), F.col("from_acct")).alias("src"),
        node_id(F.col("to_bank"), F.col("to_acct")).alias("dst"),
        F.col("amt_received").cast("double").alias("amt_received"), "recv_ccy",
        F.col("amt_paid").cast("double").alias("amt_paid"), "pay_ccy", "payment_format",
        F.col("is_laundering").cast("byte").alias("is_laundering"),
        ((F.col("from_bank") == F.col("to_bank")) & (F.col("from_acct") == F.col("to_acct"))).alias("is_self_loop"),
    )


def ingest(spark: SparkSession, csv_path: str, out_path: str) -> DataFrame:
    """Raw CSV to Parquet in file order; gives what was written."""
    write(typed(read_raw(spark, csv_path)).sortWithinPartitions("txn_id"), out_path)
    return load(spark, out_path)


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    t = spark.read.parquet(path)
    return t.select(*columns) if columns else t


def write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet with zstd. A table is never rewritten in place: readers of the old path stay whole, so give a new one."""
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.csv(path, header=True)


def summary(t: DataFrame) -> DataFrame:
    return t.agg(
        F.count("*").alias("n"),
        F.count_distinct("src").alias("n_src"),
        F.sum(F.col("is_laundering").cast("long")).alias("n_illicit"),
        F.sum((F.col("src") == F.col("dst")).cast("long")).alias("n_self_loops"),
        F.min("timestamp").alias("t0"),
        F.max("timestamp").alias("t1"),
    )
