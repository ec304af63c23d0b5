"""Running and global aggregates that don't gather a key, or the whole table, in one task.

A frame over a hot key is cut into bins: sums run within a bin, and the totals of the bins before it are
added. Only the bins' totals, a few rows each, meet in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.functions.columns import DAY
from heddle.session import stored


def running_totals(marks: DataFrame, key: str, at: str, values: list[str], keep: Column, bin_width: int = DAY) -> DataFrame:
    """Rows of marks where keep holds, with each value replaced by its sum over all of the key's rows with at <= the row's.

    at: a long. Sums over doubles add up to rounding.
    """
    m = marks.withColumn("__bin", F.floor(F.col(at) / bin_width))
    within = Window.partitionBy(key, "__bin").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = m.groupBy(key, "__bin").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("__key"), F.col("__bin").alias("__b"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__c_{v}") for v in values])
    others = [c for c in marks.columns if c not in values]
    local = m.select(*others, "__bin", keep.alias("__keep"), *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(v) for v in values]).where("__keep")
    joined = local.join(carried, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__b")))
    return joined.select(*others, *[(F.col(v) + F.col(f"__c_{v}")).alias(v) for v in values])


def binned(df: DataFrame, by: Column, per_bin: int = 250_000) -> DataFrame:
    """Adds __bin: ranges of by in ascending order, of some per_bin rows each; equal values share a bin, nulls come first.

    The ranges are those of a range partitioning, which are drawn from a sample: the table is written, so that
    all that reads it sees the same.
    """
    rows = df.count()
    bins = max(1, math.ceil(rows / per_bin))
    if bins == 1:
        return df.withColumn("__bin", F.lit(0))
    return stored(df.repartitionByRange(bins, by).withColumn("__bin", F.spark_partition_id()), "binned")


def global_sums(df: DataFrame, by: str, values: list[str], descending: bool = True) -> DataFrame:
    """For a df with one row for each value of by: every value replaced by its sum over rows up to this one."""
    b = binned(df, F.col(by))
    order = F.desc(by) if descending else F.asc(by)
    bin_order = F.desc("__bin") if descending else F.asc("__bin")
    within = Window.partitionBy("__bin").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)  # over bins
    carried = b.groupBy("__bin").agg(*[F.sum(v).alias(v) for v in values])
    carried = carried.select(F.col("__bin").alias("__b"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__c_{v}") for v in values])
    local = b.select(*[c for c in df.columns if c not in values], "__bin", *[F.sum(v).over(within).alias(v) for v in values])
    out = local.join(F.broadcast(carried), F.col("__bin") == F.col("__b"))  # a row for each bin
    return out.select(*[(F.col(c) + F.col(f"__c_{c}")).alias(c) if c in values else F.col(c) for c in df.columns])


def mean_ranks(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds out: the ascending rank of by, averaged over ties, as a share of all rows. Nulls get null."""
    sizes = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = global_sums(sizes.withColumn("__to", F.col("__n")), "__v", ["__to"], descending=False)
    total = df.where(F.col(by).isNotNull()).count()
    ranks = ranks.select("__v", ((F.col("__to") - (F.col("__n") - 1) / 2) / F.lit(max(1, total))).alias(out))
    return df.join(ranks, F.col(by) == F.col("__v"), "left").drop("__v")


def positions(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds out: the 0-based position of each row in ascending order of the columns."""
    b = binned(df, F.col(order[0]))
    within = Window.partitionBy("__bin").orderBy(*order)
    starts = b.groupBy("__bin").agg(F.count("*").alias("__n"))
    starts = starts.select(F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    r = b.withColumn("__r", F.row_number().over(within) - 1).join(F.broadcast(starts), F.col("__bin") == F.col("__b"))
    return r.select(*df.columns, (F.col("__from") + F.col("__r")).cast("long").alias(out))


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds out: the 0-based position of each row in the order of its file, without sorting.

    df must be a plain read of one file: its partitions are counted in one pass and numbered in another. Of several
    files each is numbered through, but Spark reads them by size, not by name.
    """
    ids = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = ids.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    at = ids.withColumn("__p", part).join(F.broadcast(starts), F.col("__p") == F.col("__part"))
    return at.select((F.col("__from") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(out), *df.columns)


def grouped_median(df: DataFrame, keys: list[str], value: str, buckets: int = 200) -> DataFrame:
    """(keys, n, median): exact medians of large groups.

    Approximate quantiles cut each group into buckets; bucket sizes tell which bucket holds the middle,
    and only that bucket's rows are ranked.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, value)
    cuts = d.groupBy(*keys).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts"))
    d = d.join(cuts, keys).withColumn("bucket", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col(value)))).drop("cuts")
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = d.groupBy(*keys, "bucket").agg(F.count("*").alias("size"))
    sizes = sizes.select(*keys, "bucket", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("below"), F.sum("size").over(whole).alias("n"), "size")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = sizes.where((F.col("below") <= hi) & (F.col("below") + F.col("size") > lo))
    at = F.col("below") + F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(value)) - 1
    picked = d.join(middle, [*keys, "bucket"]).withColumn("at", at).where((F.col("at") == lo) | (F.col("at") == hi))
    return picked.groupBy(*keys).agg(F.first("n").alias("n"), F.avg(value).alias("median"))
