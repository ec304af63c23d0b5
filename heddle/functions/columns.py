"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def node_id(bank: Column, account: Column) -> Column:
    """Accounts are unique within a bank only; a null part gives null."""
    return F.concat(bank, F.lit("_"), account)


def bank_of(account: Column) -> Column:
    """The bank's part of an account's node id; all of an id without one."""
    return F.substring_index(account, "_", 1)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def weekday(ts: Column) -> Column:
    """0 on Sundays."""
    return F.dayofweek(ts) - 1


def flag(condition: Column) -> Column:
    return condition.cast("int")


def is_round(amount: Column, unit: float = 100.0) -> Column:
    return amount % unit == 0


def flows(t: DataFrame) -> DataFrame:
    """Transactions between two different accounts."""
    return t.where("src <> dst")


def legs(t: DataFrame, *columns: str) -> DataFrame:
    """Each transaction twice, as its sender's and as its receiver's: acc, other, role, and the columns. One scan."""
    sides = F.array(
        F.struct(F.col("src").alias("acc"), F.col("dst").alias("other"), F.lit("out").alias("role")),
        F.struct(F.col("dst").alias("acc"), F.col("src").alias("other"), F.lit("in").alias("role")),
    )
    return t.select(*columns, F.explode(sides).alias("side")).select("side.acc", "side.other", "side.role", *columns)


def usd_text(x: Column) -> Column:
    """A short text of an amount: $1.2M."""
    a = F.abs(x)

    def scaled(by: float, unit: str) -> Column:
        return F.format_string(f"$%.1f{unit}", x / by)

    return F.when(a >= 1e12, scaled(1e12, "T")).when(a >= 1e9, scaled(1e9, "B")).when(a >= 1e6, scaled(1e6, "M")).when(a >= 1e3, scaled(1e3, "K")).otherwise(F.format_string("$%.0f", x))


def risk_badge(risk: Column) -> Column:
    return F.when(risk >= 0.99, "HIGH").when(risk >= 0.90, "ELEVATED").otherwise("ROUTINE")


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, whole)
