"""Exchange rates implied by cross-currency payments."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import scans

BASE = "US Dollar"
MIN_AMOUNT = 100.0

# Plausible USD per unit of each currency.
PLAUSIBLE = {
    "Euro": (0.8, 1.4),
    "UK Pound": (1.0, 1.6),
    "Swiss Franc": (0.85, 1.3),
    "Yuan": (0.1, 0.2),
    "Shekel": (0.2, 0.4),
    "Rupee": (0.008, 0.02),
    "Ruble": (0.005, 0.03),
    "Yen": (0.005, 0.015),
    "Canadian Dollar": (0.6, 0.9),
    "Australian Dollar": (0.55, 0.85),
    "Mexican Peso": (0.03, 0.07),
    "Saudi Riyal": (0.2, 0.3),
    "Brazil Real": (0.12, 0.3),
    "Bitcoin": (5_000.0, 100_000.0),
}


def pair_medians(t: DataFrame, min_amount: float = MIN_AMOUNT) -> DataFrame:
    """(pay_ccy, recv_ccy, n, rate): the exact median of received over paid, of payments of at least min_amount."""
    d = t.where((F.col("pay_ccy") != F.col("recv_ccy")) & (F.col("amt_paid") >= min_amount))
    d = d.select("pay_ccy", "recv_ccy", F.try_divide("amt_received", "amt_paid").alias("r"))
    return scans.grouped_median(d, ["pay_ccy", "recv_ccy"], "r").withColumnRenamed("median", "rate")


def chain(pairs: DataFrame, base: str = BASE) -> DataFrame:
    """(currency, usd_per_unit, via, n_obs, hops), each currency reached from base over the fewest pairs.

    A level's candidates go by their parent's own order, then by sample size, then by name. The pairs
    are one row for each two currencies, so the search runs on the driver.
    """
    edges: dict[str, list[tuple[int, str, float]]] = {}
    for r in pairs.collect():
        edges.setdefault(r.pay_ccy, []).append((-r.n, r.recv_ccy, r.rate))
        edges.setdefault(r.recv_ccy, []).append((-r.n, r.pay_ccy, 1.0 / r.rate))
    known = {base: (1.0, base, 0, 0)}
    level = deque([base])
    while level:
        at = level.popleft()
        value, _, _, hops = known[at]
        for n, other, rate in sorted(edges.get(at, [])):
            if other not in known:
                known[other] = (value / rate, at, -n, hops + 1)
                level.append(other)
    rows = [(c, *v) for c, v in known.items()]
    return pairs.sparkSession.createDataFrame(rows, "currency string, usd_per_unit double, via string, n_obs long, hops int").orderBy(F.desc("usd_per_unit"))


def to_usd(t: DataFrame, rates: DataFrame, check: bool = True) -> DataFrame:
    """Adds amt_usd, the paid amount at the paying currency's rate; ValueError if a currency has none."""
    r = rates.select(F.col("currency").alias("__ccy"), F.col("usd_per_unit").alias("__rate"))
    d = t.drop("amt_usd").join(F.broadcast(r), F.col("pay_ccy") == F.col("__ccy"), "left")  # a row for each currency
    if check:
        missing = sorted(x[0] for x in d.where("__rate is null").select("pay_ccy").distinct().collect())
        if missing:
            raise ValueError(f"no USD rate for {missing}")
    return d.withColumn("amt_usd", F.col("amt_paid") * F.col("__rate")).drop("__ccy", "__rate")


def warnings(rates: DataFrame, pairs: DataFrame, tolerance: float = 0.05, least: int = 50) -> DataFrame:
    """(kind, subject, value, expected): missing or implausible rates, and pairs off the chained rate."""
    bounds = rates.sparkSession.createDataFrame([(c, lo, hi) for c, (lo, hi) in PLAUSIBLE.items()], "currency string, lo double, hi double")
    j = bounds.join(rates.select("currency", "usd_per_unit"), "currency", "left")
    missing = j.where("usd_per_unit is null").select(F.lit("missing").alias("kind"), F.col("currency").alias("subject"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("expected"))
    odd = j.where("usd_per_unit < lo or usd_per_unit > hi").select(F.lit("outside plausible range").alias("kind"), F.col("currency").alias("subject"), F.col("usd_per_unit").alias("value"), F.when(F.col("usd_per_unit") < F.col("lo"), F.col("lo")).otherwise(F.col("hi")).alias("expected"))
    a, b = (rates.select(F.col("currency").alias(f"{c}_ccy"), F.col("usd_per_unit").alias(f"{c}_usd")) for c in ("pay", "recv"))
    p = pairs.join(a, "pay_ccy").join(b, "recv_ccy").withColumn("chained", F.col("pay_usd") / F.col("recv_usd"))
    off = p.where((F.abs(F.col("rate") / F.col("chained") - 1) > tolerance) & (F.col("n") >= least))
    return missing.union(odd).union(off.select(F.lit("off the chain"), F.concat_ws("->", "pay_ccy", "recv_ccy"), "rate", "chained"))
