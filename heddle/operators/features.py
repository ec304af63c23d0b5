"""Account features of whole behaviour, and transaction features of strictly earlier history."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle import schemas
from heddle.functions import scans
from heddle.functions.columns import DAY, flag, flows, is_round, legs, micros, weekday
from heddle.operators import detectors, graph
from heddle.session import stored

#: Heavy-tailed columns, taken as log(1 + x).
LOG_COLUMNS = (
    "n_in n_out deg_in deg_out usd_in_sum usd_in_mean usd_in_max usd_out_sum usd_out_mean usd_out_max"
    " span_hours max_txns_24h n_self_loops ratio_out_in median_dwell_hours n_counterparties pagerank_scaled"
).split()


def format_column(name: str) -> str:
    return "share_fmt_" + name.lower().replace(" ", "_")


def account_flows(t: DataFrame) -> DataFrame:
    """(acc, n_out, deg_out, usd_out_{sum,mean,max}, n_in, ...): 0 where an account has no flow that way. One pass over legs."""
    e = legs(flows(t), "amt_usd")
    cols: list[Column] = []
    for way in ("out", "in"):
        here = F.col("role") == way
        usd = F.when(here, F.col("amt_usd"))
        cols += [
            F.count_if(here).alias(f"n_{way}"), F.count_distinct(F.when(here, F.col("other"))).alias(f"deg_{way}"),
            *[F.coalesce(f(usd), F.lit(0.0)).alias(f"usd_{way}_{name}") for name, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))],
        ]
    return e.groupBy("acc").agg(*cols)


def account_mix(t: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """(acc, share_fmt_*, cross_ccy_share, round_share, span_hours) over an account's transactions both ways."""
    if formats is None:
        formats = sorted(r[0] for r in flows(t).select("payment_format").distinct().collect())  # a row for each format
    e = legs(flows(t), "timestamp", "payment_format", "pay_ccy", "recv_ccy", "amt_paid")
    us = micros(F.col("timestamp"))
    return e.groupBy("acc").agg(
        *[F.avg(flag(F.col("payment_format") == f)).alias(format_column(f)) for f in formats],
        F.avg(flag(F.col("pay_ccy") != F.col("recv_ccy"))).alias("cross_ccy_share"),
        F.avg(flag(is_round(F.col("amt_paid")))).alias("round_share"),
        ((F.max(us) - F.min(us)) / 3.6e9).alias("span_hours"),
    )


def bursts(t: DataFrame) -> DataFrame:
    """(acc, max_txns_24h): the most transactions of an account in any closed 24 hours."""
    us = micros(F.col("timestamp"))
    marks = legs(flows(t), "timestamp").select("acc", F.explode(F.array(
        F.struct(us.alias("at"), F.lit(1).alias("c"), F.lit(True).alias("asks")),
        F.struct((us + DAY + 1).alias("at"), F.lit(-1).alias("c"), F.lit(False).alias("asks")),
    )).alias("m")).select("acc", "m.at", "m.c", "m.asks")
    return scans.running_totals(marks, "acc", "at", ["c"], F.col("asks")).groupBy("acc").agg(F.max("c").alias("max_txns_24h"))


def self_loops(t: DataFrame) -> DataFrame:
    return t.where("src = dst").groupBy(F.col("src").alias("acc")).agg(F.count("*").alias("n_self_loops"))


def account_features(t: DataFrame) -> DataFrame:
    """A row for each account with flow: counts, sums, mix, bursts, conduit metrics, PageRank and clustering, no nulls."""
    f = stored(account_flows(t).join(account_mix(t), "acc").join(bursts(t), "acc").join(self_loops(t), "acc", "left").fillna(0, ["n_self_loops"]), "flows")
    conduit = detectors.pass_through_metrics(t).select("acc", "ratio_out_in", "median_dwell_hours", "n_counterparties")
    e = flows(t).select("src", "dst")
    f = f.join(conduit, "acc", "left")
    f = f.join(graph.pagerank(e).select(F.col("node").alias("acc"), "pagerank_scaled"), "acc", "left")
    f = f.join(graph.clustering(e).select(F.col("node").alias("acc"), "clustering"), "acc", "left")
    longest = f.agg(F.max("span_hours")).first()[0] or 0.0
    return f.withColumns({
        "has_both_directions": flag(F.col("ratio_out_in").isNotNull()),
        "ratio_out_in": F.coalesce("ratio_out_in", F.lit(0.0)),
        "median_dwell_hours": F.coalesce("median_dwell_hours", F.lit(float(longest))),
        "n_counterparties": F.coalesce("n_counterparties", F.greatest("deg_in", "deg_out")),
    })


def detector_counts(features: DataFrame, findings: DataFrame, key: str = "acc") -> DataFrame:
    """features with hits_<detector>: how many findings of each name the account. Earlier hits_ columns are replaced."""
    f = features.drop(*[c for c in features.columns if c.startswith("hits_")])
    named = findings.select("detector", F.explode("account_ids").alias(key)).where(F.col(key).isNotNull())
    hits = named.groupBy(key).agg(*[F.count_if(F.col("detector") == d).cast("int").alias(f"hits_{d}") for d in schemas.DETECTORS])
    names = [f"hits_{d}" for d in schemas.DETECTORS]
    return f.join(hits, key, "left").fillna(0, names)


def standardised(features: DataFrame, keys: list[str]) -> DataFrame:
    """Columns but the keys as z-scores (population deviation; constant columns give 0) after log and clipping; nulls as 0."""
    names = [c for c in features.columns if c not in keys]
    x = {c: F.col(c).cast("double") for c in names}
    if "ratio_out_in" in x:
        x["ratio_out_in"] = F.least(x["ratio_out_in"], F.lit(100.0))
    for c in names:
        if c in LOG_COLUMNS or c.startswith("hits_"):
            x[c] = F.log1p(F.greatest(x[c], F.lit(0.0)))
    d = features.select(*keys, *[F.coalesce(x[c], F.lit(0.0)).alias(c) for c in names])
    stats = d.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()  # one row
    z = []
    for c in names:
        mean, dev = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0
        z.append(((F.col(c) - mean) / (dev if dev > 1e-12 else 1.0)).alias(c))
    return d.select(*keys, *z)


def history(t: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """(txn_id, role, {out,in}_{cnt,usd}_{w}d, own_xc_{w}d, own_dcp_{w}d): the account's history in [ts - w, ts).

    A row for each side of each transaction: role out is the sender's history, in the receiver's; own is the
    side's own direction. An event is +1 just after its time and -1 just after it leaves a window; for distinct
    counterparties it also ends when the counterparty comes again. One running sum gives all windows.
    """
    e = legs(t, "txn_id", "timestamp", "amt_usd", "pay_ccy", "recv_ccy")
    e = e.withColumns({"us": micros(F.col("timestamp")), "xc": flag(F.col("pay_ccy") != F.col("recv_ccy"))}).drop("timestamp", "pay_ccy", "recv_ccy")
    again = F.lead("us").over(Window.partitionBy("acc", "role", "other").orderBy("us", "txn_id"))
    e = e.withColumn("again", F.coalesce(again, F.lit(2**61)))
    out = F.col("role") == "out"
    values: list[str] = []

    def mark(at: Column, sums: dict[int, int], distinct: dict[int, int], asks: bool) -> Column:
        """sums and distinct: what the mark adds to each window's counts."""
        fields = []
        for w in days:
            s, d = sums.get(w, 0), distinct.get(w, 0)
            for way in ("out", "in"):
                here = out if way == "out" else ~out
                fields += [
                    F.when(here, F.lit(s)).otherwise(0).alias(f"{way}_cnt_{w}d"),
                    F.when(here, F.col("amt_usd") * s).otherwise(0.0).alias(f"{way}_usd_{w}d"),
                    F.when(here, F.col("xc") * s).otherwise(0).alias(f"{way}_xc_{w}d"),
                    F.when(here, F.lit(d)).otherwise(0).alias(f"{way}_dcp_{w}d"),
                ]
        return F.struct(at.alias("at"), F.lit(asks).alias("asks"), *fields)

    for w in days:
        values += [f"{way}_{m}_{w}d" for way in ("out", "in") for m in ("cnt", "usd", "xc", "dcp")]
    us = F.col("us")
    every = dict.fromkeys(days, 1)
    marks = [mark(us, {}, {}, True), mark(us + 1, every, every, False)]
    for w in days:
        marks.append(mark(us + w * DAY + 1, {w: -1}, {}, False))
        marks.append(mark(F.least(us + w * DAY, F.col("again")) + 1, {}, {w: -1}, False))
    m = e.select("acc", "txn_id", "role", F.explode(F.array(*marks)).alias("m")).select("acc", "txn_id", "role", "m.*")
    r = scans.running_totals(m, "acc", "at", values, F.col("asks"))
    own = [F.when(out, F.col(f"out_{x}_{w}d")).otherwise(F.col(f"in_{x}_{w}d")).alias(f"own_{x}_{w}d") for w in days for x in ("xc", "dcp")]
    return r.select("txn_id", "role", *[f"{way}_{x}_{w}d" for w in days for way in ("out", "in") for x in ("cnt", "usd")], *own)


def transaction_features(t: DataFrame, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """A row for each transaction, self-loops too: its own features, and both parties' strictly earlier history."""
    h = history(t, days)
    sides = []
    for role, party, way, back in (("out", "snd", "out", "in"), ("in", "rcv", "in", "out")):
        cols = []
        for w in days:
            cols += [F.col(f"{x}_{m}_{w}d").alias(f"{party}_{x}_{m}_{w}d") for x in (way, back) for m in ("cnt", "usd")]
            n = F.col(f"{way}_cnt_{w}d")
            cols += [F.coalesce(F.try_divide(F.col(f"own_xc_{w}d"), n), F.lit(0.0)).alias(f"{party}_{way}_xc_share_{w}d"), F.col(f"own_dcp_{w}d").alias(f"{party}_{way}_dcp_{w}d")]
        sides.append(h.where(F.col("role") == role).select("txn_id", *cols))
    first = F.min("timestamp").over(Window.partitionBy("src", "dst"))
    own = t.select(
        "txn_id", "timestamp", "src", "dst", "is_laundering", F.log1p("amt_usd").alias("log_amt_usd"), "payment_format", "pay_ccy", "recv_ccy",
        flag(F.col("pay_ccy") != F.col("recv_ccy")).alias("is_cross_ccy"), F.hour("timestamp").alias("hour"), weekday(F.col("timestamp")).alias("weekday"),
        flag(is_round(F.col("amt_paid"))).alias("is_round_amt"), flag(F.col("src") == F.col("dst")).alias("is_self_loop"), flag(first < F.col("timestamp")).alias("pair_seen_before"),
    )
    return own.join(sides[0], "txn_id").join(sides[1], "txn_id")


def feature_names(df: DataFrame) -> list[str]:
    """Model inputs: all columns but ids, parties, time and label."""
    return [c for c in df.columns if not re.fullmatch("txn_id|timestamp|src|dst|is_laundering", c)]
