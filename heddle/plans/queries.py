"""Registered queries over the test tables' transaction network, each with its SQL where SQL can say it.

Doubles are rounded alike on both sides; arrays are joined into strings.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import session
from heddle.config import Detectors
from heddle.functions import columns as C
from heddle.functions import scans
from heddle.operators import anomaly, attribution, clusters, detectors, evaluation, features, fx, graph, profile, scoring, supervised, views
from heddle.plans.adapter import CURRENCIES, T_SQL, USD, transactions
from heddle.plans.registry import ORACLE, query
from heddle.sources import transactions as source

FAN = Detectors(fan_percentile=90.0)
PATHS = Detectors(scatter_gather_min_paths=8)


def _r(name: str, digits: int = 7) -> Column:
    return F.round(F.col(name), digits).alias(name)


def _joined(name: str) -> Column:
    return F.concat_ws(",", F.col(name)).alias(name)


def sql(rest: str) -> str:
    return T_SQL + rest


# ---------------------------------------------------------------- ingest and profile
@query("txn_adapter", sql("SELECT txn_id, timestamp, src, dst, round(amt_paid, 7) AS amt_paid, payment_format, pay_ccy, recv_ccy, is_laundering, round(amt_usd, 7) AS amt_usd FROM t"))
def txn_adapter(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select("txn_id", "timestamp", "src", "dst", _r("amt_paid"), "payment_format", "pay_ccy", "recv_ccy", "is_laundering", _r("amt_usd"))


@query("ingest_summary", sql("SELECT count(*) AS n, count(DISTINCT src) AS n_src, CAST(sum(is_laundering) AS BIGINT) AS n_illicit, CAST(sum((src = dst)::INT) AS BIGINT) AS n_self_loops, min(timestamp) AS t0, max(timestamp) AS t1 FROM t"))
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return source.summary(transactions(spark, d))


@query("dataset_scale", sql("""SELECT (SELECT count(DISTINCT acc) FROM (SELECT src AS acc FROM t UNION SELECT dst FROM t)) AS n_accounts, count(*) AS n_txns, min(timestamp) AS first_ts,
    max(timestamp) AS last_ts, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 8.64e10, 6) AS days FROM t"""))
def dataset_scale(spark: SparkSession, d: str) -> DataFrame:
    return profile.scale(transactions(spark, d)).select("n_accounts", "n_txns", "first_ts", "last_ts", _r("days", 6))


@query("class_balance", sql("SELECT is_laundering, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 8) AS share FROM t GROUP BY 1"))
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_balance(transactions(spark, d)).select("is_laundering", "n", _r("share", 8))


def _rate(name: str, by_sql: str, by: Callable[[], Column], column: str) -> None:
    @query(name, sql(f"SELECT {by_sql} AS {column}, count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS illicit, round(avg(is_laundering), 8) AS rate FROM t GROUP BY 1"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return profile.rate_by(transactions(spark, d), by(), column).select(column, "n", "illicit", _r("rate", 8))


_rate("rate_by_format", "payment_format", lambda: F.col("payment_format"), "payment_format")
_rate("rate_by_currency", "pay_ccy", lambda: F.col("pay_ccy"), "pay_ccy")
_rate("rate_by_day", "date_trunc('day', timestamp)", lambda: F.date_trunc("day", F.col("timestamp")), "day")
_rate("rate_by_hour", "hour(timestamp)", lambda: F.hour("timestamp"), "hour")
_rate("rate_by_weekday", "dayofweek(timestamp)", lambda: C.weekday(F.col("timestamp")), "weekday")


@query("cross_currency", sql("SELECT is_laundering, count(*) AS n, count(*) FILTER (WHERE pay_ccy <> recv_ccy) AS n_cross, round(avg((pay_ccy <> recv_ccy)::INT), 8) AS share FROM t GROUP BY 1"))
def cross_currency(spark: SparkSession, d: str) -> DataFrame:
    return profile.cross_currency(transactions(spark, d)).select("is_laundering", "n", "n_cross", _r("share", 8))


@query("self_loop_counts", sql("SELECT is_laundering, count(*) FILTER (WHERE src = dst) AS n_self_loops FROM t GROUP BY 1"))
def self_loop_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.self_loop_counts(transactions(spark, d))


@query("round_amounts", sql("SELECT is_laundering, round(avg((amt_paid % 100 = 0)::INT), 8) AS round_100, round(avg((amt_paid % 1 = 0)::INT), 8) AS whole FROM t GROUP BY 1"))
def round_amounts(spark: SparkSession, d: str) -> DataFrame:
    return profile.round_amounts(transactions(spark, d)).select("is_laundering", _r("round_100", 8), _r("whole", 8))


@query("amount_histogram", sql("SELECT is_laundering, CAST(floor(log10(amt_usd) * 10) AS INT) AS bin, count(*) AS n FROM t WHERE amt_usd > 0 GROUP BY 1, 2"))
def amount_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.log_histogram(transactions(spark, d))


@query("amount_moments", sql("SELECT is_laundering, count(amt_usd) AS n, round(avg(amt_usd), 7) AS mean, round(stddev(amt_usd), 7) AS std, round(min(amt_usd), 7) AS min, round(max(amt_usd), 7) AS max FROM t GROUP BY 1"))
def amount_moments(spark: SparkSession, d: str) -> DataFrame:
    return profile.amount_quantiles(transactions(spark, d)).select("is_laundering", "n", _r("mean"), _r("std"), _r("min"), _r("max"))


# ---------------------------------------------------------------- currencies
@query("fx_pair_medians", sql("SELECT pay_ccy, recv_ccy, count(*) AS n, round(median(amt_received / amt_paid), 8) AS rate FROM t WHERE pay_ccy <> recv_ccy AND amt_paid >= 10 GROUP BY 1, 2"))
def fx_pair_medians(spark: SparkSession, d: str) -> DataFrame:
    return fx.pair_medians(transactions(spark, d), 10.0).select("pay_ccy", "recv_ccy", "n", _r("rate", 8))


_CHAIN = """, p AS (SELECT pay_ccy, recv_ccy, count(*) AS n, median(amt_received / amt_paid) AS rate FROM t WHERE pay_ccy <> recv_ccy AND amt_paid >= 10 GROUP BY 1, 2),
    ed AS (SELECT pay_ccy AS a, recv_ccy AS b, n, rate FROM p UNION ALL SELECT recv_ccy, pay_ccy, n, 1 / rate FROM p),
    h1 AS (SELECT b, 1 / rate AS usd, n, row_number() OVER (ORDER BY n DESC, b) AS q FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, rate) AS r FROM ed WHERE a = 'US Dollar') WHERE r = 1),
    h2 AS (SELECT ed.b, h1.usd / ed.rate AS usd, ed.a AS via, ed.n, row_number() OVER (PARTITION BY ed.b ORDER BY h1.q, ed.n DESC, ed.rate) AS r FROM ed JOIN h1 ON ed.a = h1.b WHERE ed.b <> 'US Dollar' AND ed.b NOT IN (SELECT b FROM h1))
    SELECT 'US Dollar' AS currency, 1.0::DOUBLE AS usd_per_unit, 'US Dollar' AS via, 0::BIGINT AS n_obs, 0::INT AS hops UNION ALL SELECT b, round(usd, 8), 'US Dollar', n, 1::INT FROM h1 UNION ALL SELECT b, round(usd, 8), via, n, 2::INT FROM h2 WHERE r = 1"""


@query("fx_chain", sql(_CHAIN))
def fx_chain(spark: SparkSession, d: str) -> DataFrame:
    return fx.chain(fx.pair_medians(transactions(spark, d), 10.0)).select("currency", _r("usd_per_unit", 8), "via", "n_obs", "hops")


_RATES = "rates AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CURRENCIES) + "]) AS currency, unnest([" + ", ".join(f"{u}::DOUBLE" for u in USD) + "]) AS u)"


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(CURRENCIES, USD, strict=True)), "currency string, usd_per_unit double")


@query("amt_usd", sql(f", {_RATES} SELECT txn_id, round(amt_paid * u, 6) AS amt_usd FROM t JOIN rates ON currency = pay_ccy"))
def amt_usd(spark: SparkSession, d: str) -> DataFrame:
    return fx.to_usd(transactions(spark, d), _rates(spark)).select("txn_id", _r("amt_usd", 6))


@query("rate_checks", sql(f""", {_RATES.replace("1.17::DOUBLE", "1.3::DOUBLE")}, p AS (SELECT pay_ccy, recv_ccy, count(*) AS n, median(amt_received / amt_paid) AS rate FROM t WHERE pay_ccy <> recv_ccy AND amt_paid >= 10 GROUP BY 1, 2)
    SELECT 'off the chain' AS kind, pay_ccy || '->' || recv_ccy AS subject, round(rate, 8) AS value, round(a.u / b.u, 8) AS expected FROM p JOIN rates a ON a.currency = pay_ccy
    JOIN rates b ON b.currency = recv_ccy WHERE abs(rate / (a.u / b.u) - 1) > 0.05 AND n >= 50"""))
def rate_checks(spark: SparkSession, d: str) -> DataFrame:
    # the Euro's rate is off, for the checks to find
    rates = _rates(spark).withColumn("usd_per_unit", F.when(F.col("currency") == "Euro", 1.3).otherwise(F.col("usd_per_unit")))
    w = fx.warnings(rates, fx.pair_medians(transactions(spark, d), 10.0), 0.05)
    return w.where("kind = 'off the chain'").select("kind", "subject", _r("value", 8), _r("expected", 8))


# ---------------------------------------------------------------- accounts
@query("account_flows", sql("""SELECT acc, count(*) FILTER (WHERE role = 'out') AS n_out, count(DISTINCT other) FILTER (WHERE role = 'out') AS deg_out,
    round(coalesce(sum(amt_usd) FILTER (WHERE role = 'out'), 0), 7) AS usd_out_sum, round(coalesce(max(amt_usd) FILTER (WHERE role = 'out'), 0), 7) AS usd_out_max,
    count(*) FILTER (WHERE role = 'in') AS n_in, count(DISTINCT other) FILTER (WHERE role = 'in') AS deg_in,
    round(coalesce(sum(amt_usd) FILTER (WHERE role = 'in'), 0), 7) AS usd_in_sum, round(coalesce(avg(amt_usd) FILTER (WHERE role = 'in'), 0), 12) AS usd_in_mean FROM legs GROUP BY acc"""))
def account_flows(spark: SparkSession, d: str) -> DataFrame:
    f = features.account_flows(transactions(spark, d))
    return f.select("acc", "n_out", "deg_out", _r("usd_out_sum"), _r("usd_out_max"), "n_in", "deg_in", _r("usd_in_sum"), _r("usd_in_mean", 12))


@query("account_mix", sql("""SELECT acc, round(avg((payment_format = 'purchase')::INT), 8) AS share_fmt_purchase, round(avg((pay_ccy <> recv_ccy)::INT), 8) AS cross_ccy_share,
    round(avg((amt_paid % 100 = 0)::INT), 8) AS round_share, round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9, 6) AS span_hours FROM legs GROUP BY acc"""))
def account_mix(spark: SparkSession, d: str) -> DataFrame:
    m = features.account_mix(transactions(spark, d))
    return m.select("acc", _r("share_fmt_purchase", 8), _r("cross_ccy_share", 8), _r("round_share", 8), _r("span_hours", 6))


@query("burst_24h", sql("SELECT acc, max(c) AS max_txns_24h FROM (SELECT acc, count(*) OVER (PARTITION BY acc ORDER BY timestamp RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS c FROM legs) GROUP BY acc"))
def burst_24h(spark: SparkSession, d: str) -> DataFrame:
    return features.bursts(transactions(spark, d))


@query("self_loops", sql("SELECT src AS acc, count(*) AS n_self_loops FROM t WHERE src = dst GROUP BY 1"))
def self_loops(spark: SparkSession, d: str) -> DataFrame:
    return features.self_loops(transactions(spark, d))


_METRICS = """, i AS (SELECT dst AS acc, count(*) AS n_in, sum(amt_usd) AS usd_in FROM f GROUP BY 1), o AS (SELECT src AS acc, count(*) AS n_out, sum(amt_usd) AS usd_out FROM f GROUP BY 1),
    dw AS (SELECT a.acc, median(epoch_us(b.ts) - epoch_us(a.ts)) / 3.6e9 AS dwell FROM (SELECT dst AS acc, timestamp AS ts FROM f) a ASOF JOIN (SELECT src AS acc, timestamp AS ts FROM f) b ON a.acc = b.acc AND a.ts <= b.ts GROUP BY 1),
    g AS (SELECT acc, count(DISTINCT other) AS n_counterparties, avg((pay_ccy <> recv_ccy)::INT) AS xc FROM legs GROUP BY 1),
    m AS (SELECT i.acc, n_in, n_out, usd_in, usd_out, usd_out / usd_in AS ratio, dwell, n_counterparties, xc FROM i JOIN o USING (acc) LEFT JOIN dw USING (acc) JOIN g USING (acc))"""


@query("pass_through_metrics", sql(_METRICS + " SELECT acc, n_in, n_out, round(usd_in, 7) AS usd_in, round(usd_out, 7) AS usd_out, round(ratio, 6) AS ratio_out_in, round(dwell, 6) AS median_dwell_hours, n_counterparties, round(xc, 8) AS cross_ccy_share FROM m"))
def pass_through_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = detectors.pass_through_metrics(transactions(spark, d))
    return m.select("acc", "n_in", "n_out", _r("usd_in"), _r("usd_out"), _r("ratio_out_in", 6), _r("median_dwell_hours", 6), "n_counterparties", _r("cross_ccy_share", 8))


@query("zscores", sql("""SELECT acc, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS n_out, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS usd_in_sum FROM
    (SELECT acc, ln(1 + count(*) FILTER (WHERE role = 'out')) AS a, ln(1 + greatest(coalesce(sum(amt_usd) FILTER (WHERE role = 'in'), 0), 0)) AS b FROM legs GROUP BY acc)"""))
def zscores(spark: SparkSession, d: str) -> DataFrame:
    z = features.standardised(features.account_flows(transactions(spark, d)).select("acc", "n_out", "usd_in_sum"), ["acc"])
    return z.select("acc", _r("n_out", 6), _r("usd_in_sum", 6))


# ---------------------------------------------------------------- detectors
def _fan_sql(direction: str) -> str:
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    return sql(f""", deg AS (SELECT {key} AS k, count(DISTINCT {other}) AS nd FROM f GROUP BY 1),
    win AS (SELECT {key} AS k, timestamp AS ts, w, c FROM (SELECT {key}, timestamp, 1 AS w, count(DISTINCT {other}) OVER (PARTITION BY {key} ORDER BY timestamp RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS c FROM f
        UNION ALL SELECT {key}, timestamp, 7, count(DISTINCT {other}) OVER (PARTITION BY {key} ORDER BY timestamp RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) FROM f) WHERE {key} IN (SELECT k FROM deg WHERE nd >= 3)),
    mx AS (SELECT k, w, max(c) AS peak FROM win GROUP BY 1, 2),
    peaks AS (SELECT mx.k, mx.w, peak, min(ts) AS peak_ts FROM mx JOIN win ON win.k = mx.k AND win.w = mx.w AND win.c = mx.peak GROUP BY 1, 2, 3),
    pop AS (SELECT w, peak FROM peaks UNION ALL SELECT w, nd FROM deg, (SELECT unnest([1, 7]) AS w) WHERE nd < 3),
    thr AS (SELECT w, greatest(quantile_cont(peak, 0.9), 2) AS thr FROM pop GROUP BY 1),
    best AS (SELECT * FROM (SELECT k, w, peak, peak_ts, thr, 1 - thr / peak AS score, row_number() OVER (PARTITION BY k ORDER BY 1 - thr / peak DESC, w) AS r FROM peaks JOIN thr USING (w) WHERE peak > thr) WHERE r = 1)
    SELECT k AS account, w AS days, peak, round(score, 6) AS score, count(*) AS n_txns, count(DISTINCT {other}) AS n_others, min(timestamp) AS start_ts, max(timestamp) AS end_ts, round(sum(amt_usd), 7) AS total_usd
    FROM best JOIN f ON {key} = k AND timestamp <= peak_ts AND timestamp >= peak_ts - to_days(w) GROUP BY 1, 2, 3, 4""")


def _fan_peaks_sql(direction: str) -> str:
    return _fan_sql(direction).split("    pop AS")[0].rstrip().rstrip(",") + " SELECT k, w, peak, epoch_us(peak_ts) AS peak_us FROM peaks"


def _fan(direction: str) -> None:
    @query(f"fan_{direction}_peaks", _fan_peaks_sql(direction))
    def peaks(spark: SparkSession, d: str) -> DataFrame:
        return detectors.fan_peaks(transactions(spark, d), FAN, direction)

    @query(f"fan_{direction}", _fan_sql(direction))
    def found(spark: SparkSession, d: str) -> DataFrame:
        f = detectors.fan(transactions(spark, d), FAN, direction)
        days = F.regexp_extract("detail", r"in (\d+)d", 1).cast("int")
        peak = F.regexp_extract("detail", r"^(\d+)", 1).cast("long")
        return f.select(F.col("account_ids")[0].alias("account"), days.alias("days"), peak.alias("peak"), _r("score", 6), F.size("txn_ids").cast("long").alias("n_txns"), (F.size("account_ids") - 1).cast("long").alias("n_others"), "start_ts", "end_ts", _r("total_usd"))


_fan("out")
_fan("in")

_OK = ", ok AS (SELECT i.acc FROM (SELECT dst AS acc, count(*) AS c FROM f GROUP BY 1) i JOIN (SELECT src AS acc, count(*) AS c FROM f GROUP BY 1) o USING (acc) WHERE i.c <= {cap} AND o.c <= {cap})"
_PATHS = _OK.format(cap=2000) + """, p AS (SELECT a.src AS s, a.dst AS i, b.dst AS d, a.txn_id AS t1, b.txn_id AS t2, a.timestamp AS ts1, b.timestamp AS ts2, a.amt_usd AS u1 FROM f a JOIN f b ON a.dst = b.src
    WHERE a.dst IN (SELECT acc FROM ok) AND b.timestamp > a.timestamp AND b.timestamp <= a.timestamp + INTERVAL 7 DAY AND a.src <> b.dst)"""


@query("two_hop_paths", sql(_PATHS + " SELECT i, count(*) AS n, count(DISTINCT s) AS n_s, count(DISTINCT d) AS n_d, round(sum(u1), 7) AS usd FROM p GROUP BY 1"))
def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    return detectors.two_hop_paths(transactions(spark, d)).groupBy("i").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_s"), F.count_distinct("d").alias("n_d"), F.round(F.sum("u1"), 7).alias("usd"))


@query("hubs_skipped", sql(_OK.format(cap=70) + " SELECT acc FROM (SELECT dst AS acc FROM f INTERSECT SELECT src FROM f) WHERE acc NOT IN (SELECT acc FROM ok)"))
def hubs_skipped(spark: SparkSession, d: str) -> DataFrame:
    return detectors.intermediaries(transactions(spark, d), Detectors(max_intermediary_txns=70)).where("not ok").select("acc")


@query("scatter_gather", sql(_PATHS + """, x AS (SELECT s, d, list_sort(list(DISTINCT i)) AS ints, list_sort(list(DISTINCT t1)) || list_sort(list(DISTINCT t2)) AS ids, min(ts1) AS start_ts, max(ts2) AS end_ts, sum(u1) AS total FROM p GROUP BY 1, 2 HAVING count(DISTINCT i) >= 8)
    SELECT s || ',' || array_to_string(ints, ',') || ',' || d AS account_ids, array_to_string(ids[1:500], ',') AS txn_ids, start_ts, end_ts, round(total, 7) AS total_usd, round(least(1.0, len(ints) / 16.0), 6) AS score FROM x"""))
def scatter_gather(spark: SparkSession, d: str) -> DataFrame:
    return detectors.scatter_gather(transactions(spark, d), PATHS).select(_joined("account_ids"), _joined("txn_ids"), "start_ts", "end_ts", _r("total_usd"), _r("score", 6))


@query("gather_scatter", sql(_PATHS + """, x AS (SELECT i, list_sort(list(DISTINCT s)) AS ss, list_sort(list(DISTINCT d)) AS ds, list_sort(list(DISTINCT t1)) || list_sort(list(DISTINCT t2)) AS ids, min(ts1) AS start_ts, max(ts2) AS end_ts, sum(u1) AS total FROM p GROUP BY 1 HAVING count(DISTINCT s) >= 8 AND count(DISTINCT d) >= 8)
    SELECT i || ',' || array_to_string(ss[1:500], ',') || ',' || array_to_string(ds[1:500], ',') AS account_ids, array_to_string(ids[1:500], ',') AS txn_ids, start_ts, end_ts, round(total, 7) AS total_usd, round(least(1.0, least(len(ss), len(ds)) / 16.0), 6) AS score FROM x"""))
def gather_scatter(spark: SparkSession, d: str) -> DataFrame:
    return detectors.gather_scatter(transactions(spark, d), PATHS).select(_joined("account_ids"), _joined("txn_ids"), "start_ts", "end_ts", _r("total_usd"), _r("score", 6))


@query("pass_through", sql(_METRICS + """, x AS (SELECT * FROM m WHERE n_in >= 2 AND n_out >= 2 AND usd_in >= 1000 AND abs(ratio - 1) <= 0.1 AND dwell <= 24)
    SELECT x.acc AS account, round(usd_in, 7) AS total_usd, round(0.5 * (1 - least(abs(ratio - 1) / 0.1, 1)) + 0.5 * (1 - least(dwell / 24, 1)), 6) AS score, min(timestamp) AS start_ts, max(timestamp) AS end_ts,
    array_to_string((list(txn_id ORDER BY amt_usd DESC, txn_id))[1:500], ',') AS txn_ids FROM x JOIN legs USING (acc) GROUP BY 1, 2, 3"""))
def pass_through(spark: SparkSession, d: str) -> DataFrame:
    f = detectors.pass_through(transactions(spark, d))
    return f.select(F.col("account_ids")[0].alias("account"), _r("total_usd"), _r("score", 6), "start_ts", "end_ts", _joined("txn_ids"))


def _cycle_sql(hops: int) -> str:
    parts = []
    for n in range(2, hops + 1):
        names = [f"e{i}" for i in range(n)]
        joins = " ".join(f"JOIN f {b} ON {a}.dst = {b}.src AND {b}.timestamp > {a}.timestamp AND epoch({b}.timestamp) <= epoch(e0.timestamp) + 1209600 AND {b}.amt_usd BETWEEN e0.amt_usd * 0.8 AND e0.amt_usd * 1.2" for a, b in zip(names, names[1:]))
        apart = " AND ".join(f"{a}.src <> {b}.src" for i, a in enumerate(names) for b in names[i + 1 :])
        dev = "greatest(" + ", ".join(f"abs({a}.amt_usd / e0.amt_usd - 1)" for a in names) + ")"
        accounts, ids = (" || ',' || ".join(f"{a}.{c}" for a in names) for c in ("src", "txn_id"))
        parts.append(f"SELECT {accounts} AS account_ids, {ids} AS txn_ids, e0.timestamp AS start_ts, {names[-1]}.timestamp AS end_ts, round({' + '.join(f'{a}.amt_usd' for a in names)}, 7) AS total_usd, round(0.5 + 0.5 * (1 - least({dev} / 0.2, 1)), 6) AS score FROM f e0 {joins} WHERE {names[-1]}.dst = e0.src AND {apart}")
    return sql(" UNION ALL ".join(parts))


def _cycles(hops: int) -> None:
    @query(f"cycles_{hops}", _cycle_sql(hops))
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = detectors.temporal_cycles(transactions(spark, d), Detectors(cycle_length_bound=hops))
        return f.select(_joined("account_ids"), _joined("txn_ids"), "start_ts", "end_ts", _r("total_usd"), _r("score", 6))


_cycles(3)
_cycles(4)
_cycles(6)


# ---------------------------------------------------------------- all detectors, and their findings against listed attempts
_ALL = Detectors(fan_percentile=90.0, scatter_gather_min_paths=8, cycle_length_bound=4)


def _sub(text: str) -> str:
    """A query's SQL without the shared tables before it, as a subquery."""
    return text[len(T_SQL) :]


def _all_sql() -> str:
    """f_<detector> (score, usd, ids) of each detector, as common table expressions."""
    out = T_SQL
    for name, text in (("temporal_cycle", _cycle_sql(4)), ("fan_out", _fan_sql("out")), ("fan_in", _fan_sql("in")), ("scatter_gather", ORACLE["scatter_gather"]), ("gather_scatter", ORACLE["gather_scatter"]), ("pass_through", ORACLE["pass_through"])):
        out += f", f_{name} AS (WITH one AS (SELECT 1) {_sub(text)})" if _sub(text).lstrip().startswith(",") else f", f_{name} AS ({_sub(text)})"
    return out


@query("detector_findings", _all_sql() + " " + " UNION ALL ".join(f"SELECT '{n}' AS detector, count(*) AS n, round(avg(score), 6) AS score, round(sum(total_usd), 4) AS usd FROM f_{n} HAVING count(*) > 0" for n in ("temporal_cycle", "fan_out", "fan_in", "scatter_gather", "gather_scatter", "pass_through")))
def detector_findings(spark: SparkSession, d: str) -> DataFrame:
    found = detectors.run_all(transactions(spark, d), _ALL)
    return found.groupBy("detector").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.sum("total_usd"), 4).alias("usd"))


# ---------------------------------------------------------------- transaction features
def _history_sql(w: int) -> str:
    both = []
    for party, key, other, way, back in (("snd", "src", "dst", "out", "in"), ("rcv", "dst", "src", "in", "out")):
        back_key = "dst" if key == "src" else "src"
        own = f"SELECT b.txn_id, count(h.txn_id) AS {party}_{way}_cnt_{w}d, round(coalesce(sum(h.amt_usd), 0), 7) AS {party}_{way}_usd_{w}d, round(coalesce(avg((h.pay_ccy <> h.recv_ccy)::INT), 0), 6) AS {party}_{way}_xc_share_{w}d, count(DISTINCT h.{other}) AS {party}_{way}_dcp_{w}d FROM t b LEFT JOIN t h ON h.{key} = b.{key} AND h.timestamp < b.timestamp AND h.timestamp >= b.timestamp - INTERVAL {w} DAY GROUP BY 1"
        other_way = f"SELECT b.txn_id, count(h.txn_id) AS {party}_{back}_cnt_{w}d, round(coalesce(sum(h.amt_usd), 0), 7) AS {party}_{back}_usd_{w}d FROM t b LEFT JOIN t h ON h.{back_key} = b.{key} AND h.timestamp < b.timestamp AND h.timestamp >= b.timestamp - INTERVAL {w} DAY GROUP BY 1"
        both += [f"({own})", f"({other_way})"]
    return sql(f"SELECT * FROM {both[0]} a JOIN {both[1]} b USING (txn_id) JOIN {both[2]} c USING (txn_id) JOIN {both[3]} e USING (txn_id)")


def _history(w: int) -> None:
    @query(f"txn_features_{w}d", _history_sql(w))
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = features.transaction_features(transactions(spark, d), (w,))
        cols = []
        for party, way, back in (("snd", "out", "in"), ("rcv", "in", "out")):
            cols += [F.col(f"{party}_{x}_cnt_{w}d").cast("long").alias(f"{party}_{x}_cnt_{w}d") for x in (way, back)] + [_r(f"{party}_{x}_usd_{w}d") for x in (way, back)]
            cols += [_r(f"{party}_{way}_xc_share_{w}d", 6), F.col(f"{party}_{way}_dcp_{w}d").cast("long").alias(f"{party}_{way}_dcp_{w}d")]
        # rounding of sums of +x and -x can leave -0.0
        return f.select("txn_id", *cols).replace(-0.0, 0.0)


for _w in (1, 7, 30):
    _history(_w)


@query("txn_own_features", sql("""SELECT txn_id, round(ln(1 + amt_usd), 6) AS log_amt_usd, (pay_ccy <> recv_ccy)::INT AS is_cross_ccy, hour(timestamp) AS hour, dayofweek(timestamp) AS weekday, (amt_paid % 100 = 0)::INT AS is_round_amt,
    (src = dst)::INT AS is_self_loop, (min(timestamp) OVER (PARTITION BY src, dst) < timestamp)::INT AS pair_seen_before FROM t WHERE amt_usd > -1"""))
def txn_own_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.transaction_features(transactions(spark, d).where("amt_usd > -1"), (1,))
    return f.select("txn_id", _r("log_amt_usd", 6), "is_cross_ccy", F.col("hour").cast("long").alias("hour"), F.col("weekday").cast("long").alias("weekday"), "is_round_amt", "is_self_loop", "pair_seen_before")


# ---------------------------------------------------------------- graph
@query("pair_aggregate", sql("SELECT src, dst, round(sum(amt_usd), 7) AS total_usd, count(*) AS n_txns, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CAST(sum(is_laundering) AS BIGINT) AS n_illicit FROM t GROUP BY 1, 2"))
def pair_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return graph.pairs(transactions(spark, d)).select("src", "dst", _r("total_usd"), "n_txns", "first_ts", "last_ts", "n_illicit")


@query("degree_histogram", sql("SELECT 'out' AS direction, deg AS degree, count(*) AS n FROM (SELECT src, count(DISTINCT dst) AS deg FROM f GROUP BY 1) GROUP BY 1, 2 UNION ALL SELECT 'in', deg, count(*) FROM (SELECT dst, count(DISTINCT src) AS deg FROM f GROUP BY 1) GROUP BY 1, 2"))
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(transactions(spark, d))


_REACH = T_SQL.replace("WITH e", "WITH RECURSIVE e", 1) + ", g AS (SELECT DISTINCT src, dst FROM f), v AS (SELECT src AS node FROM g UNION SELECT dst FROM g)"
_SCC = _REACH + ", r AS (SELECT node AS a, node AS b FROM v UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b), c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), k AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c)"


def _components(t: DataFrame) -> DataFrame:
    return graph.strongly_connected(C.flows(t).select("src", "dst"))


@query("scc", _SCC + " SELECT * FROM k")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return _components(transactions(spark, d))


@query("wcc", _REACH + ", u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r AS (SELECT node AS a, node AS b FROM v UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c")
def wcc(spark: SparkSession, d: str) -> DataFrame:
    return graph.weakly_connected(C.flows(transactions(spark, d)).select("src", "dst"))


@query("component_summary", _SCC + " SELECT count(DISTINCT component) AS n, max(size) AS largest, count(DISTINCT component) FILTER (WHERE size > 1) AS nontrivial, count(*) FILTER (WHERE size > 1) AS nodes_in_nontrivial FROM k")
def component_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_summary(_components(transactions(spark, d)))


@query("component_sizes", _SCC + " SELECT size, count(DISTINCT component) AS n FROM k GROUP BY 1")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(_components(transactions(spark, d)))


@query("scc_share", _SCC + """, x AS (SELECT is_laundering, coalesce(a.component = b.component AND a.size > 1, false) AS inside FROM f JOIN k a ON a.node = src JOIN k b ON b.node = dst),
    y AS (SELECT 'all' AS kind, inside FROM x UNION ALL SELECT 'laundering', inside FROM x WHERE is_laundering = 1)
    SELECT kind, count(*) AS transactions, count(*) FILTER (WHERE inside) AS in_nontrivial_scc, round(100 * avg(inside::INT), 8) AS share_pct FROM y GROUP BY 1""")
def scc_share(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return graph.scc_share(t, _components(t)).select("kind", "transactions", "in_nontrivial_scc", _r("share_pct", 8))


@query("numbered_pairs", sql(", v AS (SELECT src AS node FROM f UNION SELECT dst FROM f), ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS ix FROM v) SELECT a.ix AS s, b.ix AS d, count(*) AS n, CAST(sum(is_laundering) AS BIGINT) AS ill FROM f JOIN ids a ON a.node = src JOIN ids b ON b.node = dst GROUP BY 1, 2"))
def numbered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered_pairs(transactions(spark, d))[1]


def _pagerank_sql(rounds: int, digits: int) -> str:
    out = sql(", g AS (SELECT DISTINCT src, dst FROM f), v AS (SELECT node, (SELECT count(*) FROM g WHERE src = node) AS o FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)), n AS (SELECT count(*)::DOUBLE AS n FROM v), x0 AS MATERIALIZED (SELECT node, o, 1 / n AS x FROM v, n)")
    for i in range(rounds):
        out += f", x{i + 1} AS MATERIALIZED (SELECT v.node, v.o, 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(x), 0) FROM x{i} WHERE o = 0) / n) + 0.15 / n AS x FROM v JOIN n ON true LEFT JOIN (SELECT g.dst AS node, sum(x / o) AS got FROM g JOIN x{i} ON x{i}.node = g.src GROUP BY 1) s ON s.node = v.node)"
    return out + f" SELECT node, round(x * n, {digits}) AS pagerank_scaled FROM x{rounds}, n"


@query("pagerank", _pagerank_sql(40, 3))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(transactions(spark, d)).select("node", _r("pagerank_scaled", 3))


@query("pagerank_5_rounds", _pagerank_sql(5, 8))
def pagerank_5_rounds(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(transactions(spark, d), max_iter=5, stop=False).select("node", _r("pagerank_scaled", 8))


@query("clustering", sql(", g AS (SELECT DISTINCT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f), tri AS (SELECT x.a AS node, count(*) / 2 AS t FROM g x JOIN g y ON x.b = y.a JOIN g z ON y.b = z.b AND z.a = x.a WHERE y.b <> x.a GROUP BY 1) SELECT node, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (degree * (degree - 1)) END, 8) AS clustering FROM (SELECT a AS node, count(*) AS degree FROM g GROUP BY 1) LEFT JOIN tri USING (node)"))
def clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(C.flows(transactions(spark, d))).select("node", "degree", "triangles", _r("clustering", 8))


_EGO = """, h1 AS (SELECT other AS node FROM legs WHERE acc = 'U0' GROUP BY 1 ORDER BY max(amt_usd) DESC, 1 LIMIT 39),
    h2 AS (SELECT other AS node FROM legs WHERE acc IN (SELECT node FROM h1) AND other <> 'U0' AND other NOT IN (SELECT node FROM h1) GROUP BY 1 ORDER BY max(amt_usd) DESC, 1 LIMIT greatest(0, 39 - (SELECT count(*) FROM h1))),
    ns AS (SELECT 'U0' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""


@query("ego_nodes", sql(_EGO + " SELECT node, hop, node = 'U0' AS is_centre FROM ns"))
def ego_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(transactions(spark, d), "U0", 2, max_nodes=40)[0]


@query("ego_edges", sql(_EGO + " SELECT txn_id, src, dst, round(amt_usd, 7) AS amt_usd FROM f WHERE src IN (SELECT node FROM ns) AND dst IN (SELECT node FROM ns) ORDER BY f.amt_usd DESC, txn_id LIMIT 200"))
def ego_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(transactions(spark, d), "U0", 2, max_nodes=40, max_edges=200)[1].select("txn_id", "src", "dst", _r("amt_usd"))


@query("illicit_context", sql(""", bad AS (SELECT DISTINCT acc FROM legs WHERE is_laundering = 1), p AS (SELECT src, dst, max(is_laundering) AS b FROM f GROUP BY 1, 2),
    near AS (SELECT * FROM p WHERE src IN (SELECT acc FROM bad) OR dst IN (SELECT acc FROM bad))
    SELECT (SELECT count(*) FROM near) AS context_pairs, (SELECT CAST(sum(b) AS BIGINT) FROM near) AS illicit_pairs, (SELECT count(*) FROM (SELECT src FROM near UNION SELECT dst FROM near)) AS context_accounts, (SELECT count(*) FROM bad) AS illicit_accounts"""))
def illicit_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.illicit_context(transactions(spark, d))


# ---------------------------------------------------------------- evaluation
#: Attempts derived from the data: laundering of one format and day.
_ATTEMPTS = """, att AS (SELECT dense_rank() OVER (ORDER BY date_trunc('day', timestamp)) - 1 AS attempt_id, CASE WHEN day(timestamp) % 3 = 0 THEN 'CYCLE' WHEN day(timestamp) % 3 = 1 THEN 'FAN-OUT' ELSE 'STACK' END AS typology, txn_id FROM t WHERE is_laundering = 1)"""
_COVER = ", cov AS (SELECT DISTINCT detector, txn_id FROM (SELECT 'big' AS detector, txn_id FROM t WHERE amt_usd >= 40 UNION ALL SELECT 'late', txn_id FROM t WHERE hour(timestamp) >= 12))"


def _attempts(t: DataFrame) -> DataFrame:
    day = F.dayofmonth("timestamp") % 3
    a = t.where("is_laundering = 1").withColumn("d", F.date_trunc("day", "timestamp"))
    days = a.select("d").distinct()
    ids = scans.positions(days, ["d"], "attempt_id")
    return a.join(F.broadcast(ids), "d").select(F.col("attempt_id"), F.when(day == 0, "CYCLE").when(day == 1, "FAN-OUT").otherwise("STACK").alias("typology"), F.lit("Max 4 hops").alias("detail"), "txn_id")


def _marked(t: DataFrame) -> DataFrame:
    """Findings of two plain rules, one for each account and rule."""
    a = t.where("amt_usd >= 40").groupBy(F.lit("big").alias("detector"), "src").agg(F.collect_list("txn_id").alias("txn_ids"))
    b = t.where("hour(timestamp) >= 12").groupBy(F.lit("late").alias("detector"), "src").agg(F.collect_list("txn_id").alias("txn_ids"))
    return a.union(b).select("detector", F.array("src").alias("account_ids"), "txn_ids")


@query("typology_recall", sql(_ATTEMPTS + _COVER + """, a AS (SELECT attempt_id, min(typology) AS typology, avg((txn_id IN (SELECT txn_id FROM cov WHERE detector = 'big'))::INT) AS big, avg((txn_id IN (SELECT txn_id FROM cov WHERE detector = 'late'))::INT) AS late, avg((txn_id IN (SELECT txn_id FROM cov))::INT) AS any_detector FROM att GROUP BY 1)
    SELECT coalesce(typology, 'ALL') AS typology, count(*) AS n_attempts, round(avg((big >= 0.5)::INT), 8) AS big, round(avg((late >= 0.5)::INT), 8) AS late, round(avg((any_detector >= 0.5)::INT), 8) AS any_detector FROM a GROUP BY ROLLUP (typology)"""))
def typology_recall(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return evaluation.typology_recall(_marked(t), _attempts(t)).select("typology", "n_attempts", _r("big", 8), _r("late", 8), _r("any_detector", 8))


@query("detector_precision", sql(_ATTEMPTS + _COVER + """, c AS (SELECT * FROM cov UNION ALL SELECT DISTINCT 'ANY', txn_id FROM cov),
    x AS (SELECT detector, count(*) AS n_txns, count(*) FILTER (WHERE is_laundering = 1) AS n_laundering FROM c JOIN t USING (txn_id) GROUP BY 1),
    fs AS (SELECT 'big' AS detector, avg(is_laundering) AS s FROM t WHERE amt_usd >= 40 GROUP BY src UNION ALL SELECT 'late', avg(is_laundering) FROM t WHERE hour(timestamp) >= 12 GROUP BY src),
    y AS (SELECT detector, count(*) AS n_findings, avg((s >= 0.5)::INT) AS fp FROM fs GROUP BY 1 UNION ALL SELECT 'ANY', count(*), NULL FROM fs)
    SELECT detector, n_findings, n_txns, n_laundering, round(n_laundering / n_txns, 8) AS precision, round(n_laundering / (SELECT sum(is_laundering) FROM t), 8) AS recall_all, round(fp, 8) AS finding_precision FROM x JOIN y USING (detector)"""))
def detector_precision(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    p = evaluation.detector_precision(_marked(t), t.select("txn_id", "is_laundering"), _attempts(t))
    return p.select("detector", "n_findings", "n_txns", "n_laundering", _r("precision", 8), _r("recall_all", 8), _r("finding_precision", 8))


#: Findings whose SQL lists their transactions.
_LISTED = ("temporal_cycle", "scatter_gather", "gather_scatter", "pass_through")
_FOUND = ", ff AS (" + " UNION ALL ".join(f"SELECT '{n}' AS detector, txn_ids, score FROM f_{n}" for n in _LISTED) + "), cov AS (SELECT DISTINCT detector, CAST(unnest(string_split(txn_ids, ',')) AS BIGINT) AS txn_id FROM ff)"


def _found(t: DataFrame) -> DataFrame:
    return detectors.run_all(t, _ALL).where(F.col("detector").isin(*_LISTED))


@query("findings_recall", _all_sql() + _ATTEMPTS + _FOUND + ", a AS (SELECT attempt_id, min(typology) AS typology, " + ", ".join(f"avg((txn_id IN (SELECT txn_id FROM cov WHERE detector = '{n}'))::INT) AS {n}" for n in _LISTED) + """, avg((txn_id IN (SELECT txn_id FROM cov))::INT) AS any_detector FROM att GROUP BY 1)
    SELECT coalesce(typology, 'ALL') AS typology, count(*) AS n_attempts, """ + ", ".join(f"round(avg(({n} >= 0.1)::INT), 8) AS {n}" for n in [*_LISTED, "any_detector"]) + " FROM a GROUP BY ROLLUP (typology)")
def findings_recall(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    out = evaluation.typology_recall(session.stored(_found(t), "found"), _attempts(t), 0.1, list(_LISTED))
    return out.select("typology", "n_attempts", *[_r(n, 8) for n in [*_LISTED, "any_detector"]])


@query("findings_precision", _all_sql() + _ATTEMPTS + _FOUND + """, bad AS (SELECT txn_id FROM t WHERE is_laundering = 1), c AS (SELECT * FROM cov UNION ALL SELECT DISTINCT 'ANY', txn_id FROM cov),
    x AS (SELECT detector, count(*) AS n_txns, count(*) FILTER (WHERE txn_id IN (SELECT txn_id FROM bad)) AS n_laundering, count(*) FILTER (WHERE txn_id IN (SELECT txn_id FROM att)) AS n_listed FROM c GROUP BY 1),
    n AS (SELECT detector, count(*) AS n_findings FROM ff GROUP BY 1 UNION ALL SELECT 'ANY', count(*) FROM ff)
    SELECT detector, n_findings, n_txns, n_laundering, round(n_laundering / n_txns, 8) AS precision, round(n_laundering / (SELECT count(*) FROM bad), 8) AS recall_all, round(n_listed / (SELECT count(*) FROM att), 8) AS recall_attributed FROM x JOIN n USING (detector)""")
def findings_precision(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    p = evaluation.detector_precision(session.stored(_found(t), "found"), t.select("txn_id", "is_laundering"), _attempts(t))
    return p.select("detector", "n_findings", "n_txns", "n_laundering", _r("precision", 8), _r("recall_all", 8), _r("recall_attributed", 8))


@query("recall_by_size", sql(_ATTEMPTS + _COVER + """, a AS (SELECT attempt_id, count(*) AS size, avg((txn_id IN (SELECT txn_id FROM cov))::INT) AS s FROM att GROUP BY 1)
    SELECT CASE WHEN size <= 2 THEN '1-2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' ELSE '>10' END AS size_bucket, count(*) AS attempts, round(avg((s >= 0.5)::INT), 8) AS detected FROM a GROUP BY 1"""))
def recall_by_size(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return evaluation.recall_by_size(_marked(t), _attempts(t)).select("size_bucket", "attempts", _r("detected", 8))


@query("cycle_recall_by_hops", sql(_ATTEMPTS + """, a AS (SELECT attempt_id, avg((amt_usd >= 40)::INT) AS s FROM att JOIN t USING (txn_id) WHERE typology = 'CYCLE' GROUP BY 1) SELECT '4-6' AS hop_bucket, count(*) AS attempts, round(avg((s >= 0.5)::INT), 8) AS detected FROM a"""))
def cycle_recall_by_hops(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    found = _marked(t).where("detector = 'big'").withColumn("detector", F.lit("temporal_cycle"))
    return evaluation.cycle_recall_by_hops(found, _attempts(t)).select("hop_bucket", "attempts", _r("detected", 8))


@query("account_labels", sql("SELECT DISTINCT acc, 1 AS y FROM (SELECT src AS acc FROM t WHERE is_laundering = 1 UNION SELECT dst FROM t WHERE is_laundering = 1)"))
def account_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.account_labels(transactions(spark, d))


@query("detector_counts", sql("SELECT src AS acc, count(DISTINCT 1) FILTER (WHERE amt_usd >= 40) AS hits_fan_out, count(DISTINCT 1) FILTER (WHERE hour(timestamp) >= 12) AS hits_fan_in FROM t GROUP BY 1"))
def detector_counts(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    m = _marked(t).withColumn("detector", F.when(F.col("detector") == "big", "fan_out").otherwise("fan_in"))
    c = features.detector_counts(t.select(F.col("src").alias("acc")).distinct(), m)
    return c.select("acc", F.col("hits_fan_out").cast("long").alias("hits_fan_out"), F.col("hits_fan_in").cast("long").alias("hits_fan_in"))


def _scored(t: DataFrame) -> DataFrame:
    """y and a score with many ties."""
    return t.select("txn_id", F.col("is_laundering").alias("y"), F.floor(F.col("amt_usd")).cast("double").alias("score"))


_SCORED = ", s AS (SELECT txn_id, is_laundering AS y, floor(amt_usd)::DOUBLE AS score FROM t), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS nn FROM g WINDOW w AS (ORDER BY score DESC))"


@query("average_precision", sql(_SCORED + " SELECT round(sum(p * tp / nn) / (SELECT sum(y) FROM s), 8) AS average_precision FROM c"))
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.average_precision(_scored(transactions(spark, d))).select(_r("average_precision", 8))


@query("pr_curve", sql(_SCORED + " SELECT score, CAST(tp AS BIGINT) AS tp, CAST(nn - tp AS BIGINT) AS fp, round(tp / nn, 8) AS precision, round(tp / (SELECT sum(y) FROM s), 8) AS recall FROM c"))
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.curve(_scored(transactions(spark, d))).select("score", "tp", "fp", _r("precision", 8), _r("recall", 8))


@query("precision_at_k", sql(_SCORED + ", k AS (SELECT unnest([10, 100, 1000, 10000000]) AS k), kk AS (SELECT k, least(k, (SELECT count(*) FROM s)) AS m FROM k) SELECT CAST(k AS INT) AS k, round((tp - p + (m - (nn - n)) * p / n) / m, 8) AS precision FROM c JOIN kk ON nn >= m AND nn - n < m"))
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.precision_at(_scored(transactions(spark, d)), [10, 100, 1000, 10_000_000]).select("k", _r("precision", 8))


@query("best_f1", sql(_SCORED + ", b AS (SELECT score, 2 * tp / (nn + (SELECT sum(y) FROM s)) AS f1 FROM c) SELECT min(score) AS threshold, round(max(f1), 8) AS f1 FROM b WHERE f1 >= (SELECT max(f1) FROM b) - 1e-12"))
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_f1(_scored(transactions(spark, d))).select("threshold", _r("f1", 8))


@query("mean_rank", sql(", s AS (SELECT txn_id, floor(amt_usd) AS a, hour(timestamp) AS b FROM t), x AS (SELECT txn_id, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2) / count(*) OVER () AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2) / count(*) OVER () AS rb FROM s) SELECT txn_id, round((ra + rb) / 2, 8) AS ensemble FROM x"))
def mean_rank(spark: SparkSession, d: str) -> DataFrame:
    s = transactions(spark, d).select("txn_id", F.floor("amt_usd").alias("a"), F.hour("timestamp").alias("b"))
    return anomaly.mean_rank(s, ["a", "b"]).select("txn_id", _r("ensemble", 8))


@query("temporal_split", sql(", x AS (SELECT txn_id, row_number() OVER (ORDER BY timestamp, txn_id) - 1 AS r, count(*) OVER () AS n FROM t) SELECT txn_id, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM x"))
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return supervised.temporal_split(transactions(spark, d)).select("txn_id", "split")


@query("account_maxima", sql("SELECT acc, round(max(amt_usd), 7) AS max_supervised_score, CAST(sum(is_laundering) AS BIGINT) AS n_laundering_txns FROM legs GROUP BY acc"))
def account_maxima(spark: SparkSession, d: str) -> DataFrame:
    s = C.flows(transactions(spark, d)).withColumn("score", F.col("amt_usd"))
    return scoring.account_maxima(s).select("acc", _r("max_supervised_score"), "n_laundering_txns")


# ---------------------------------------------------------------- views
@query("account_timeline", sql("SELECT txn_id, timestamp, CASE WHEN src = 'U3' THEN 'out' ELSE 'in' END AS direction, CASE WHEN src = 'U3' THEN dst ELSE src END AS counterparty, round(amt_usd, 7) AS amt_usd FROM f WHERE src = 'U3' OR dst = 'U3'"))
def account_timeline(spark: SparkSession, d: str) -> DataFrame:
    return views.account_transactions(transactions(spark, d), "U3").select("txn_id", "timestamp", "direction", "counterparty", _r("amt_usd"))


def _flows_sql() -> str:
    parts, ctes = [], ", d AS (SELECT src, dst, sum(amt_usd) AS usd, count(*) AS n FROM f GROUP BY 1, 2)"
    for way, near, far in (("out", "src", "dst"), ("in", "dst", "src")):
        ctes += f", {way}1 AS (SELECT * FROM d WHERE {near} = 'U3' ORDER BY usd DESC, {far} LIMIT 8), {way}2 AS (SELECT src, dst, usd, n FROM (SELECT *, row_number() OVER (PARTITION BY {near} ORDER BY usd DESC, {far}) AS r FROM d WHERE {near} IN (SELECT {far} FROM {way}1) AND {far} <> 'U3') WHERE r <= 4)"
        parts += [f"SELECT '{way}' AS direction, {i} AS level, src, dst, round(usd, 7) AS usd, n FROM {way}{i}" for i in (1, 2)]
    return sql(ctes + " " + " UNION ALL ".join(parts))


@query("money_flows", _flows_sql())
def money_flows(spark: SparkSession, d: str) -> DataFrame:
    return views.money_flows(transactions(spark, d), "U3").select("direction", "level", "src", "dst", _r("usd"), "n")


@query("busiest_format", sql("SELECT payment_format, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1"))
def busiest_format(spark: SparkSession, d: str) -> DataFrame:
    return views.most_common(transactions(spark, d), "payment_format")


@query("period_flows", sql("SELECT src, count(*) AS n, round(sum(amt_usd), 7) AS usd FROM f WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND amt_usd >= 20 GROUP BY 1"))
def period_flows(spark: SparkSession, d: str) -> DataFrame:
    views.filtered_view(transactions(spark, d), "heddle_flows", "src <> dst")
    text = "SELECT src, count(*) AS n, round(sum(amt_usd), 7) AS usd FROM heddle_flows WHERE timestamp BETWEEN :start AND :end AND amt_usd >= :least GROUP BY src"
    return views.bound(spark, text, start=datetime(2024, 1, 5), end=datetime(2024, 1, 20), least=20.0)


@query("bank_accounts", "SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS bank, count(*) AS n_accounts FROM customer GROUP BY 1")
def bank_accounts(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    ids = c.select(C.node_id(F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.col("c_custkey").cast("string")).alias("acc"))
    return ids.groupBy(C.bank_of(F.col("acc")).alias("bank")).agg(F.count("*").alias("n_accounts"))


@query("top_accounts", sql("SELECT acc, round(sum(amt_usd), 7) AS usd FROM legs GROUP BY 1 ORDER BY sum(amt_usd) DESC, acc LIMIT 20"))
def top_accounts(spark: SparkSession, d: str) -> DataFrame:
    s = C.legs(C.flows(transactions(spark, d)), "amt_usd").groupBy("acc").agg(F.sum("amt_usd").alias("usd"))
    return views.top_accounts(s, 20, "usd").select("acc", _r("usd"))


# ---------------------------------------------------------------- models (rows only)
NUMERIC = ["n_out", "deg_out", "usd_out_sum", "usd_out_mean", "usd_out_max", "n_in", "deg_in", "usd_in_sum", "usd_in_mean", "usd_in_max"]


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return features.standardised(features.account_flows(transactions(spark, d)).select("acc", *NUMERIC), ["acc"])


@query("isolation_forest")
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.isolation_forest(_matrix(spark, d), "acc", NUMERIC)


@query("local_outlier_factor")
def local_outlier_factor(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.local_outlier_factor(anomaly.principal_components(_matrix(spark, d), "acc", NUMERIC, 5), "acc", 20)


@query("account_features")
def account_features(spark: SparkSession, d: str) -> DataFrame:
    return features.account_features(transactions(spark, d))


@query("supervised_margins")
def supervised_margins(spark: SparkSession, d: str) -> DataFrame:
    split = supervised.temporal_split(features.transaction_features(transactions(spark, d).where("amt_usd > -1"), (7,)))
    return supervised.margins(supervised.fit(split), split)


@query("density_clusters")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.hdbscan(anomaly.principal_components(_matrix(spark, d), "acc", NUMERIC, 5), "acc")


@query("attributions")
def attributions(spark: SparkSession, d: str) -> DataFrame:
    split = supervised.temporal_split(features.transaction_features(transactions(spark, d).where("amt_usd > -1"), (7,)))
    return attribution.attributions(supervised.fit(split, rounds=20, depth=4), split.where("split = 'test'"))
