"""Rule detectors of laundering structures. None reads a label; self-loops carry no flow and are left out.

Each takes transactions (txn_id, timestamp, src, dst, amt_usd; pass-through also pay_ccy, recv_ccy) and
gives rows of schemas.FINDINGS.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle import schemas
from heddle.config import Detectors
from heddle.functions import scans
from heddle.functions.columns import DAY, flag, flows, legs, micros
from heddle.operators import graph
from heddle.session import stored

log = logging.getLogger(__name__)


def _findings(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    out = {"detector": F.lit(name), **columns}
    return df.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.FINDINGS])


def top_ids(df: DataFrame, keys: list[str], value: str, cap: int, out: str) -> DataFrame:
    """(keys, out): the ids of each group's cap largest rows, largest first, ties by id. Only they are gathered."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "txn_id")
    d = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap)
    return d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "txn_id"))), lambda x: x["txn_id"]).alias(out))


def capped_set(df: DataFrame, keys: list[str], value: str, cap: int, out: str) -> DataFrame:
    """(keys, out): the cap smallest distinct values of each group, in order."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap)
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))


# ---------------------------------------------------------------- temporal cycles
def _buckets(low: Column, high: Column, width: float) -> Column:
    """The whole numbers of the buckets of a width that low to high touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def temporal_cycles(t: DataFrame, cfg: Detectors = Detectors(), narrow: bool = True) -> DataFrame:
    """Loops a0 -> a1 -> ... -> a0 with strictly rising times (in seconds), all within the window of the first
    hop, amounts within the tolerance of the first hop's, no account twice, at most the bound of hops.

    Paths grow by one join a hop, on the account and on buckets of time and of the amount's logarithm, so that a
    hub's payments meet only those of like time and amount; the last hop joins on the account to return to as
    well. narrow: search only inside strongly connected components, where all cycles are. Each cycle comes from
    its first hop. Results are whole: components beyond the configured numbers of cycles or of paths are logged.
    """
    e = flows(t).select("txn_id", "timestamp", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("sec"), "src", "dst", "amt_usd")
    if narrow:
        scc = graph.strongly_connected(e.select("src", "dst").distinct()).where("size > 1").select("node", "component")
        a, b = (scc.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in ("src", "dst"))
        e = e.join(a, "src").join(b, "dst").where("c_src = c_dst").withColumnRenamed("c_src", "component").drop("c_dst")
    else:
        e = e.withColumn("component", F.lit(""))
    e = stored(e, "cycle_edges")
    tol, window = cfg.amount_tolerance, int(cfg.cycle_window_days * DAY // 1_000_000)
    span = max(1, window)
    # an amount's range touches two buckets at most; without a positive lower end all amounts share one
    wide = math.log((1 + tol) / (1 - tol)) + 1e-6 if 0 < tol < 1 else 1e-6 if tol == 0 else None
    ln = lambda x: F.when(x > 0, F.ln(x)).otherwise(0.0) if wide else F.lit(0.0)
    step = wide or 1.0
    hop = e.select(
        F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), F.col("sec").alias("n_sec"), F.col("amt_usd").alias("n_usd"), F.col("txn_id").alias("n_id"), F.col("timestamp").alias("n_ts"),
        F.floor(F.col("sec") / span).alias("n_time"), F.floor(ln(F.col("amt_usd")) / step).alias("n_size"),
    )
    paths = e.select(
        F.array("src", "dst").alias("nodes"), F.array("txn_id").alias("ids"), F.col("src").alias("start"), F.col("dst").alias("at"), F.col("sec").alias("last"),
        (F.col("sec") + window).alias("until"), F.col("amt_usd").alias("first_usd"), F.col("amt_usd").alias("total"),
        F.lit(0.0).alias("dev"), F.col("timestamp").alias("start_ts"), F.col("timestamp").alias("end_ts"), "component",
    )
    ends = [F.col("first_usd") * (1 + sign * tol) for sign in (-1, 1)]
    done: DataFrame | None = None
    counted: DataFrame | None = None
    for length in range(2, cfg.cycle_length_bound + 1):
        dealt = paths.withColumn("time", F.explode(_buckets(F.col("last"), F.col("until"), span)))
        dealt = dealt.withColumn("size", F.explode(_buckets(ln(ends[0]) - 1e-9, F.greatest(ln(ends[0]) - 1e-9, ln(ends[1]) + 1e-9), step)))
        on = (F.col("at") == F.col("n_src")) & (F.col("time") == F.col("n_time")) & (F.col("size") == F.col("n_size"))
        if length == cfg.cycle_length_bound:
            on &= F.col("start") == F.col("n_dst")
        found = dealt.join(hop, on).where((F.col("n_sec") > F.col("last")) & (F.col("n_sec") <= F.col("until")) & (F.col("n_usd") >= ends[0]) & (F.col("n_usd") <= ends[1]))
        found = found.where((F.col("n_dst") == F.col("start")) | ~F.array_contains("nodes", F.col("n_dst")))
        grown = found.select(
            F.when(F.col("n_dst") == F.col("start"), F.col("nodes")).otherwise(F.concat("nodes", F.array("n_dst"))).alias("nodes"),
            F.concat("ids", F.array("n_id")).alias("ids"), "start", F.col("n_dst").alias("at"), F.col("n_sec").alias("last"), "until", "first_usd",
            (F.col("total") + F.col("n_usd")).alias("total"), F.greatest("dev", F.coalesce(F.abs(F.try_divide("n_usd", "first_usd") - 1), F.lit(0.0))).alias("dev"),
            "start_ts", F.col("n_ts").alias("end_ts"), "component",
        )
        grown = stored(grown, f"paths_{length}")
        tally = grown.select("component", (F.col("at") == F.col("start")).alias("closed") if length >= cfg.cycle_min_length else F.lit(False).alias("closed"))
        counted = tally if counted is None else counted.union(tally)
        if length >= cfg.cycle_min_length:
            closed = grown.where("at = start")
            done = closed if done is None else done.union(closed)
        paths = grown.where("at <> start")
    if done is None:
        return t.sparkSession.createDataFrame([], schemas.FINDINGS)
    sizes = counted.groupBy("component").agg(F.count_if("closed").alias("cycles"), F.count("*").alias("paths"))
    over = sizes.where((F.col("cycles") > cfg.max_cycles_per_component) | (F.col("paths") > cfg.max_expansions_per_component))
    for r in over.orderBy(F.desc("paths"), "component").limit(20).collect():
        log.warning("cap hit in the component of %s: %d cycles, %d paths; all are kept", r.component, r.cycles, r.paths)
    return _findings(
        done, "temporal_cycle", account_ids=F.col("nodes"), txn_ids=F.col("ids"), start_ts=F.col("start_ts"), end_ts=F.col("end_ts"), total_usd=F.col("total"),
        score=0.5 + 0.5 * (1 - F.least(F.col("dev") / tol, F.lit(1.0))) if tol else F.lit(1.0),
        detail=F.format_string("%d hops, max amount deviation %.1f%%", F.size("ids"), F.col("dev") * 100),
    )


# ---------------------------------------------------------------- fan-in and fan-out
def sliding_distinct(d: DataFrame, days: float, key: str = "k", other: str = "other", at: str = "us") -> DataFrame:
    """(key, at, c): for each row the number of distinct others of the key within [at - days, at].

    An event counts from its time until it leaves the window or its counterparty comes again, whichever
    is first; so a running sum of +1 and -1 marks gives the distinct count, with no set of any window's members.
    """
    again = F.lead(at).over(Window.partitionBy(key, other).orderBy(at))
    ends = F.least(F.col(at) + int(days * DAY) + 1, F.coalesce(again, F.lit(2**62)))
    marks = d.withColumn("__end", ends).select(key, F.explode(F.array(
        F.struct(F.col(at).alias("at"), F.lit(1).alias("c"), F.lit(True).alias("asks")),
        F.struct(F.col("__end").alias("at"), F.lit(-1).alias("c"), F.lit(False).alias("asks")),
    )).alias("m")).select(key, "m.at", "m.c", "m.asks")
    return scans.running_totals(marks, key, "at", ["c"], F.col("asks")).select(key, F.col("at").alias(at), "c")


def fan_peaks(t: DataFrame, cfg: Detectors, direction: str) -> DataFrame:
    """(k, w, peak, peak_us): the peak of distinct counterparties in a window of w days and its first end, of accounts with enough of them."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    d = flows(t).select(F.col(key).alias("k"), F.col(other).alias("other"), micros(F.col("timestamp")).alias("us"))
    enough = d.groupBy("k").agg(F.count_distinct("other").alias("nd")).where(F.col("nd") >= cfg.fan_min_degree)
    d = d.join(enough.select("k"), "k", "left_semi")
    parts = [
        sliding_distinct(d, w).groupBy("k").agg(F.max("c").alias("peak"), F.min_by("us", F.struct(-F.col("c"), F.col("us"))).alias("peak_us")).select("k", F.lit(w).alias("w"), "peak", "peak_us")
        for w in cfg.fan_windows_days
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def fan(t: DataFrame, cfg: Detectors, direction: str) -> DataFrame:
    """Accounts whose peak is over the percentile of all accounts' peaks (those with few counterparties count with all of them)."""
    key, other = ("src", "dst") if direction == "out" else ("dst", "src")
    base = flows(t).select(F.col(key).alias("k"), F.col(other).alias("other"), "txn_id", "timestamp", "amt_usd", micros(F.col("timestamp")).alias("us"))
    degree = base.groupBy("k").agg(F.count_distinct("other").alias("nd"))
    peaks = stored(fan_peaks(t, cfg, direction), "peaks")
    few = degree.where(F.col("nd") < cfg.fan_min_degree).select(F.explode(F.array(*[F.lit(w) for w in cfg.fan_windows_days])).alias("w"), F.col("nd").alias("peak"))
    population = peaks.select("w", "peak").union(few)
    limits = population.groupBy("w").agg(F.greatest(F.percentile("peak", cfg.fan_percentile / 100), F.lit(float(cfg.fan_min_degree - 1))).alias("thr"))
    best = peaks.join(F.broadcast(limits), "w").where("peak > thr").withColumn("score", 1 - F.col("thr") / F.col("peak"))  # a row for each window
    first = Window.partitionBy("k").orderBy(F.desc("score"), F.expr(f"array_position(array({', '.join(map(str, cfg.fan_windows_days))}), w)"))
    best = stored(best.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r"), "flagged")
    rows = stored(base.join(best, "k").where((F.col("us") <= F.col("peak_us")) & (F.col("us") >= F.col("peak_us") - F.col("w") * DAY)), "fan_rows")
    sums = rows.groupBy("k", "w", "peak", "score", "thr").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.sum("amt_usd").alias("total"))
    cap = cfg.max_txns_per_finding
    out = sums.join(top_ids(rows, ["k"], "amt_usd", cap, "ids"), "k").join(capped_set(rows, ["k"], "other", cap, "others"), "k")
    return _findings(
        out, f"fan_{direction}", account_ids=F.concat(F.array("k"), F.col("others")), txn_ids=F.col("ids"), start_ts=F.col("s"), end_ts=F.col("e"), total_usd=F.col("total"), score=F.col("score"),
        detail=F.format_string("%d distinct counterparties in %dd (threshold %.0f)", "peak", "w", "thr"),
    )


def fan_out(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    return fan(t, cfg, "out")


def fan_in(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    return fan(t, cfg, "in")


# ---------------------------------------------------------------- two-hop structures
def intermediaries(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    """(acc, n_in, n_out, ok): accounts with flow both ways; ok unless one way has more transactions than the cap."""
    both = legs(flows(t)).groupBy("acc").agg(F.count_if(F.col("role") == "in").alias("n_in"), F.count_if(F.col("role") == "out").alias("n_out"))
    return both.where("n_in > 0 and n_out > 0").withColumn("ok", F.greatest("n_in", "n_out") <= cfg.max_intermediary_txns)


def _payments(t: DataFrame, cfg: Detectors) -> tuple[DataFrame, DataFrame]:
    """Payments into (s, i, t1, ts1, u1, us1) and out of (i, d, t2, ts2, u2, us2) intermediaries under the cap."""
    e = stored(flows(t).select("txn_id", "timestamp", "src", "dst", "amt_usd"), "payments")
    ok = stored(intermediaries(e, cfg).where("ok").select(F.col("acc").alias("i")), "intermediaries")
    us = micros(F.col("timestamp"))
    a = e.select(F.col("src").alias("s"), F.col("dst").alias("i"), F.col("txn_id").alias("t1"), F.col("timestamp").alias("ts1"), F.col("amt_usd").alias("u1"), us.alias("us1"))
    b = e.select(F.col("src").alias("i"), F.col("dst").alias("d"), F.col("txn_id").alias("t2"), F.col("timestamp").alias("ts2"), F.col("amt_usd").alias("u2"), us.alias("us2"))
    return a.join(ok, "i", "left_semi"), b.join(ok, "i", "left_semi")


def two_hop_paths(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    """(s, i, d, t1, t2, ts1, ts2, u1, u2): a payment into i, then one out of it within the window, not back to s.

    Hubs over the cap are left out; that is part of the rule and bounds the paths of an intermediary. Payments meet
    by intermediary and half window, so that few pairs outside the window are formed.
    """
    a, b = _payments(t, cfg)
    window = int(cfg.scatter_gather_window_days * DAY)
    half = max(1, -(-window // 2))
    a = a.withColumn("at", F.explode(_buckets(F.col("us1"), F.col("us1") + window, half)))
    j = a.join(b.withColumn("at", F.floor(F.col("us2") / half)), ["i", "at"])
    j = j.where((F.col("us2") > F.col("us1")) & (F.col("us2") <= F.col("us1") + window) & (F.col("s") != F.col("d")))
    return j.select("s", "i", "d", "t1", "t2", "ts1", "ts2", "u1", "u2")


def _ids(p: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(keys, ids): the first hops' ids in order, then the second hops', cap at most. p: rows (keys, hop, id)."""
    w = Window.partitionBy(*keys).orderBy("hop", "id")
    first = p.select(*keys, "hop", "id").distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "id"))), lambda x: x["id"]).alias("ids"))


def scatter_gather(t: DataFrame, cfg: Detectors = Detectors(), paths: DataFrame | None = None) -> DataFrame:
    """Pairs of accounts joined by two-hop paths over enough distinct intermediaries."""
    p = paths if paths is not None else stored(two_hop_paths(t, cfg), "paths")
    m, cap = cfg.scatter_gather_min_paths, cfg.max_txns_per_finding
    # the total is a sum over paths: a first payment counts once for every second hop that it meets
    one = p.groupBy("s", "d", "i").agg(F.min("ts1").alias("start_ts"), F.max("ts2").alias("end_ts"), F.sum("u1").alias("total"))
    g = one.groupBy("s", "d").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("i")).alias("ints"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("total").alias("total"))
    g = stored(g.where(F.col("n") >= m), "scattered")
    hops = F.array(F.struct(F.lit(1).alias("hop"), F.col("t1").alias("id")), F.struct(F.lit(2).alias("hop"), F.col("t2").alias("id")))
    own = p.join(g.select("s", "d"), ["s", "d"], "left_semi").select("s", "d", F.explode(hops).alias("x")).select("s", "d", "x.hop", "x.id")
    out = g.join(_ids(own, ["s", "d"], cap), ["s", "d"])
    return _findings(
        out, "scatter_gather", account_ids=F.concat(F.array("s"), "ints", F.array("d")), txn_ids=F.col("ids"), start_ts=F.col("start_ts"), end_ts=F.col("end_ts"), total_usd=F.col("total"),
        score=F.least(F.lit(1.0), F.col("n") / (2 * m)), detail=F.format_string("%d intermediaries", "n"),
    )


def _partners(mine: DataFrame, theirs: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """(id, n): for each of mine (key, id, us) the number of theirs (key, us) with the same key at a time in (us + low, us + high]."""
    ask = F.array(F.struct((F.col("us") + high).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("us") + low).alias("at"), F.lit(-1).alias("sign")))
    k = F.struct(*key).alias("k")
    marks = mine.select(k, "id", F.explode(ask).alias("x")).select("k", "id", "x.at", "x.sign", F.lit(0).alias("c"))
    marks = marks.unionByName(theirs.select(k, F.lit(None).cast("long").alias("id"), F.col("us").alias("at"), F.lit(0).alias("sign"), F.lit(1).alias("c")))
    sums = scans.running_totals(marks, "k", "at", ["c"], F.col("sign") != 0)
    return sums.groupBy("id").agg(F.sum(F.col("sign") * F.col("c")).alias("n"))


def gather_scatter(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    """Hubs with paths from enough distinct sources and to enough distinct destinations.

    No path is formed: running counts tell how many second hops a payment into a hub meets in its window, and how
    many of those go back to its source; likewise for payments out. Those that meet another account's are the paths' hops.
    """
    m, cap, window = cfg.scatter_gather_min_paths, cfg.max_txns_per_finding, int(cfg.scatter_gather_window_days * DAY)
    a, b = _payments(t, cfg)
    a = a.select("i", F.col("s").alias("other"), F.col("t1").alias("id"), F.col("us1").alias("us"), F.col("ts1").alias("ts"), "u1")
    b = b.select("i", F.col("d").alias("other"), F.col("t2").alias("id"), F.col("us2").alias("us"), F.col("ts2").alias("ts"))
    hops = []
    for hop, mine, theirs, low, high in ((1, a, b, 0, window), (2, b, a, -window - 1, -1)):
        met = _partners(mine, theirs, ["i"], low, high).join(_partners(mine, theirs, ["i", "other"], low, high).withColumnRenamed("n", "back"), "id")
        met = met.select("id", (F.col("n") - F.col("back")).alias("n")).where("n > 0")
        usd = F.col("u1") * F.col("n") if hop == 1 else F.lit(None).cast("double")
        hops.append(mine.join(met, "id").select("i", "other", F.lit(hop).alias("hop"), "id", "ts", usd.alias("usd")))
    p = stored(hops[0].union(hops[1]), "hops")
    first = F.col("hop") == 1
    g = p.groupBy("i").agg(
        F.count_distinct(F.when(first, F.col("other"))).alias("n_src"), F.count_distinct(F.when(~first, F.col("other"))).alias("n_dst"),
        F.min(F.when(first, F.col("ts"))).alias("start_ts"), F.max(F.when(~first, F.col("ts"))).alias("end_ts"), F.sum("usd").alias("total"),
    )
    g = stored(g.where((F.col("n_src") >= m) & (F.col("n_dst") >= m)), "hubs")
    own = p.join(g.select("i"), "i", "left_semi")
    out = g.join(capped_set(own.where(first), ["i"], "other", cap, "srcs"), "i").join(capped_set(own.where(~first), ["i"], "other", cap, "dsts"), "i").join(_ids(own, ["i"], cap), "i")
    return _findings(
        out, "gather_scatter", account_ids=F.concat(F.array("i"), "srcs", "dsts"), txn_ids=F.col("ids"), start_ts=F.col("start_ts"), end_ts=F.col("end_ts"), total_usd=F.col("total"),
        score=F.least(F.lit(1.0), F.least("n_src", "n_dst") / (2 * m)), detail=F.format_string("%d sources -> hub -> %d destinations", "n_src", "n_dst"),
    )


# ---------------------------------------------------------------- pass-through
def pass_through_metrics(t: DataFrame) -> DataFrame:
    """Of accounts with flow both ways: counts and sums each way, their ratio, the median hours from a payment in to
    the next one out (same time counts), distinct counterparties, and the cross-currency share."""
    e = legs(flows(t), "timestamp", "amt_usd", "pay_ccy", "recv_ccy").withColumn("us", micros(F.col("timestamp")))
    e = e.withColumns({"bin": F.floor(F.col("us") / DAY), "out_us": F.when(F.col("role") == "out", F.col("us"))})
    # times of a day in falling order: the smallest so far is the next payment out, else the first of a later day
    later = Window.partitionBy("acc", "bin").orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    days = e.groupBy("acc", "bin").agg(F.min("out_us").alias("first_out"))
    after = Window.partitionBy("acc").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("acc", "bin", F.min("first_out").over(after).alias("then"))
    e = e.withColumn("own", F.min("out_us").over(later)).join(days, ["acc", "bin"]).withColumn("next_out", F.coalesce("own", "then"))
    inn, out = F.col("role") == "in", F.col("role") == "out"
    g = e.groupBy("acc").agg(
        F.count_if(inn).alias("n_in"), F.count_if(out).alias("n_out"),
        F.sum(F.when(inn, F.col("amt_usd"))).alias("usd_in"), F.sum(F.when(out, F.col("amt_usd"))).alias("usd_out"),
        (F.median(F.when(inn, F.col("next_out") - F.col("us"))) / 3.6e9).alias("median_dwell_hours"),
        F.count_distinct("other").alias("n_counterparties"),
        F.avg(flag(F.col("pay_ccy") != F.col("recv_ccy"))).alias("cross_ccy_share"),
    )
    g = g.where("n_in > 0 and n_out > 0").withColumn("ratio_out_in", F.try_divide("usd_out", "usd_in"))
    return g.select("acc", "n_in", "n_out", "usd_in", "usd_out", "ratio_out_in", "median_dwell_hours", "n_counterparties", "cross_ccy_share")


def pass_through(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    """Accounts that pass on about what they get, soon after they get it."""
    dev = F.abs(F.col("ratio_out_in") - 1)
    m = pass_through_metrics(t).where(
        (F.col("n_in") >= cfg.pass_through_min_txns) & (F.col("n_out") >= cfg.pass_through_min_txns) & (F.col("usd_in") >= cfg.pass_through_min_usd)
        & (dev <= cfg.pass_through_ratio_tol) & (F.col("median_dwell_hours") <= cfg.pass_through_max_dwell_hours)
    )
    m = stored(m, "conduits")
    own = legs(flows(t), "txn_id", "timestamp", "amt_usd").join(m.select("acc"), "acc", "left_semi")
    span = own.groupBy("acc").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))
    out = m.join(span, "acc").join(top_ids(own, ["acc"], "amt_usd", cfg.max_txns_per_finding, "ids"), "acc")
    part = lambda x, most: 1 - F.least(x / most, F.lit(1.0))
    return _findings(
        out, "pass_through", account_ids=F.array("acc"), txn_ids=F.col("ids"), start_ts=F.col("s"), end_ts=F.col("e"), total_usd=F.col("usd_in"),
        score=0.5 * part(dev, cfg.pass_through_ratio_tol) + 0.5 * part(F.col("median_dwell_hours"), cfg.pass_through_max_dwell_hours),
        detail=F.format_string("out/in %.2f, median dwell %.1fh", "ratio_out_in", "median_dwell_hours"),
    )


def run_all(t: DataFrame, cfg: Detectors = Detectors()) -> DataFrame:
    """All detectors' findings; pass-through only if the currencies are there. An empty result has the same columns."""
    parts = [temporal_cycles(t, cfg), fan_out(t, cfg), fan_in(t, cfg), scatter_gather(t, cfg), gather_scatter(t, cfg)]
    if {"pay_ccy", "recv_ccy"} <= set(t.columns):
        parts.append(pass_through(t, cfg))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
