import datetime as dt

import pytest

from heddle import config, schemas
from heddle.functions import names
from heddle.functions.columns import node_id
from heddle.operators import fx
from heddle.sources import attempts, transactions

ROWS = [
    "2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1",
    "2022/09/01 04:33,021174,800737690,020,80020C5B0,8630.40,Euro,8630.40,Euro,ACH,1",
]
BLOCKS = ["BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2-degree Fan-Out", *ROWS, "END LAUNDERING ATTEMPT - FAN-OUT", "",
          "BEGIN LAUNDERING ATTEMPT - BIPARTITE", ROWS[0].replace("Euro", "Saudi Riyal"), "END LAUNDERING ATTEMPT - BIPARTITE"]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return f"file://{path}"


def test_csv_is_read_by_position_and_keeps_zeros(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
    path = write(tmp_path / "t.csv", [head, *ROWS, "2022/09/01 05:00,010,A,010,A,5.0,Euro,5.0,Euro,Wire,0"])
    t = transactions.ingest(spark, path, f"file://{tmp_path}/out")
    rows = t.orderBy("txn_id").collect()
    assert [r.txn_id for r in rows] == [0, 1, 2]
    assert rows[0].src == "021174_800737690" and rows[2].src == "010_A"
    assert rows[0].timestamp == dt.datetime(2022, 9, 1, 0, 6)
    assert [r.is_self_loop for r in rows] == [False, False, True]
    s = transactions.summary(t).first()
    assert (s.n, s.n_src, s.n_illicit, s.n_self_loops) == (3, 2, 2, 1)


def test_numbering_spans_partitions(spark, tmp_path):
    from heddle.functions import scans

    write(tmp_path / "n.txt", [f"row {i}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = scans.numbered(spark.read.text(f"file://{tmp_path}/n.txt"), "at")
        assert d.rdd.getNumPartitions() > 3
        assert all(r.value == f"row {r['at']}" for r in d.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_node_ids_keep_leading_zeros(spark):
    d = spark.createDataFrame([("010", "8000EBD30"), ("10", "8000EBD30"), (None, "x")], "b string, a string")
    assert [r[0] for r in d.select(node_id(d.b, d.a)).collect()] == ["010_8000EBD30", "10_8000EBD30", None]


def test_attempts_are_parsed(spark, tmp_path):
    a = attempts.parse(spark, write(tmp_path / "p.txt", BLOCKS)).orderBy("attempt_id", "seq").collect()
    assert [(r.attempt_id, r.typology, r.seq) for r in a] == [(0, "FAN-OUT", 0), (0, "FAN-OUT", 1), (1, "BIPARTITE", 0)]
    assert a[0].detail == "Max 2-degree Fan-Out" and a[2].detail == ""
    assert a[0].from_bank == "021174" and a[0].timestamp == dt.datetime(2022, 9, 1, 0, 6) and a[1].amt_paid == 8630.40


@pytest.mark.parametrize(("lines", "problem"), [
    (BLOCKS[:3], "ends inside"),
    ([BLOCKS[0], BLOCKS[0]], "BEGIN inside"),
    ([BLOCKS[0], ROWS[0], "END LAUNDERING ATTEMPT - STACK"], "unmatched END"),
    ([ROWS[0]], "outside an attempt"),
    ([BLOCKS[0], "a,b", BLOCKS[3]], "11 fields"),
])
def test_malformed_attempts_raise(spark, tmp_path, lines, problem):
    with pytest.raises(ValueError, match=problem):
        attempts.parse(spark, write(tmp_path / "p.txt", lines)).count()


def test_repeated_rows_match_in_turn(spark):
    key = (dt.datetime(2022, 9, 1), "1", "a", "2", "b", 1.0, "Euro", 1.0, "Euro", "ACH")
    kinds = "timestamp timestamp, from_bank string, from_acct string, to_bank string, to_acct string, amt_received double, recv_ccy string, amt_paid double, pay_ccy string, payment_format string"
    t = spark.createDataFrame([(i, *key, y) for i, y in ((10, 1), (11, 1), (12, 0))], f"txn_id long, {kinds}, is_laundering int")
    other = (*key[:5], 9.0, *key[6:])
    p = spark.createDataFrame([(0, "X", "", 0, *key), (1, "X", "", 0, *key), (2, "X", "", 0, *key), (3, "X", "", 0, *other)], f"attempt_id int, typology string, detail string, seq int, {kinds}")
    m = {r.attempt_id: r.txn_id for r in attempts.match(p, t).collect()}
    assert m == {0: 10, 1: 11, 2: 10, 3: None}


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "pay_ccy string, recv_ccy string, n long, rate double")


def test_rates_chain_and_apply(spark):
    p = pairs(spark, ("US Dollar", "Euro", 100, 0.8), ("Euro", "Yen", 80, 100.0))
    r = fx.chain(p)
    got = {x.currency: (round(x.usd_per_unit, 9), x.via, x.hops) for x in r.collect()}
    assert got == {"US Dollar": (1.0, "US Dollar", 0), "Euro": (1.25, "US Dollar", 1), "Yen": (0.0125, "Euro", 2)}
    t = spark.createDataFrame([(100.0, "Euro"), (1000.0, "Yen"), (5.0, "US Dollar")], "amt_paid double, pay_ccy string")
    assert sorted(round(x.amt_usd, 9) for x in fx.to_usd(t, r).collect()) == [5.0, 12.5, 125.0]
    with pytest.raises(ValueError, match="Gold"):
        fx.to_usd(t.union(spark.createDataFrame([(1.0, "Gold")], t.schema)), r)


def test_odd_rates_are_reported(spark):
    p = pairs(spark, ("US Dollar", "Euro", 100, 0.02), ("Euro", "Yen", 80, 100.0), ("US Dollar", "Yen", 60, 50.0))
    w = {(x.kind, x.subject) for x in fx.warnings(fx.chain(p), p).collect()}
    assert ("outside plausible range", "Euro") in w and ("missing", "Ruble") in w
    assert any(k == "off the chain" for k, _ in w)


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [("A" if rng.random() < 0.7 else "B", "C", 200.0, 200.0 * rng.choice([rng.random(), 0.5])) for _ in range(4001)]
    t = spark.createDataFrame(rows, "pay_ccy string, recv_ccy string, amt_paid double, amt_received double")
    for r in fx.pair_medians(t).collect():
        want = [x[3] / x[2] for x in rows if x[0] == r.pay_ccy]
        assert r.n == len(want) and r.rate == pytest.approx(statistics.median(want), abs=1e-15)


def test_settings(tmp_path):
    assert config.load().detectors.fan_windows_days == (1, 7) and config.load().dataset.transactions_file == "HI-Small_Trans.csv"
    (tmp_path / "c.yaml").write_text("seed: 7\ndataset: {name: LI-Small}\ndetectors: {fan_windows_days: [2]}\n")
    c = config.load(tmp_path / "c.yaml")
    assert (c.seed, c.dataset.patterns_file, c.detectors.fan_windows_days) == (7, "LI-Small_Patterns.txt", (2,))
    for text in ("nope: {}\n", "graph: {nope: 1}\n"):
        (tmp_path / "c.yaml").write_text(text)
        with pytest.raises(ValueError, match="nope"):
            config.load(tmp_path / "c.yaml")


def test_aliases_are_unique_and_stable():
    ids = [f"{b:03d}_{a}" for b in range(20) for a in range(1000, 1400)]
    a = names.aliases(ids)
    assert len(set(a.values())) == len(ids) and a == names.aliases(reversed(ids))
    assert all(len(x.split()) == 3 and x.split()[2].isdigit() for x in a.values())


def test_schema_names():
    assert len(schemas.RAW_NAMES) == 11 and schemas.KEY_COLUMNS[-1] == "payment_format"
