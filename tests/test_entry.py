import json
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["fan_out", "pass_through", "cycles_3", "txn_features_7d", "scc", "money_flows", "average_precision", "typology_recall"]


def plain(x):
    return round(x, 7) + 0.0 if isinstance(x, float) else x.isoformat()[:19] if hasattr(x, "isoformat") else x


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60 and json.dumps(sorted(q))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "account"


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    df = entry.queries()[name](spark, str(DATA))
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want
