"""Every registered query of the library's own operators against its SQL in DuckDB, over whole tables."""

import decimal
import os

import duckdb
import pytest

from talkmill.plans import own_queries

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = own_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
    if name in ORACLES:
        said = duck.execute(ORACLES[name])
        names = [c[0] for c in said.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in said.fetchall())
