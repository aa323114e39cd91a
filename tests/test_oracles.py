"""Every query with SQL gives the same rows as DuckDB; every query runs."""

import math

import duckdb
import pytest

from segmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        at = [[d[0] for d in cur.description].index(c) for c in names]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
