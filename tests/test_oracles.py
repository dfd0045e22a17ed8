"""Every query with SQL against DuckDB on the smallest tables; the others must run and return rows."""

import os
from pathlib import Path

import duckdb
import pytest

from veriset.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    out = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in out.fetchall())
