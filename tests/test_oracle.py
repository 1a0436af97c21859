"""Every registered query against its DuckDB oracle on the smallest
tables (the driver runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from stocksieve.plans import ORACLES, QUERIES
from stocksieve.sources.tables import DRIVER_TABLES, table_path

from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{table_path(SMALL, t)}')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(ORACLES)
    assert not missing, f"queries without SQL oracle: {sorted(missing)}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    o_cols, o_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert canon(s_cols, s_rows) == canon(o_cols, o_rows)
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    o_types = {d[0]: str(d[1]) for d in cur.description}
    assert {c: types.get(t, t) for c, t in df.dtypes} == o_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ticker", "fund_name", "weight"]
    assert df.count() >= 0
