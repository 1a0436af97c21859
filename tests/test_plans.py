"""Plan-shape checks: pushdown and pruning reach the scan, partition
filters prune snapshot reads, no Python evaluation on any query path."""

import pathlib

import pytest
from pyspark.sql import functions as F

import stocksieve

from stocksieve.plans import QUERIES
from stocksieve.sources.fixtures import FIXTURE_SQL, fixture
from stocksieve.sources.snapshots import SnapshotStore
from stocksieve.sources.tables import Tables

from .conftest import SMALL


def plan_text(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_13f_scan_pruning(spark):
    plan = plan_text(QUERIES["q_13f_weights"](spark, SMALL))
    # only the lineitem columns the fixture needs are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
    assert "BroadcastHashJoin" in plan


def test_no_view_leaves_rows_out():
    """No fixture filters its table, and none samples it."""
    for name, text in FIXTURE_SQL.items():
        assert " where " not in f" {text.lower()} ".replace("\n", " "), name


def test_views_keep_every_row(spark):
    t = Tables(spark, SMALL)
    same = {"fx_cusip_map": "part", "fx_sec_13f": "lineitem", "fx_filings": "orders", "fx_edgar_filings": "orders", "fx_edgar_holdings": "lineitem",
            "fx_insider": "orders", "fx_home_insider": "lineitem", "fx_super": "supplier", "fx_bigbets": "part", "fx_lows": "part", "fx_finviz": "part",
            "fx_magic": "part", "fx_statements": "events", "fx_holders_mutual": "supplier", "fx_holders_institutional": "customer", "fx_roster": "customer",
            "fx_metadata": "supplier"}
    for name, table in same.items():
        assert fixture(spark, t, name).count() == t.get(table).count(), name
    assert set(FIXTURE_SQL) - set(same) == {"fx_history"}  # days of a company
    assert fixture(spark, t, "fx_history").agg(F.sum("volume")).first()[0] == t.events.count()


def test_no_row_count_decides_a_plan():
    """No query counts rows to choose a broadcast, none takes a plan by size."""
    source = "".join(p.read_text() for p in pathlib.Path(stocksieve.__file__).parent.rglob("*.py") if "llm" not in p.parts)
    assert "broadcast_if_small" not in source


def test_filing_chain_joins_before_it_parses(spark):
    """Bodies are joined by address below the projection that parses them."""
    df = QUERIES["q_13f_holdings_chain"](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-|"))
    parsed = next(i for i, x in enumerate(lines) if "from_xml" in x.lower() or "XmlToStructs" in x or "infoTable" in x)
    joins = [i for i, x in enumerate(lines) if "Join Inner" in x]
    assert len(joins) == 2 and all(i > parsed and depth(i) > depth(parsed) for i in joins)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation(spark, name):
    df = QUERIES[name](spark, SMALL)
    plan = plan_text(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonUDF"):
        assert node not in plan, f"{name} evaluates Python ({node})"


def test_snapshot_read_prunes_partitions(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    df = spark.createDataFrame([(1,)], "x int")
    store.write("t", df, "2024-01-01")
    store.write("t", df, "2024-01-02")
    plan = plan_text(store.read("t", "2024-01-02"))
    assert "PartitionFilters: [isnotnull(date_insert" in plan and "2024-01-02" in plan
    assert "Location: InMemoryFileIndex" in plan


def test_snapshot_read_merges_no_footers(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    store.write("t", spark.createDataFrame([(1,)], "x long"), "2024-01-01")
    store.write("t", spark.createDataFrame([(1, "a")], "x long, y string"), "2024-01-02")
    assert store.versions("t") == [1, 2]
    read = store.read("t")
    assert [(r.x, r.y) for r in read.orderBy("date_insert").collect()] == [(1, None), (1, "a")]
    options = read._jdf.queryExecution().analyzed().toString()
    assert "mergeSchema" not in options and store.schema("t") == read.schema


def test_screens_read_only_needed_columns(spark):
    plan = plan_text(QUERIES["q_magic_screen"](spark, SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan
