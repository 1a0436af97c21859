"""Fixture views: typed snapshot tables derived from the driver tables.

The screening pipeline lands data from outside sources (fund filings,
insider-trade listings, screeners, fundamentals).  Here those tables are
derived from the TPC-H-style driver tables so that they grow with the scale
factor.  Each view is one SQL statement that runs unchanged in Spark SQL
and DuckDB; Spark binds the driver tables as DataFrame parameters, the
oracle uses the same text as a CTE over DuckDB's pre-registered views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

# Snapshot days the fixtures are built around (two snapshots per table).
AS_OF_ORDERS = "1998-06-01"
AS_OF_EVENTS = "2024-01-31"

# A ticker is its key in letters, one for each digit, so tickers are as many as
# their keys.
TICKER_LETTERS = "ETAONIRSHD"


def ticker_sql(key: str) -> str:
    return f"translate(cast({key} as string), '0123456789', '{TICKER_LETTERS}')"


# Fixed fixture definitions (test inputs, identical in both engines).  Every row
# of a table is a row of its views: what a view needs (a matching key, a day in
# its window) is made from the row's key, no row is left out.  ``@ticker(x)``
# stands for ``ticker_sql``; ``row_key`` tells rows apart.
FIXTURE_SQL: dict[str, str] = {
    "fx_cusip_map": """
select case when p_partkey % 4 = 0 then concat('X', lpad(cast(p_partkey as string), 9, '0'))
            else lpad(cast(p_partkey as string), 9, '0') end as cusip,
       @ticker(p_partkey) as ticker
from {part}""",
    "fx_sec_13f": """
select upper(concat('issuer ', cast(l_partkey as string))) as name_of_issuer,
       lpad(cast(l_partkey as string), 9, '0') as cusip,
       cast(floor(l_extendedprice) as bigint) as value,
       cast(l_quantity as bigint) as prn_amt,
       concat('  ', lower(n_name), ' cap-partners 3m', ' - 13F-HR Q3 filing x') as fund_name,
       case when cast(l_shipdate as date) <= date '1998-06-01' then cast(l_shipdate as date)
            else date '1998-06-01' - cast(l_orderkey % 400 as int) end as trans_date,
       case when l_linenumber % 4 = 0 then date '1998-05-31' else date '1998-06-01' end as date_insert,
       l_orderkey * 8 + l_linenumber as row_key
from {lineitem}
join {supplier} on l_suppkey = s_suppkey
join {nation} on s_nationkey = n_nationkey""",
    "fx_filings": """
select lpad(cast(o_custkey as string), 10, '0') as cik,
       lpad(cast(o_orderkey as string), 10, '0') as accession_number,
       cast(o_orderdate as date) as filing_date,
       case when o_orderkey % 5 = 0 then '13F-HR/A' when o_orderkey % 7 = 0 then '10-K' else '13F-HR' end as form
from {orders}""",
    "fx_edgar_filings": """
select lpad(cast(o_custkey as string), 10, '0') as cik,
       concat(lpad(cast(o_custkey as string), 10, '0'), '-', substr(cast(cast(o_orderdate as date) as string), 3, 2), '-',
              lpad(cast(o_orderkey as string), 10, '0')) as accession_number,
       cast(o_orderdate as date) as filing_date,
       case when o_orderkey % 5 = 0 then '13F-HR/A' when o_orderkey % 7 = 0 then '10-K' else '13F-HR' end as form,
       o_orderkey as filing_key
from {orders}""",
    "fx_edgar_holdings": """
select l_orderkey as filing_key,
       upper(concat('issuer ', cast(l_partkey as string))) as name_of_issuer,
       lpad(cast(l_partkey as string), 9, '0') as cusip,
       cast(floor(l_extendedprice) as bigint) as value,
       cast(l_quantity as bigint) as prn_amt
from {lineitem}""",
    "fx_insider": """
select case when o_orderkey % 50 = 0 then '' else @ticker(o_custkey) end as symbol,
       c_name as security,
       concat('Person ', cast(o_custkey % 40 as string)) as reporting_name,
       case c_mktsegment when 'BUILDING' then 'chief executive officer'
                         when 'MACHINERY' then 'chief financial officer'
                         when 'FURNITURE' then 'see remarks'
                         when 'HOUSEHOLD' then '10% owner/director'
                         else 'co-chief operating officer' end as relationship,
       case when cast(o_orderdate as date) <= date '1998-06-01' then cast(o_orderdate as date)
            else date '1998-06-01' - cast(o_orderkey % 400 as int) end as trans_date,
       case when o_orderstatus = 'P' then 'Purchase' else 'Sale' end as purchase_sale,
       cast(o_custkey % 90 as string) as price,
       cast(floor(o_totalprice) as bigint) as amount,
       o_orderkey % 1000 as shares,
       case when o_orderkey % 2 = 0 then 'D' else 'I' end as di,
       case when o_orderkey % 4 = 0 then date '1998-05-31' else date '1998-06-01' end as date_insert,
       o_orderkey as row_key
from {orders}
join {customer} on o_custkey = c_custkey""",
    "fx_home_insider": """
select concat(@ticker(l_partkey), ' - ', s_name) as company,
       cast(date '1998-05-01' + cast((l_orderkey + l_linenumber) % 32 as int) as string) as date_filling,
       cast(cast(floor(l_extendedprice) as bigint) as string) as total_value,
       cast(l_linenumber as string) as price,
       case when l_linenumber % 4 = 0 then date '1998-05-31' else date '1998-06-01' end as date_insert,
       l_orderkey * 8 + l_linenumber as row_key
from {lineitem}
join {supplier} on l_suppkey = s_suppkey""",
    "fx_super": """
select concat(@ticker(s_suppkey * 3), ' - ', s_name) as company,
       @ticker(s_suppkey * 3) as ticker,
       cast(s_suppkey % 9 as string) as count,
       concat('$', cast(cast(floor(abs(s_acctbal)) as bigint) as string)) as total_amount,
       case when s_suppkey % 5 = 0 then date '1998-05-31' else date '1998-06-01' end as date_insert,
       s_suppkey as row_key
from {supplier}""",
    "fx_bigbets": """
select @ticker(p_partkey * 3) as ticker, p_name as company,
       concat(cast(p_size as string), '%') as percent_owned,
       cast(p_size % 9 as string) as count,
       date '1998-06-01' as date_insert, p_partkey as row_key
from {part}""",
    "fx_lows": """
select @ticker(p_partkey * 2) as ticker, p_name as company,
       concat(cast(p_size as string), '%') as percent_owned,
       date '1998-06-01' as date_insert, p_partkey as row_key
from {part}""",
    "fx_finviz": """
select @ticker(case when p_partkey % 10 = 1 then p_partkey - 1 else p_partkey end) as ticker, p_name as company,
       p_type as sector, p_brand as industry, 'USA' as country,
       concat(cast(cast(floor(p_retailprice) as bigint) as string), 'M') as market_cap,
       cast(p_size as string) as pe,
       case when p_partkey % 6 = 0 then date '1998-05-31' else date '1998-06-01' end as date_insert,
       p_partkey as row_key
from {part}""",
    "fx_magic": """
select p_name as company, @ticker(p_partkey * 5) as ticker,
       cast(cast(floor(p_retailprice) as bigint) as string) as market_cap,
       date '1998-06-01' as date_insert, p_partkey as row_key
from {part}""",
    "fx_statements": """
select @ticker(user_id) as symbol,
       case when event_id % 2 = 0 then 'annual' else 'quarterly' end as freq,
       cast(ts as date) as date, event_type as line_item, value,
       case when event_id % 4 = 0 then date '2024-01-30' else date '2024-01-31' end as date_insert
from {events}""",
    "fx_history": """
select @ticker(user_id) as symbol, cast(ts as date) as date,
       min_by(value, ts) as open, max(value) as high, min(value) as low,
       max_by(value, ts) as close, count(*) as volume,
       date '2024-01-31' as date_insert
from {events}
group by user_id, cast(ts as date)""",
    "fx_holders_mutual": """
select date '2024-01-01' - cast(s_suppkey % 90 as int) as date_reported, s_name as holder,
       s_suppkey * 10 as shares, cast(floor(abs(s_acctbal)) as bigint) as value,
       @ticker(s_suppkey) as symbol,
       date '2024-01-31' as date_insert
from {supplier}""",
    "fx_holders_institutional": """
select date '2024-01-01' - cast(c_custkey % 1500 as int) as date_reported, c_name as holder,
       c_custkey * 10 as shares, cast(floor(abs(c_acctbal)) as bigint) as value,
       (c_custkey % 100) / 100.0 as pctheld,
       @ticker(c_custkey) as symbol,
       date '2024-01-31' as date_insert
from {customer}""",
    "fx_roster": """
select c_name as name, c_mktsegment as position,
       date '2024-01-31' - cast(c_custkey % 700 as int) as latest_transaction_date,
       cast(c_custkey as double) as shares_owned_directly,
       @ticker(c_custkey) as symbol,
       date '2024-01-31' as date_insert
from {customer}""",
    "fx_metadata": """
select @ticker(s_suppkey) as symbol, n_name as industry,
       r_name as sector, s_suppkey * 7 as fulltimeemployees,
       date '2024-01-31' as date_insert
from {supplier}
join {nation} on s_nationkey = n_nationkey
join {region} on n_regionkey = r_regionkey""",
}
FIXTURE_SQL = {name: re.sub(r"@ticker\(([^()]*)\)", lambda m: ticker_sql(m.group(1)), text) for name, text in FIXTURE_SQL.items()}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def tables_of(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def fixture(spark: SparkSession, sf_dir: str | Tables, name: str) -> DataFrame:
    """The fixture view ``name`` as a lazy Spark DataFrame."""
    tables = sf_dir if isinstance(sf_dir, Tables) else Tables(spark, sf_dir)
    args = {t: tables.get(t) for t in tables_of(name)}
    return spark.sql(FIXTURE_SQL[name], **args)


def duckdb_text(name: str) -> str:
    """Fixture text for DuckDB (driver tables are views of the same name)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[name])


def with_fixtures(names: list[str], body: str) -> str:
    """Prefix an oracle query with the fixture views it reads as CTEs."""
    ctes = ",\n".join(f"{n} as ({duckdb_text(n)}\n)" for n in names)
    return f"with {ctes}\n{body}"
