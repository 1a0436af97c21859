"""Fundamentals screens (balance sheet, cash flow, income, price history,
holders, insider roster, metadata) over the fixture views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import fundamentals as FU
from ..sources import landing as L
from ..sources.fixtures import AS_OF_EVENTS, fixture, with_fixtures
from ..sources.tables import Tables
from .catalog import query

D = f"date '{AS_OF_EVENTS}'"

# Fixture stand-ins: which event type plays which statement line item
# (display names, normalised by the statement job).
STAND_INS = {
    "balance_sheet": {"click": "Total Debt", "view": "Total Assets", "purchase": "Total Equity Gross Minority Interest",
                      "signup": "Net Debt", "error": "Goodwill And Other Intangible Assets"},
    "cash_flow": {"signup": "Free Cash Flow", "error": "Operating Cash Flow", "click": "Capital Expenditure",
                  "view": "Change In Inventory", "purchase": "Stock Based Compensation"},
    "income_statement": {"purchase": "Total Revenue", "view": "Net Income", "error": "EBITDA", "click": "Gross Profit", "signup": "Tax Provision"},
}


def item_name(statement: str) -> Column:
    item = F.lit(None).cast("string")
    for k, v in STAND_INS[statement].items():
        item = F.when(F.col("line_item") == k, F.lit(v)).otherwise(item)
    return item


def statement_long_fixture(fx: DataFrame, statement: str) -> DataFrame:
    return fx.select("symbol", F.lit(statement).alias("statement"), "freq", "date",
                     item_name(statement).alias("line_item"), "value", "date_insert")


def statement_wide(spark, sf_dir, statement: str) -> DataFrame:
    long = statement_long_fixture(fixture(spark, sf_dir, "fx_statements"), statement)
    return FU.statement_wide(long, schemas.STATEMENT_ITEMS[statement])


def _case(statement: str) -> str:
    return "case line_item " + " ".join(f"when '{k}' then '{v}'" for k, v in STAND_INS[statement].items()) + " end"


def _wide_sql(statement: str, wide: str = "wide") -> str:
    cols = ",\n  ".join(f"round(sum(case when item = '{c}' then value end), 2) as {c}"
                        for c in schemas.STATEMENT_ITEMS[statement])
    return f"""
, {wide}_long as (
  select symbol, freq, date, date_insert, value, lower(replace({_case(statement)}, ' ', '_')) as item
  from fx_statements)
, {wide} as (
  select symbol, freq, date, date_insert,
  {cols}
  from {wide}_long group by symbol, freq, date, date_insert)
"""


def _cols(statement: str) -> str:
    return ", ".join(schemas.STATEMENT_ITEMS[statement])


@query("q_statement_wide", with_fixtures(["fx_statements"], _wide_sql("balance_sheet") + """
select * from wide"""))
def q_statement_wide(spark, sf_dir):
    return statement_wide(spark, sf_dir, "balance_sheet")


@query("q_statement_long", with_fixtures(["fx_statements"], _wide_sql("cash_flow") + f"""
select symbol, freq, date, date_insert, line_item, value from wide
unpivot (value for line_item in ({_cols('cash_flow')}))"""))
def q_statement_long(spark, sf_dir):
    return FU.statement_long(statement_wide(spark, sf_dir, "cash_flow"), schemas.CASH_FLOW_ITEMS)


@query("q_balance_sheet", with_fixtures(["fx_statements"], _wide_sql("balance_sheet") + f"""
select distinct symbol, date, {_cols('balance_sheet')} from wide
where date_insert = {D} and date > {D} - 1900
  and not (total_debt is null and total_assets is null and total_equity_gross_minority_interest is null)"""))
def q_balance_sheet(spark, sf_dir):
    return FU.balance_sheet(statement_wide(spark, sf_dir, "balance_sheet"), AS_OF_EVENTS)


@query("q_cash_flow", with_fixtures(["fx_statements"], _wide_sql("cash_flow") + f"""
select distinct symbol, date, {_cols('cash_flow')} from wide
where date_insert = {D} and free_cash_flow is not null and date > {D} - 1900
  and operating_cash_flow is not null"""))
def q_cash_flow(spark, sf_dir):
    return FU.cash_flow(statement_wide(spark, sf_dir, "cash_flow"), AS_OF_EVENTS)


@query("q_income", with_fixtures(["fx_statements"], _wide_sql("income_statement") + f"""
select distinct symbol, date, {_cols('income_statement')} from wide
where date_insert = {D} and date > {D} - 1000"""))
def q_income(spark, sf_dir):
    return FU.income_statement(statement_wide(spark, sf_dir, "income_statement"), AS_OF_EVENTS)


@query("q_price_history", with_fixtures(["fx_history"], f"""
select distinct symbol, date, cast(round(cast(open as decimal(38,10)), 2) as double) as open,
       cast(round(cast(close as decimal(38,10)), 2) as double) as close, volume,
       cast(null as double) as dividends, cast(null as double) as stock_splits
from fx_history where date_insert = {D} and date > {D} - 1000"""))
def q_price_history(spark, sf_dir):
    return FU.price_history(fixture(spark, sf_dir, "fx_history"), AS_OF_EVENTS)


HOLDERS_SQL = """
, holders as (
  select date_reported, holder, cast(null as double) as pctheld, shares, value, 'mutual' as type, symbol, date_insert
  from fx_holders_mutual
  union all
  select date_reported, holder, cast(pctheld as double), shares, value, 'institutional', symbol, date_insert
  from fx_holders_institutional)
"""


def holders_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return FU.combine_holders(fixture(spark, t, "fx_holders_mutual"), fixture(spark, t, "fx_holders_institutional"))


@query("q_holders_union", with_fixtures(["fx_holders_mutual", "fx_holders_institutional"], HOLDERS_SQL + """
select * from holders"""))
def q_holders_union(spark, sf_dir):
    return holders_table(spark, sf_dir)


@query("q_holders", with_fixtures(["fx_holders_mutual", "fx_holders_institutional"], HOLDERS_SQL + f"""
select distinct symbol, date_reported, holder, type, value as value_percentage
from holders where date_insert = {D} and date_reported > {D} - 1000"""))
def q_holders(spark, sf_dir):
    return FU.holders(holders_table(spark, sf_dir), AS_OF_EVENTS)


@query("q_insider_roster", with_fixtures(["fx_roster"], f"""
select distinct symbol, name, position, cast(null as varchar) as most_recent_transaction,
       latest_transaction_date, shares_owned_directly, cast(null as date) as position_direct_date,
       cast(null as double) as shares_owned_indirectly
from fx_roster where date_insert = {D} and latest_transaction_date > {D} - 365"""))
def q_insider_roster(spark, sf_dir):
    return FU.insider_roster(fixture(spark, sf_dir, "fx_roster"), AS_OF_EVENTS)


@query("q_metadata", with_fixtures(["fx_metadata"], f"""
select distinct symbol, industry, sector, fulltimeemployees, 'NasdaqGS' as fullexchangename,
       'America/New_York' as exchangetimezonename, 'EQUITY' as instrumenttype,
       cast(null as varchar) as irwebsite, 'Company ' || symbol as shortname
from fx_metadata where date_insert = {D}"""))
def q_metadata(spark, sf_dir):
    hist, info = L.metadata_docs(fixture(spark, sf_dir, "fx_metadata"))
    return FU.metadata_screen(FU.metadata(hist, info), AS_OF_EVENTS)


# ---------------------------------------------------------------- two sources of a statement

# items of the quarterly source that go by another name there
ALIGN_SQL = """
, cells as (
  select symbol, date_insert, freq, date,
         line_item || case when freq = 'quarterly' and line_item = 'signup' then ' (restated)'
                           when freq = 'annual' and line_item = 'error' then ' (audited)' else '' end as line_item,
         round(sum(value), 2) as value
  from fx_statements group by 1, 2, 3, 4, 5)
, sides as (
  select symbol, date_insert, line_item, freq, count(*) as n, cast(sum(cast(value as decimal(20,2))) as double) as total, max(date) as newest
  from cells group by 1, 2, 3, 4)
select coalesce(a.symbol, q.symbol) as symbol, coalesce(a.date_insert, q.date_insert) as date_insert, coalesce(a.line_item, q.line_item) as line_item,
       a.n as n_annual, q.n as n_quarterly, a.total as annual_total, q.total as quarterly_total, a.newest as newest_annual, q.newest as newest_quarterly
from (select * from sides where freq = 'annual') a
full outer join (select * from sides where freq = 'quarterly') q
  on a.symbol = q.symbol and a.date_insert = q.date_insert and a.line_item = q.line_item"""


def statement_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The annual and the quarterly source as landed documents."""
    fx = fixture(spark, sf_dir, "fx_statements")
    renamed = (F.when((F.col("freq") == "quarterly") & (F.col("line_item") == "signup"), " (restated)")
               .when((F.col("freq") == "annual") & (F.col("line_item") == "error"), " (audited)").otherwise(""))
    docs = L.statement_docs(fx.withColumn("line_item", F.concat("line_item", renamed)))
    return docs.where(F.col("freq") == "annual"), docs.where(F.col("freq") == "quarterly")


@query("q_statement_align", with_fixtures(["fx_statements"], ALIGN_SQL))
def q_statement_align(spark, sf_dir):
    annual, quarterly = (FU.parse_statement_docs(d) for d in statement_sources(spark, sf_dir))
    aligned = FU.align_statements(annual, quarterly)

    def total(side: str) -> Column:
        amounts = F.transform(F.map_values(side), lambda v: v.cast("decimal(20,2)"))
        return F.aggregate(amounts, F.lit(0).cast("decimal(30,2)"), lambda x, y: (x + F.coalesce(y, F.lit(0))).cast("decimal(30,2)")).cast("double")

    count = {side: F.when(F.col(side).isNotNull(), F.size(side).cast("bigint")) for side in ("annual", "quarterly")}
    return aligned.select("symbol", "date_insert", "line_item", *[count[x].alias(f"n_{x}") for x in count], *[total(x).alias(f"{x}_total") for x in count],
                          *[F.array_max(F.map_keys(x)).alias(f"newest_{x}") for x in count])


LONG_NAME = "Cash Flow From Continuing Operating Activities Before Working Capital Changes"

ITEMS_SQL = f"""
, named as (select '{LONG_NAME} ' || line_item as raw, value from fx_statements union all select line_item, value from fx_statements)
, full_names as (select lower(replace(raw, ' ', '_')) as full_name, count(*) as n, cast(sum(cast(round(value, 2) as decimal(20,2))) as double) as total from named group by 1)
, numbered as (select *, row_number() over (partition by substr(full_name, 1, 59) order by full_name) as nth,
                      count(*) over (partition by substr(full_name, 1, 59)) > 1 as clashed from full_names)
select case when nth = 1 then substr(full_name, 1, 59) else substr(full_name, 1, 53) || '_' || lpad(cast(nth as varchar), 5, '0') end as line_item,
       full_name as full, clashed, n, total
from numbered"""


@query("q_item_names", with_fixtures(["fx_statements"], ITEMS_SQL))
def q_item_names(spark, sf_dir):
    """Line items whose names are equal in their first 59 characters stay apart."""
    fx = fixture(spark, sf_dir, "fx_statements").select("line_item", "value")
    long = fx.select(F.concat(F.lit(LONG_NAME + " "), "line_item").alias("line_item"), "value").unionByName(fx)
    amounts = FU.named_items(long).groupBy("line_item").agg(
        F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(20,2)")).cast("double").alias("total"))
    return FU.item_names(long).join(amounts, "line_item")


# ---------------------------------------------------------------- all seven tables

def fundamentals_tables(spark, sf_dir) -> dict[str, DataFrame]:
    t = Tables(spark, sf_dir)
    return {
        "history": fixture(spark, t, "fx_history"),
        "metadata": FU.metadata(*L.metadata_docs(fixture(spark, t, "fx_metadata"))),
        "insider_roster_holders": fixture(spark, t, "fx_roster"),
        "holders": holders_table(spark, sf_dir),
        **{name: statement_wide(spark, t, name) for name in ("cash_flow", "balance_sheet", "income_statement")},
    }


TICKER_COLUMNS = {
    "yahoo_balance_sheet": ["date", *[c.lower().replace(" ", "_") for c in STAND_INS["balance_sheet"].values()]],
    "yahoo_cash_flow": ["date", *[c.lower().replace(" ", "_") for c in STAND_INS["cash_flow"].values()]],
    "yahoo_stock_history": ["date", "open", "close", "volume"],
    "yahoo_holder": ["date_reported", "holder", "type", "value_percentage"],
    "yahoo_income": ["date", *[c.lower().replace(" ", "_") for c in STAND_INS["income_statement"].values()]],
    "yahoo_inside": ["name", "position", "latest_transaction_date"],
    "yahoo_meta": ["industry", "sector", "fulltimeemployees", "fullexchangename", "instrumenttype", "shortname"],
}
MONEY = {c for n in ("yahoo_balance_sheet", "yahoo_cash_flow", "yahoo_income") for c in TICKER_COLUMNS[n][1:]} | {"open", "close"}
_TICKER_FROM = {
    "yahoo_balance_sheet": f"""(select distinct symbol, date, {_cols('balance_sheet')} from wide_b where date_insert = {D} and date > {D} - 1900
        and not (total_debt is null and total_assets is null and total_equity_gross_minority_interest is null))""",
    "yahoo_cash_flow": f"""(select distinct symbol, date, {_cols('cash_flow')} from wide_c where date_insert = {D} and date > {D} - 1900
        and free_cash_flow is not null and operating_cash_flow is not null)""",
    "yahoo_stock_history": f"""(select distinct symbol, date, round(cast(open as decimal(38,10)), 2) as open, round(cast(close as decimal(38,10)), 2) as close, volume
        from fx_history where date_insert = {D} and date > {D} - 1000)""",
    "yahoo_holder": f"""(select distinct symbol, date_reported, holder, type, value as value_percentage from holders
        where date_insert = {D} and date_reported > {D} - 1000)""",
    "yahoo_income": f"(select distinct symbol, date, {_cols('income_statement')} from wide_i where date_insert = {D} and date > {D} - 1000)",
    "yahoo_inside": f"(select distinct symbol, name, position, latest_transaction_date from fx_roster where date_insert = {D} and latest_transaction_date > {D} - 365)",
    "yahoo_meta": f"""(select distinct symbol, industry, sector, fulltimeemployees, 'NasdaqGS' as fullexchangename, 'EQUITY' as instrumenttype,
        'Company ' || symbol as shortname from fx_metadata where date_insert = {D})""",
}


def _line(columns: list[str]) -> str:
    text = [f"cast({c} as decimal(20,2))" if c in MONEY else c for c in columns]
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({t} as varchar), '')" for t in text) + ")"


TICKER_LINES_SQL = (_wide_sql("balance_sheet", "wide_b") + _wide_sql("cash_flow", "wide_c") + _wide_sql("income_statement", "wide_i")
                    + "\nunion all\n".join(f"select '{n}' as query, {_line(c)} as line from {_TICKER_FROM[n]} x where symbol = 'O'" for n, c in TICKER_COLUMNS.items()))
