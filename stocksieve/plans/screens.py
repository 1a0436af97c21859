"""Screens Q2, Q4-Q8 over the typed snapshot fixtures (Q1 and Q3 are in
``plans.ingest`` because they read tables the ingest jobs build)."""

from __future__ import annotations

from ..operators import screens as S
from ..sources.fixtures import AS_OF_ORDERS, fixture, with_fixtures
from ..sources.tables import Tables
from . import duck
from .catalog import query

D = f"date '{AS_OF_ORDERS}'"


WEIGHTS_CTE = f"""
, pairs as (
  select cm.ticker, s.fund_name, max(s.prn_amt) as mx
  from fx_sec_13f s join fx_cusip_map cm on s.cusip = cm.cusip
  where s.trans_date > {D} - 60 and s.date_insert = {D}
  group by cm.ticker, s.fund_name)
, named as (select ticker, {duck.fund_name('fund_name')} as fund_name, mx from pairs)
, weights as (
  select ticker, fund_name,
         cast(round(mx * 100.0 / sum(mx) over (partition by fund_name), 4) as double) as weight
  from named)
"""


@query("q_13f_weights", with_fixtures(["fx_sec_13f", "fx_cusip_map"], WEIGHTS_CTE + "select * from weights"))
def q_13f_weights(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.thirteen_f_weights(fixture(spark, t, "fx_sec_13f"), fixture(spark, t, "fx_cusip_map"), AS_OF_ORDERS)


@query("q_superinvestor", with_fixtures(["fx_super"], f"""
select distinct ticker, count, total_amount from fx_super where date_insert = {D}"""))
def q_superinvestor(spark, sf_dir):
    return S.superinvestor_buying(fixture(spark, sf_dir, "fx_super"), AS_OF_ORDERS)


@query("q_bigbets", with_fixtures(["fx_bigbets"], f"""
select distinct ticker, percent_owned, count from fx_bigbets where date_insert = {D}"""))
def q_bigbets(spark, sf_dir):
    return S.screen_bigbets(fixture(spark, sf_dir, "fx_bigbets"), AS_OF_ORDERS)


@query("q_week_lows", with_fixtures(["fx_lows"], f"""
select distinct ticker, percent_owned from fx_lows where date_insert = {D}"""))
def q_week_lows(spark, sf_dir):
    return S.week52_lows(fixture(spark, sf_dir, "fx_lows"), AS_OF_ORDERS)


@query("q_custom_screen", with_fixtures(["fx_finviz"], f"""
select distinct ticker, sector, industry, market_cap, pe from fx_finviz where date_insert = {D}"""))
def q_custom_screen(spark, sf_dir):
    return S.custom_screen(fixture(spark, sf_dir, "fx_finviz"), AS_OF_ORDERS)


@query("q_magic_screen", with_fixtures(["fx_magic"], f"""
select distinct ticker, market_cap from fx_magic where date_insert = {D}"""))
def q_magic_screen(spark, sf_dir):
    return S.magic_screen(fixture(spark, sf_dir, "fx_magic"), AS_OF_ORDERS)
