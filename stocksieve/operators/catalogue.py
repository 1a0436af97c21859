"""Named query catalogue.

Two forms, as in the screening pipeline's configuration: named screens over
snapshot tables (``run_screen``), and per-ticker queries (``run_ticker``).  A
per-ticker query is the set-based screen of ``fundamentals`` with the ticker as
a filter value on its table, so a ticker can never change the statement and the
filter reaches the scan; all tickers at once, or a semi-join to a ticker
DataFrame, is the same screen without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fundamentals as FU
from . import screens as S
from .adhoc import run_sql

__all__ = ["SCREENS", "TICKER_SCREENS", "run_screen", "run_sql", "run_ticker"]

SCREENS = {
    "insider_buying_activity": S.insider_buying_activity,
    "insider_buying_activity_with_superinvestor": S.superinvestor_buying,
    "custom_insider": S.custom_insider,
    "screen_bigbet": S.screen_bigbets,
    "52week_lows": S.week52_lows,
    "13f_filing": lambda holdings, as_of, cusip_map, **kw: S.thirteen_f_weights(holdings, cusip_map, as_of, **kw),
    "custom_screen": S.custom_screen,
    "screen_magic": S.magic_screen,
}

#: name -> (table, screen of the whole table)
TICKER_SCREENS: dict[str, tuple[str, Callable[[DataFrame, object], DataFrame]]] = {
    "yahoo_balance_sheet": ("balance_sheet", FU.balance_sheet),
    "yahoo_cash_flow": ("cash_flow", FU.cash_flow),
    "yahoo_stock_history": ("history", FU.price_history),
    "yahoo_holder": ("holders", FU.holders),
    "yahoo_income": ("income_statement", FU.income_statement),
    "yahoo_inside": ("insider_roster_holders", FU.insider_roster),
    "yahoo_meta": ("metadata", FU.metadata_screen),
}


def run_screen(name: str, table: DataFrame, as_of, **kw) -> DataFrame:
    """Run the named screen on its snapshot table (``13f_filing`` also takes
    ``cusip_map``)."""
    return SCREENS[name](table, as_of, **kw)


def run_ticker(name: str, tables: dict[str, DataFrame], symbol: str, as_of) -> DataFrame:
    """Run the named per-ticker query for one ticker over ``tables`` (by the
    table names of ``TICKER_SCREENS``)."""
    table, screen = TICKER_SCREENS[name]
    return screen(tables[table].where(F.col("symbol") == F.lit(symbol)), as_of).drop("symbol")
