"""Every canned screen in its report order, with the order as a column."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.ranks import numbered
from ..operators import screens as S
from ..sources.fixtures import AS_OF_ORDERS, fixture, with_fixtures
from .catalog import query
from .consensus import FIXTURES, SCREENS_CTE, screens

D = f"date '{AS_OF_ORDERS}'"

# screen -> (rows, columns, order: (column, falls)); ties go by the other columns
ORDERED = {
    "insider_buying_activity": ("q1", ["ticker", "relationship", "amount", "count", "trans_date"], [("ticker", 0), ("amount", 0)]),
    "insider_buying_activity_with_superinvestor": ("q2", ["ticker", "count", "total_amount"], [("ticker", 0)]),
    "custom_insider": ("q3", ["ticker", "date_filling", "total_value"], [("ticker", 0), ("date_filling", 0)]),
    "screen_bigbet": ("q4", ["ticker", "percent_owned", "count"], [("ticker", 0)]),
    "52week_lows": ("q5", ["ticker", "percent_owned"], [("ticker", 0)]),
    "13f_filing": ("weights", ["ticker", "fund_name", "weight"], [("fund_name", 0), ("weight", 1)]),
    "custom_screen": ("q7", ["ticker", "sector", "industry", "market_cap", "pe"], [("ticker", 0)]),
    "screen_magic": ("q8", ["ticker", "market_cap"], [("ticker", 0)]),
}


def _ordered_sql() -> str:
    ctes = f"""
, q2 as (select distinct ticker, count, total_amount from fx_super where date_insert = {D})
, q3 as (select ticker, date_filling, cast(sum(total_value) as bigint) as total_value from home where date_insert = {D} group by ticker, date_filling)
, q4 as (select distinct ticker, percent_owned, count from fx_bigbets where date_insert = {D})
, q5 as (select distinct ticker, percent_owned from fx_lows where date_insert = {D})
, q8 as (select distinct ticker, market_cap from fx_magic where date_insert = {D})
"""
    parts = []
    for name, (src, cols, order) in ORDERED.items():
        keys = [f"{c} {'desc nulls first' if d else 'asc nulls last'}" for c, d in order]
        keys += [f"{c} asc nulls last" for c in cols if c not in dict(order)]
        cells = ", ".join(f"coalesce(cast({'cast(weight as decimal(20,4))' if c == 'weight' else c} as varchar), '')" for c in cols)
        parts.append(f"select '{name}' as screen, row_number() over (order by {', '.join(keys)}) as nth, concat_ws('|', {cells}) as line from {src}")
    return with_fixtures([*FIXTURES, "fx_bigbets"], SCREENS_CTE + ctes + "\nunion all\n".join(parts))


@query("q_ordered_screens", _ordered_sql())
def q_ordered_screens(spark, sf_dir):
    """Every canned screen with the ordinal of each row in its report order.

    Numbering writes each screen once.  The writes need nothing of one another,
    so they are submitted side by side: the tasks of one fill the cores that the
    last tasks and small stages of another leave free."""
    sc = {**screens(spark, sf_dir), "bigbets": S.screen_bigbets(fixture(spark, sf_dir, "fx_bigbets"), AS_OF_ORDERS, sort=False)}
    frames = dict(zip(ORDERED, (sc[k] for k in ("insider", "superinvestor", "custom_insider", "bigbets", "week_low", "13f", "custom_screen", "magic"))))

    def placed(name):
        _, cols, order = ORDERED[name]
        keys = [F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in order]
        keys += [F.col(c).asc_nulls_last() for c in cols if c not in dict(order)]
        cells = [F.coalesce((F.col(c).cast("decimal(20,4)") if c == "weight" else F.col(c)).cast("string"), F.lit("")) for c in cols]
        return numbered(frames[name], keys, "place").select(F.lit(name).alias("screen"), (F.col("place") + 1).alias("nth"), F.concat_ws("|", *cells).alias("line"))

    with ThreadPoolExecutor(len(ORDERED)) as pool:
        # a copy of the caller's job properties for every thread
        jobs = [pool.submit(inheritable_thread_target(spark)(placed), name) for name in ORDERED]
        parts = [job.result() for job in jobs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
