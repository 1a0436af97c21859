"""The canned screens over daily snapshot tables.

Every screen takes the snapshot table(s) and an explicit ``as_of`` day and
reads only that day's snapshot (``date_insert = as_of``, a partition filter
when the table is partitioned by ``date_insert``).  ``distinct`` is part of
each screen: it is what makes a same-day re-run harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, days_before
from ..functions.joins import share_of_total
from ..functions.text import pg_initcap, pg_left

# Length of the filing suffix cut from a landed fund name
# (" - 13F-HR Q3 filing x" style tail), fixed by the source format.
FUND_SUFFIX_LEN = 21
LOOKBACK_13F_DAYS = 60


def _ordered(df: DataFrame, cols: list, sort: bool) -> DataFrame:
    """Apply the report order only when the caller wants an ordered result
    (feeding a union/aggregate, the order would be wasted work)."""
    return df.orderBy(*cols) if sort else df


def snapshot(df: DataFrame, as_of) -> DataFrame:
    """Rows of the ``as_of`` snapshot only."""
    return df.where(F.col("date_insert") == as_date(as_of))


def fund_display_name(raw) -> "F.Column":
    """``initcap(trim(left(name, length(name) - 21)))`` with PostgreSQL
    meanings of ``left`` and ``initcap``."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return pg_initcap(F.trim(pg_left(raw, F.length(raw) - FUND_SUFFIX_LEN)))


def thirteen_f_weights(holdings: DataFrame, cusip_map: DataFrame, as_of,
                       lookback_days: int = LOOKBACK_13F_DAYS, sort: bool = True) -> DataFrame:
    """Portfolio weight of each ticker in each fund, in percent of the
    fund's summed per-ticker maximum share count.

    Grouping is by the *raw* fund name while the share denominator is per
    *display* name, so two raw spellings of one fund share a denominator.
    """
    recent = (snapshot(holdings, as_of)
              .where(F.col("trans_date") > days_before(as_of, lookback_days))
              .select("cusip", "fund_name", "prn_amt"))
    # the scan's size in bytes decides on a broadcast, by Spark's own threshold
    per_pair = (recent.join(cusip_map.select("cusip", "ticker"), "cusip", "inner")
                .groupBy("ticker", "fund_name")
                .agg(F.max("prn_amt").alias("max_prn_amt"))
                .withColumn("fund_name", fund_display_name("fund_name")))
    weighted = share_of_total(per_pair, ["fund_name"], "max_prn_amt", "weight", digits=4)
    return _ordered(weighted.select("ticker", "fund_name", "weight"),
                    [F.col("fund_name").asc_nulls_last(), F.col("weight").desc_nulls_first()], sort)


def insider_buying_activity(insider_rollup: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(insider_rollup, as_of)
            .select(F.col("symbol").alias("ticker"), "relationship", "amount", "count",
                    F.col("trans_date").cast("date").alias("trans_date"))
            .distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last(), F.col("amount").asc_nulls_last()], sort)))


def superinvestor_buying(insider_super: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(insider_super, as_of)
            .select("ticker", "count", "total_amount").distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last()], sort)))


def custom_insider(screen_insider: DataFrame, as_of, sort: bool = True) -> DataFrame:
    """Per ticker and filing day, the summed insider value.  Sum happens
    before ``distinct`` (as in the source query), so the input must already
    be de-duplicated per snapshot -- the snapshot writer overwrites a day's
    partition instead of appending twice."""
    return (snapshot(screen_insider, as_of)
            .groupBy("ticker", F.col("date_filling").cast("date").alias("date_filling"))
            .agg(F.sum(F.col("total_value").try_cast("bigint")).alias("total_value"))
            # the source's DISTINCT is implied: group keys are in the output
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last(), F.col("date_filling").asc_nulls_last()], sort)))


def screen_bigbets(bigbets: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(bigbets, as_of).select("ticker", "percent_owned", "count").distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last()], sort)))


def week52_lows(lows: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(lows, as_of).select("ticker", "percent_owned").distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last()], sort)))


def custom_screen(finviz: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(finviz, as_of)
            .select("ticker", "sector", "industry", "market_cap", "pe").distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last()], sort)))


def magic_screen(magic: DataFrame, as_of, sort: bool = True) -> DataFrame:
    return (snapshot(magic, as_of).select("ticker", "market_cap").distinct()
            .transform(lambda d: _ordered(d, [F.col("ticker").asc_nulls_last()], sort)))
