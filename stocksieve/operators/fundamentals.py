"""Company fundamentals: financial statements, price history, holders,
insider roster and company metadata, with the per-ticker screens run
set-based (all tickers, or a semi-join to a ticker DataFrame) instead of
one query per ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import days_before
from ..functions.structs import conform, flatten, normalise_columns, union_evolving
from ..functions.text import normalise_name
from .screens import snapshot

STATEMENT_KEYS = ["symbol", "freq", "date", "date_insert"]


# ---------------------------------------------------------------- statements

MAX_NAME = 59


def item_names(long: DataFrame) -> DataFrame:
    """Dictionary of the line items of ``long``: ``(full, line_item, clashed)``.

    Names are normalised (lower case, ``_`` for spaces) and cut to 59
    characters.  Of the names that a cut makes equal the first in order keeps
    the cut one, the others end in their number, so no two items become one."""
    full = long.select(normalise_name("line_item", None).alias("full")).distinct()
    cut = F.substring("full", 1, MAX_NAME)
    nth = F.row_number().over(Window.partitionBy(cut).orderBy("full"))
    numbered = full.withColumn("nth", nth).withColumn("clashed", F.count("*").over(Window.partitionBy(cut)) > 1)
    marked = F.concat(F.substring("full", 1, MAX_NAME - 6), F.lit("_"), F.lpad("nth", 5, "0"))
    return numbered.select("full", F.when(F.col("nth") == 1, cut).otherwise(marked).alias("line_item"), "clashed")


def named_items(long: DataFrame) -> DataFrame:
    """``long`` with the names of ``item_names``.  Only names longer than the
    cut take the join; no other name can meet a different one."""
    full = normalise_name("line_item", None)
    rest = [c for c in long.columns if c != "line_item"]
    short = long.where(F.coalesce(F.length("line_item"), F.lit(0)) <= MAX_NAME).select(*rest, full.alias("line_item"))
    wide = long.where(F.length("line_item") > MAX_NAME)
    named = wide.withColumn("full", full).drop("line_item").join(item_names(long).drop("clashed"), "full")
    return short.unionByName(named.select(*rest, "line_item"))


def statement_wide(long: DataFrame, items: list[str]) -> DataFrame:
    """Long ``(symbol, freq, date, line_item, value, date_insert)`` ->
    one row per period with one column per line item (``named_items``); values
    are summed per cell and rounded to 2 places.  The item list is passed to
    ``pivot`` so no job runs to discover it; absent items give null columns,
    and the rows of items outside the list are ``unlisted_items``."""
    norm = long.select(*STATEMENT_KEYS, normalise_name("line_item").alias("line_item"), "value")
    return (norm.groupBy(*STATEMENT_KEYS).pivot("line_item", items)
                .agg(F.round(F.sum("value"), 2)))


def unlisted_items(long: DataFrame, items: list[str]) -> DataFrame:
    """Rows whose item the wide form has no column for."""
    return named_items(long).where(~F.coalesce(F.col("line_item").isin(items), F.lit(False)))


def statement_long(wide: DataFrame, items: list[str]) -> DataFrame:
    """Wide -> long, dropping empty cells."""
    present = [c for c in items if c in wide.columns]
    long = wide.unpivot(STATEMENT_KEYS, present, "line_item", "value")
    return long.where(F.col("value").isNotNull())


def in_order(*columns: str) -> list[Column]:
    """Ascending, nulls last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def _recent(df: DataFrame, as_of, date_col: str, days: int) -> DataFrame:
    return snapshot(df, as_of).where(F.col(date_col) > days_before(as_of, days))


def balance_sheet(wide: DataFrame, as_of, lookback_days: int = 1900) -> DataFrame:
    items = schemas.BALANCE_SHEET_ITEMS
    key_null = [F.col(c).isNull() for c in ("total_debt", "total_assets", "total_equity_gross_minority_interest")]
    return (_recent(wide, as_of, "date", lookback_days)
            .where(~(key_null[0] & key_null[1] & key_null[2]))
            .select("symbol", "date", *items).distinct()
            .orderBy(*in_order("symbol", "date")))


def cash_flow(wide: DataFrame, as_of, lookback_days: int = 1900) -> DataFrame:
    return (_recent(wide, as_of, "date", lookback_days)
            .dropna(how="any", subset=["free_cash_flow", "operating_cash_flow"])
            .select("symbol", "date", *schemas.CASH_FLOW_ITEMS).distinct()
            .orderBy(*in_order("symbol", "date")))


def income_statement(wide: DataFrame, as_of, lookback_days: int = 1000) -> DataFrame:
    return (_recent(wide, as_of, "date", lookback_days)
            .select("symbol", "date", *schemas.INCOME_ITEMS).distinct()
            .orderBy(*in_order("symbol", "date")))


# ---------------------------------------------------------------- two sources

STATEMENT_DOC = "map<string,map<string,double>>"


def parse_statement_docs(docs: DataFrame) -> DataFrame:
    """Landed statement JSON ``{item: {period: value}}`` per symbol and day ->
    ``(symbol, date_insert, line_item, date, value)``."""
    items = docs.select("symbol", "date_insert", F.explode(F.from_json("body", STATEMENT_DOC)).alias("line_item", "periods"))
    return items.select("symbol", "date_insert", "line_item", F.explode("periods").alias("date", "value")).withColumn("date", F.to_date("date"))


def align_statements(annual: DataFrame, quarterly: DataFrame) -> DataFrame:
    """The annual and the quarterly source of a statement side by side: one row
    per symbol, day and line item that either has, each source's periods in a
    map of their own (null where it lacks the item), as an outer alignment on
    the item.  A (symbol, day, item) has as many periods as days, no more."""
    keys = ["symbol", "date_insert", "line_item"]

    def periods(df: DataFrame, name: str) -> DataFrame:
        cells = df.groupBy(*keys, "date").agg(F.round(F.sum("value"), 2).alias("value"))
        return cells.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("date", "value")))).alias(name))

    return periods(annual, "annual").join(periods(quarterly, "quarterly"), keys, "full_outer")


def periods_of(aligned: DataFrame) -> DataFrame:
    """The aligned sources as one long statement, labelled by source."""
    def side(name: str) -> DataFrame:
        cells = aligned.select("symbol", "date_insert", "line_item", F.explode(name).alias("date", "value"))
        return cells.select("symbol", F.lit(name).alias("freq"), "date", "line_item", "value", "date_insert")
    return side("annual").unionByName(side("quarterly"))


# ---------------------------------------------------------------- market data

def money2(c: str) -> Column:
    """``ROUND(x::numeric, 2)``: exact decimal rounding, half away from zero."""
    return F.round(F.col(c).cast("decimal(38,10)"), 2).cast("double")


def price_history(history: DataFrame, as_of, lookback_days: int = 1000) -> DataFrame:
    h = conform(history, schemas.HISTORY)
    return (_recent(h, as_of, "date", lookback_days)
            .select("symbol", F.col("date").cast("date").alias("date"), money2("open").alias("open"),
                    money2("close").alias("close"), "volume", "dividends", "stock_splits")
            .distinct().orderBy(*in_order("symbol", "date")))


def combine_holders(mutual: DataFrame, institutional: DataFrame) -> DataFrame:
    """Mutual-fund and institutional holders in one table, tagged by type
    (the two sources have different columns)."""
    both = union_evolving([mutual.withColumn("type", F.lit("mutual")),
                           institutional.withColumn("type", F.lit("institutional"))])
    return conform(both, schemas.HOLDERS)


def holders(holders_table: DataFrame, as_of, lookback_days: int = 1000) -> DataFrame:
    """``value`` is returned as ``value_percentage`` (it is the dollar value
    of the position; the name is kept for compatibility)."""
    return (_recent(holders_table, as_of, "date_reported", lookback_days)
            .select("symbol", "date_reported", "holder", "type", F.col("value").alias("value_percentage"))
            .distinct().orderBy(*in_order("symbol", "date_reported")))


def insider_roster(roster: DataFrame, as_of, lookback_days: int = 365) -> DataFrame:
    r = conform(roster, schemas.INSIDER_ROSTER)
    return (_recent(r, as_of, "latest_transaction_date", lookback_days)
            .select("symbol", "name", "position", "most_recent_transaction", "latest_transaction_date",
                    "shares_owned_directly", "position_direct_date", "shares_owned_indirectly")
            .distinct())


# ---------------------------------------------------------------- metadata

# Fixed keys: removed from the history metadata, and looked up in the info
# document (missing key -> null).
METADATA_DROP_KEYS = ["currentTradingPeriod", "dataGranularity", "range", "validRanges"]
INFO_KEYS = ["website", "industry", "sector", "fullTimeEmployees", "auditRisk", "boardRisk",
             "compensationRisk", "shareHolderRightsRisk", "overallRisk", "irWebsite"]

HISTORY_METADATA_SCHEMA = (
    "struct<currency:string, symbol:string, exchangeName:string, fullExchangeName:string, "
    "instrumentType:string, firstTradeDate:bigint, regularMarketTime:bigint, hasPrePostMarketData:boolean, "
    "gmtoffset:bigint, timezone:string, exchangeTimezoneName:string, regularMarketPrice:double, "
    "fiftyTwoWeekHigh:double, fiftyTwoWeekLow:double, longName:string, shortName:string, "
    "currentTradingPeriod:struct<pre:struct<start:bigint,end:bigint>,regular:struct<start:bigint,end:bigint>>, "
    "dataGranularity:string, range:string, validRanges:array<string>>")
INFO_SCHEMA = ("struct<website:string, industry:string, sector:string, fullTimeEmployees:bigint, "
               "auditRisk:bigint, boardRisk:bigint, compensationRisk:bigint, shareHolderRightsRisk:bigint, "
               "overallRisk:bigint, irWebsite:string, longBusinessSummary:string>")


def metadata(history_docs: DataFrame, info_docs: DataFrame) -> DataFrame:
    """Landed history-metadata JSON + info JSON (both keyed by
    symbol and day) -> one typed metadata row per document: nested
    fields flattened, unwanted keys dropped, info keys attached by a left
    join (absent -> null), names normalised, schema conformed."""
    meta = history_docs.select(F.col("symbol").alias("of"), "date_insert",
                               F.from_json("body", HISTORY_METADATA_SCHEMA).alias("m"))
    meta = meta.withColumn("m", F.col("m").dropFields(*METADATA_DROP_KEYS))
    flat = flatten(meta.select("of", "date_insert", "m.*"))
    info = info_docs.select(F.col("symbol").alias("of"), "date_insert", F.from_json("body", INFO_SCHEMA).alias("i"))
    info = info.select("of", "date_insert", *[F.col("i").getField(k).alias(k) for k in INFO_KEYS])
    joined = flat.join(info, ["of", "date_insert"], "left").drop("of")
    return conform(normalise_columns(joined), schemas.METADATA)


def metadata_screen(meta: DataFrame, as_of) -> DataFrame:
    return (snapshot(meta, as_of)
            .select("symbol", "industry", "sector", "fulltimeemployees", "fullexchangename",
                    "exchangetimezonename", "instrumenttype", "irwebsite", "shortname")
            .distinct())
