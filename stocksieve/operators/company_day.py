"""One day of company fundamentals: landed documents -> seven tables -> store.

A fetch lands one document per company and kind.  Documents are staged once, a
directory a kind, so each table's parse reads its own bodies only.  Tables are
written by key: a company fetched again replaces its own rows of the day in
every table, a company whose fetch came back empty loses them, and all others
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import shared_path
from ..sources.snapshots import SnapshotStore
from . import fundamentals as FU

STATEMENTS = ("cash_flow", "balance_sheet", "income_statement")
TABLES = ("history", "metadata", "insider_roster_holders", "holders", *STATEMENTS)
PREFIX = "yahoofinance_"  # of the table names in the store

BAR = "struct<date:date, open:double, high:double, low:double, close:double, volume:bigint, dividends:double, stock_splits:double>"
HOLDER = "struct<date_reported:date, holder:string, pctheld:double, shares:bigint, value:bigint>"
INSIDER = ("struct<name:string, position:string, url:string, most_recent_transaction:string, latest_transaction_date:date, "
           "shares_owned_directly:double, position_direct_date:date, shares_owned_indirectly:double>")


def staged_documents(docs: DataFrame) -> DataFrame:
    """``(symbol, date_insert, kind, body)`` written once, a directory a kind."""
    path = shared_path(docs.sparkSession, "landing", "companies", unique=True)
    docs.select("symbol", "date_insert", "body", "kind").write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema("symbol string, date_insert date, body string, kind string").parquet(path)


def company_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of staged documents."""
    def kind(name: str) -> DataFrame:
        return docs.where(F.col("kind") == name).select("symbol", "date_insert", "body")

    def rows(name: str, row: str) -> DataFrame:
        parsed = kind(name).select("symbol", "date_insert", F.explode(F.from_json("body", f"array<{row}>")).alias("r"))
        return parsed.select("symbol", "date_insert", "r.*")

    tables = {
        "history": FU.conform(rows("history", BAR), schemas.HISTORY),
        "metadata": FU.metadata(kind("history_metadata"), kind("info")),
        "insider_roster_holders": FU.conform(rows("insider_roster", INSIDER), schemas.INSIDER_ROSTER),
        "holders": FU.combine_holders(rows("mutual_holders", HOLDER), rows("institutional_holders", HOLDER)),
    }
    for name in STATEMENTS:
        annual, quarterly = (FU.parse_statement_docs(kind(f"{name}_{freq}")) for freq in ("annual", "quarterly"))
        tables[name] = FU.statement_wide(FU.periods_of(FU.align_statements(annual, quarterly)), schemas.STATEMENT_ITEMS[name])
    return tables


def write_companies(store: SnapshotStore, docs: DataFrame, fetched: DataFrame, as_of) -> None:
    """Store a day's fetch: ``fetched (symbol)`` lists the companies asked for,
    ``docs`` (staged) what came."""
    today = docs.where(F.col("date_insert") == F.lit(str(as_of)).cast("date"))
    for name, table in company_tables(today).items():
        store.replace_keys(PREFIX + name, table, fetched.select("symbol"), as_of)
