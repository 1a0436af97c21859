"""Parse landed bodies into typed snapshot tables, then clean and roll up.

All parsing is row-local (regex + array functions on each landed body), so
it runs map-side with no shuffle; the only shuffles are the roll-ups and
de-duplications, which aggregate partially before exchanging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.dates import home_filing_date, parse_day_month_year, text_date
from ..functions.markup import first_href, let
from ..functions.text import (dash_part, one_line, parse_count, parse_number,
                              strip_ws, title_case, trimmed)
from .landing import INFO_TABLE_SUMMARY, INSIDER_COLUMNS, SCREENER_TABLE_CLASS, SITE, index_page_url

# Fixed relationship abbreviations, applied in this order after title-casing.
RELATIONSHIP_REPLACEMENTS = [
    ("Chief Accounting Officer", "CAO"),
    ("Chief Financial Officer", "CFO"),
    ("Chief Executive Officer", "CEO"),
    ("Chief Operating Officer", "COO"),
    ("See Remark", "Other"),
]

INSIDER_KEYS = ["symbol", "relationship", "trans_date", "purchase_sale", "price", "security",
                "reporting_name", "di"]

HOLDING_COLUMNS = ["name_of_issuer", "title_of_class", "cusip", "figi", "value", "prn_amt", "prn",
                   "put_call", "discretion", "manager", "voting_sole", "voting_shared", "voting_none"]
HOLDING_INT_COLUMNS = ["value", "prn_amt", "voting_sole", "voting_shared", "voting_none"]

SCREENER_COLUMNS = ["index", "ticker", "company", "sector", "industry", "country", "market_cap",
                    "pe", "volume", "price", "change"]


# ---------------------------------------------------------------- tables

def table_rows(pages: DataFrame, table: Column, keep: list[str], skip_header: int = 1) -> DataFrame:
    """One row per ``<tr>`` of ``table`` (a Column holding a table body),
    dropping the first ``skip_header`` rows, with the ``td`` texts in
    ``cells``."""
    # cells are read before the explode, so a filter on them finds them computed
    rest = F.slice(H.rows(table), skip_header + 1, 1 << 30)
    return pages.select(*keep, F.explode_outer(F.transform(rest, lambda r: H.cells(r))).alias("cells")).where(F.col("cells").isNotNull())


def name_cells(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Positional naming: cell i becomes column ``names[i]``."""
    return df.select(*keep, *[F.get("cells", i).alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------- insider trades

def parse_insider_pages(pages: DataFrame) -> DataFrame:
    """Listing pages -> raw text rows (third table, header skipped)."""
    rows = table_rows(pages, H.nth_table("html", 2), ["date_insert"])
    return name_cells(rows, INSIDER_COLUMNS, ["date_insert"])


def abbreviate_relationship(rel: Column) -> Column:
    out = title_case(rel)
    for old, new in RELATIONSHIP_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_insider(raw: DataFrame) -> DataFrame:
    """Typed trades: non-empty symbol, relationship title-cased and
    abbreviated, ``Purchase`` -> ``Buy``, numbers parsed, ``count = 1``."""
    return (raw.where(F.col("symbol") != "")
            .select(
                "symbol", "security", "reporting_name",
                abbreviate_relationship(F.col("relationship")).alias("relationship"),
                parse_day_month_year("trans_date").alias("trans_date"),
                F.replace(F.col("purchase_sale"), F.lit("Purchase"), F.lit("Buy")).alias("purchase_sale"),
                "price",
                parse_count("amount").alias("amount"),
                parse_count("shares").alias("shares"),
                "di",
                F.lit(1).alias("count"),
                "date_insert"))


def rollup_insider(clean: DataFrame) -> DataFrame:
    """One row per snapshot day and trade key with summed amount, shares
    and trade count.  Rows with a null key are dropped (they form no group
    in the source)."""
    keys = ["date_insert", *INSIDER_KEYS]
    return (clean.dropna(subset=keys).groupBy(*keys)
            .agg(F.sum("amount").alias("amount"), F.sum("shares").alias("shares"),
                 F.sum("count").cast("int").alias("count")))


# ---------------------------------------------------------------- home page tables

def home_cells(pages: DataFrame) -> DataFrame:
    """Every table of the home pages in one pass: ``(date_insert, ordinal,
    cells)``, header rows skipped."""
    # outer: Spark evaluates the array of a plain explode again, as a filter
    tables = pages.select("date_insert", F.posexplode_outer(H.tables("html")).alias("ordinal", "table"))
    rows = tables.select("date_insert", "ordinal", F.posexplode_outer(H.rows("table")).alias("pos", "tr"))
    return rows.where(F.col("pos") >= 1).select("date_insert", "ordinal", H.cells("tr").alias("cells"))


def home_table(pages: DataFrame, ordinal: int, names: list[str]) -> DataFrame:
    """One table of the home pages, or of their ``home_cells``."""
    if "cells" in pages.columns:
        rows = pages.where(F.col("ordinal") == ordinal).select("date_insert", "cells")
    else:
        rows = table_rows(pages, H.nth_table("html", ordinal), ["date_insert"])
    return name_cells(rows, names, ["date_insert"])


def parse_home_insider(pages: DataFrame, roll_year: bool = False) -> DataFrame:
    """Home insider table -> ticker, company, filing day, value, price,
    summed per snapshot and key."""
    raw = home_table(pages, 0, ["date_filling", "company", "total_value", "price"])
    typed = raw.select(
        "date_insert",
        dash_part("company", 0).alias("ticker"),
        dash_part("company", 1).alias("company"),
        parse_count("total_value").alias("total_value"),
        home_filing_date("date_filling", F.col("date_insert"), roll_year=roll_year).alias("date_filling"),
        "price")
    return (typed.groupBy("date_insert", "ticker", "date_filling", "company", "price")
            .agg(F.sum("total_value").alias("total_value")))


def _ticker_company(raw: DataFrame, rest: list[str]) -> DataFrame:
    return raw.select("date_insert", dash_part("company", 0).alias("ticker"),
                      dash_part("company", 1).alias("company"), *rest)


def parse_bigbets(pages: DataFrame) -> DataFrame:
    return _ticker_company(home_table(pages, 2, ["company", "percent_owned", "count"]), ["percent_owned", "count"])


def parse_lows(pages: DataFrame) -> DataFrame:
    return _ticker_company(home_table(pages, 3, ["company", "percent_owned"]), ["percent_owned"])


def parse_super(pages: DataFrame) -> DataFrame:
    raw = home_table(pages, 4, ["company", "count", "total_amount"])
    return _ticker_company(raw, ["count", "total_amount"])


# ---------------------------------------------------------------- screeners

def parse_screener(pages: DataFrame, width: int = len(SCREENER_COLUMNS)) -> DataFrame:
    """Flat cell list of the classed table, cut into rows of ``width``
    cells; the leading index column is dropped.  A short last chunk is
    kept with ``complete = false`` (see ``quarantine``)."""
    flat = F.transform(H.tag_bodies(H.table_with_class("html", SCREENER_TABLE_CLASS), "td"), H.cell_text)
    # outer: Spark evaluates the array of a plain explode again, as a filter
    rows = pages.select("date_insert", F.explode_outer(H.chunks(flat, width)).alias("cells")).where(F.col("cells").isNotNull())
    named = rows.select("date_insert", (F.size("cells") == width).alias("complete"),
                        *[F.get("cells", i).alias(n) for i, n in enumerate(SCREENER_COLUMNS)])
    return named.drop("index")


def quarantine(df: DataFrame, flag: str = "complete") -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, bad) on a boolean flag column."""
    return df.where(F.col(flag)).drop(flag), df.where(~F.col(flag)).drop(flag)


def parse_magic(pages: DataFrame) -> DataFrame:
    """Second ``tbody``: company, ticker, market cap per row."""
    body = F.get(H.tag_bodies(H.strip_noise("html"), "tbody"), 1)
    rows = table_rows(pages, body, ["date_insert"], skip_header=0)
    return name_cells(rows, ["company", "ticker", "market_cap"], ["date_insert"])


# ---------------------------------------------------------------- 13F filings

FILING_INDEX_SCHEMA = ("struct<cik:string, filings:struct<recent:struct<form:array<string>, "
                       "accessionNumber:array<string>, filingDate:array<string>>>>")


def parse_filing_index(docs: DataFrame) -> DataFrame:
    """Filing-index JSON (parallel arrays) -> one row per filing."""
    j = F.from_json("body", FILING_INDEX_SCHEMA)
    zipped = docs.select(j.alias("j")).select(
        F.col("j.cik").alias("cik"),
        F.explode(F.arrays_zip(F.col("j.filings.recent.form").alias("form"),
                               F.col("j.filings.recent.accessionNumber").alias("accession_number"),
                               F.col("j.filings.recent.filingDate").alias("filing_date"))).alias("f"))
    return zipped.select("cik", F.col("f.form").alias("form"), F.col("f.accession_number").alias("accession_number"),
                         F.to_date(F.col("f.filing_date")).alias("filing_date"))


def parse_cik_lists(docs: DataFrame) -> DataFrame:
    """JSON arrays of CIK strings -> distinct CIKs (kept as padded text)."""
    return docs.select(F.explode(F.from_json("body", "array<string>")).alias("cik")).distinct()


def latest_filing(filings: DataFrame, form: str = "13F-HR") -> DataFrame:
    """Newest filing of exactly ``form`` per CIK (amendments excluded).
    ``max`` over a struct is a partial aggregate, so a CIK with very many
    filings never has to be ranked in one task."""
    newest = (filings.where(F.col("form") == form)
              .groupBy("cik")
              .agg(F.max(F.struct("filing_date", "accession_number")).alias("m")))
    return newest.select("cik", F.col("m.accession_number").alias("accession_number"),
                         F.col("m.filing_date").alias("filing_date"))


def info_table_url(index_pages: DataFrame) -> DataFrame:
    return index_pages.select("cik", "accession_number", info_table_link(F.col("html")).alias("url"))


def info_table_link(html: Column, base: str = SITE) -> Column:
    """Link of the row mentioning "information table" in the ``tableFile``
    table of a filing's index page; null when the row, its link or the table is
    absent."""
    rows = H.rows(H.table_with_class(html, "tableFile"))
    # match on the row's visible text (markup and attribute values excluded)
    hit = F.filter(rows, lambda r: F.lower(H.cell_text(r)).contains("information table"))
    return F.concat(F.lit(base), first_href(F.get(hit, 0)))


def parse_holdings(raw: DataFrame) -> DataFrame:
    """Landed information-table rows -> typed holdings.

    13 cells are taken as they are; 12 cells lack the FIGI column, which is
    added as null.  Other widths go to quarantine (``ok = false``).  Cells
    read ``'None'`` are null, line breaks become spaces, integer columns are
    parsed leniently (bad -> null) and a comma list in ``value`` is
    exploded, keeping a null ``value`` row."""
    n = F.size("cells")
    idx = {c: i for i, c in enumerate(HOLDING_COLUMNS)}
    figi = idx["figi"]
    narrow = F.concat(F.slice("cells", 1, figi), F.array(F.lit(None).cast("string")), F.slice("cells", figi + 1, len(HOLDING_COLUMNS) - figi - 1))

    # one expression for all cells, not one a column: less code a row, and most
    # cells need no step but the look that tells so
    def tidy(c: Column) -> Column:
        line = let(one_line(c), lambda x: F.when(trimmed(x), x).otherwise(strip_ws(x)))
        return F.when(c != "None", F.when(c.rlike(r"\A[!-~](?:[^\n]*[!-~])?\z"), c).otherwise(line))

    clean = F.transform(F.when(n == 13, F.col("cells")).otherwise(narrow), tidy)
    read = raw.select("fund_name", "date_insert", text_date("filing_date").alias("trans_date"), n.isin(12, 13).alias("ok"), clean.alias("clean"))
    typed = read.select("fund_name", "date_insert", "trans_date", "ok", *[F.get("clean", i).alias(c) for c, i in idx.items()])
    # digits in groups of three are one number; any other comma text is a list
    whole = F.btrim("value").rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]*)?$")
    values = F.when(whole, F.array("value")).otherwise(F.split("value", ","))
    typed = typed.withColumn("value", F.explode_outer(values))
    numbers = F.transform(F.array(*HOLDING_INT_COLUMNS), lambda c: parse_number(F.trim(c)))
    return typed.withColumn("numbers", numbers).select(
        "ok", *[F.get("numbers", HOLDING_INT_COLUMNS.index(c)).alias(c) if c in HOLDING_INT_COLUMNS else F.col(c)
                for c in HOLDING_COLUMNS],
        "trans_date", "date_insert", "fund_name")


def clean_holdings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed de-duplicated holdings, quarantined rows)."""
    return split_holdings(parse_holdings(raw))


def split_holdings(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed holdings -> (those of a known width, de-duplicated, the others)."""
    good, bad = quarantine(parsed, "ok")
    return good.dropDuplicates(), bad


# row schema of a real information table (fixed names of the filing format)
INFO_XML_SCHEMA = ("struct<infoTable:array<struct<nameOfIssuer:string, titleOfClass:string, cusip:string, figi:string, value:string, "
                   "shrsOrPrnAmt:struct<sshPrnamt:string, sshPrnamtType:string>, putCall:string, investmentDiscretion:string, otherManager:string, "
                   "votingAuthority:struct<Sole:string, Shared:string, None:string>>>>")


def info_xml_rows(body: Column) -> Column:
    """A real XML information table -> its rows as 13 landed cells."""
    r = F.from_xml(body, INFO_XML_SCHEMA, {"ignoreNamespace": "true"})
    paths = ["nameOfIssuer", "titleOfClass", "cusip", "figi", "value", "shrsOrPrnAmt.sshPrnamt", "shrsOrPrnAmt.sshPrnamtType", "putCall",
             "investmentDiscretion", "otherManager", "votingAuthority.Sole", "votingAuthority.Shared", "votingAuthority.None"]

    def cell(x: Column, path: str) -> Column:
        for name in path.split("."):
            x = x[name]
        return x

    return F.transform(r["infoTable"], lambda x: F.array(*[cell(x, p) for p in paths]))


def info_html_rows(body: Column, header_rows: int = 3) -> Column:
    """An information table landed as HTML -> its rows as landed cells (12 or
    13), header rows skipped."""
    rows = H.rows(H.table_with_attr(body, "summary", INFO_TABLE_SUMMARY))
    rows = F.slice(rows, header_rows + 1, F.greatest(F.size(rows), F.lit(1)))
    return F.transform(rows, lambda r: F.transform(H.cells(r), lambda c: F.nullif(c, F.lit(""))))


def info_rows(body: Column) -> Column:
    """Rows of an information table in either form."""
    return F.when(body.contains("<informationTable"), info_xml_rows(body)).otherwise(info_html_rows(body))


def filing_holdings(filings: DataFrame, site: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filing chain: ``filings (cik, accession_number, filing_date)`` ->
    their index pages -> the link in each -> the information table -> holdings
    (typed rows, and the rows of other widths).

    ``site (url, kind, body)`` is everything landed.  Bodies are fetched by
    joining addresses, and only what a join kept is parsed: an index page of a
    wanted filing, a table that such a page links to."""
    def fetched(wanted: DataFrame, kind: str) -> DataFrame:
        pages = site.where(F.col("kind") == kind).select(F.col("url").alias("page_url"), "body")
        return wanted.join(pages, F.col("url") == F.col("page_url")).drop("url", "page_url")

    wanted = filings.select("cik", "accession_number", "filing_date", index_page_url(F.col("cik"), F.col("accession_number")).alias("url"))
    # exploded (outer), not selected: a filter on a plain expression of the body,
    # and the one Spark infers for a plain explode, would run below the join, on
    # every body of the site
    ids = ["cik", "accession_number", "filing_date"]
    linked = fetched(wanted, "index").select(*ids, F.explode_outer(F.array(info_table_link(F.col("body")))).alias("url")).where(F.col("url").isNotNull())
    tables = fetched(linked, "table").select(*ids, F.explode_outer(info_rows(F.col("body"))).alias("cells")).where(F.col("cells").isNotNull())
    day = F.date_format("filing_date", "yyyy-MM-dd")
    raw = tables.select(F.concat_ws(" ", "cik", "accession_number").alias("fund_name"), day.alias("filing_date"), F.col("filing_date").alias("date_insert"), "cells")
    good, bad = clean_holdings(raw)

    def named(df: DataFrame) -> DataFrame:
        ids = F.split("fund_name", " ")
        return df.select(F.get(ids, F.lit(0)).alias("cik"), F.get(ids, F.lit(1)).alias("accession_number"), *HOLDING_COLUMNS, "trans_date")

    return named(good), named(bad)


# ---------------------------------------------------------------- typed inputs

def clean_insider_typed(typed: DataFrame) -> DataFrame:
    """Same cleaning as ``clean_insider`` for trades that arrive already
    typed (dates and numbers parsed)."""
    return (typed.where(F.col("symbol") != "")
            .select("symbol", "security", "reporting_name",
                    abbreviate_relationship(F.col("relationship")).alias("relationship"),
                    "trans_date",
                    F.replace(F.col("purchase_sale"), F.lit("Purchase"), F.lit("Buy")).alias("purchase_sale"),
                    "price", F.col("amount").cast("bigint").alias("amount"),
                    F.col("shares").cast("bigint").alias("shares"), "di",
                    F.lit(1).alias("count"), "date_insert"))


def home_insider_typed(typed: DataFrame) -> DataFrame:
    """Home insider rows with ISO text dates -> the screen_insider table."""
    return (typed.select("date_insert", dash_part("company", 0).alias("ticker"),
                         dash_part("company", 1).alias("company"),
                         F.col("date_filling").cast("date").alias("date_filling"),
                         parse_count("total_value").alias("total_value"), "price")
            .groupBy("date_insert", "ticker", "date_filling", "company", "price")
            .agg(F.sum("total_value").alias("total_value")))


def parse_info_table(docs: DataFrame, header_rows: int = 3) -> DataFrame:
    """Information-table documents -> landed cell rows: the first table
    whose summary attribute marks the holdings table, the three header
    rows skipped, cell texts in order (12 or 13 per row)."""
    table = H.table_with_attr("html", "summary", INFO_TABLE_SUMMARY)
    return table_rows(docs, table, ["fund_name", "filing_date", "date_insert"], skip_header=header_rows)
