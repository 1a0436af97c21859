"""Landed source bodies, derived by Spark from the typed fixtures.

The pipeline's real inputs are web pages, JSON filing indexes and 13F
information tables fetched elsewhere and landed as text.  These renderers
produce such landing tables from the fixture views, so the parsers in
``ingest`` can be checked by round trip against the typed fixture (the
oracle side).  A page holds the rows of a range of row keys, so its size has a
bound whatever the rows' values are, and no row count is needed to lay it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import escape, render_row

INSIDER_COLUMNS = ["filing", "symbol", "security", "reporting_name", "relationship", "trans_date",
                   "purchase_sale", "shares", "price", "amount", "di"]

# Class attribute of the screener's result table (fixed value of the source page).
SCREENER_TABLE_CLASS = "styled-table-new is-rounded is-tabular-nums w-full screener_table"
# Summary attribute of the 13F information table (fixed value of the source format).
INFO_TABLE_SUMMARY = "Form 13F-NT Header Information"
# Cells of its widest row.
MOST_CELLS = 13


SITE = "https://www.sec.gov"


def index_page_url(cik: Column, accession_number: Column) -> Column:
    """Address of a filing's index page (its folder is the accession number
    without dashes)."""
    folder = F.replace(accession_number, F.lit("-"), F.lit(""))
    return F.concat(F.lit(f"{SITE}/Archives/edgar/data/"), cik, F.lit("/"), folder, F.lit("/"), accession_number, F.lit("-index.htm"))


def page_of(rows_per_page: int, key: str = "row_key") -> Column:
    """Page number: the place of the row's key range."""
    return F.floor(F.col(key) / rows_per_page).cast("bigint")


def _pages(rows: DataFrame, key_cols: list[str], body: str = "row_html") -> DataFrame:
    """Concatenate rendered rows per page key (order inside a page is free)."""
    return rows.groupBy(*key_cols).agg(F.array_join(F.collect_list(body), "").alias("rows_html"))


def _table(rows_html: Column, header: list[str], attrs: str = "") -> Column:
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    return F.concat(F.lit(f"<table{attrs}>{head}"), F.coalesce(rows_html, F.lit("")), F.lit("</table>"))


def _fmt_int(x: Column) -> Column:
    """1234567 -> '1,234,567' (input is integral, so no rounding applies)."""
    return F.format_number(x.cast("bigint"), 0)


def insider_pages(fx_insider: DataFrame, rows_per_page: int = 100) -> DataFrame:
    """Insider-trade listing pages: third table holds 11 text cells per
    trade, dates as ``d MMM yyyy`` and amounts with thousands separators."""
    cells = [
        F.date_format("trans_date", "d MMM yyyy"), F.col("symbol"), F.col("security"),
        F.col("reporting_name"), F.col("relationship"), F.date_format("trans_date", "d MMM yyyy"),
        F.col("purchase_sale"), _fmt_int(F.col("shares")), F.col("price"), _fmt_int(F.col("amount")),
        F.col("di"),
    ]
    rows = fx_insider.select("date_insert", page_of(rows_per_page).alias("page"), render_row(cells).alias("row_html"))
    pages = _pages(rows, ["date_insert", "page"])
    here, after = (F.concat(F.lit("/m/ins/ins.php?L="), F.lpad((F.col("page") + k).cast("string"), 6, "0")) for k in (1, 2))
    # links in every order and quote, in divs of their own, one twice
    nav = F.concat(F.lit("<div class='top'><a href=\"/m/home.php\">Home</a></div><div class=\"nav\" id='pages'><div class=\"now\"><a href=\""), here,
                   F.lit("\">this</a></div><div><a class='next' href='"), after, F.lit("'>next</a><a href="), after,
                   F.lit(">&gt;</a></div></div><div><a href='/m/foot.php'>Foot</a></div>"))
    html = F.concat(
        F.lit("<html><head><script>var t='<table>';</script></head><body>"), nav,
        F.lit("<table id=\"menu\"><tr><td>Menu</td></tr></table>"),
        F.lit("<!-- <table><tr><td>old</td></tr></table> -->"),
        F.lit("<table id=\"legend\"><tr><td>D: direct</td><td>I: indirect</td></tr></table>"),
        _table(F.col("rows_html"), [c.replace("_", " ").title() for c in INSIDER_COLUMNS], ' id="grid"'),
        F.lit("</body></html>"))
    return pages.select("date_insert", "page", html.alias("html"))


def home_pages(fx_home_insider: DataFrame, fx_bigbets: DataFrame, fx_lows: DataFrame,
               fx_super: DataFrame, rows_per_page: int = 50) -> DataFrame:
    """Home pages with five tables: 0 insider buys (``dd MMM`` or ``Today``),
    1 filler, 2 big bets, 3 52-week lows, 4 super-investor buys.  Company
    cells read ``TICK - Name``."""
    day = F.col("date_insert")
    home = fx_home_insider.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        render_row([
            F.when(F.col("date_filling").cast("date") == day, F.lit("Today"))
             .otherwise(F.date_format(F.col("date_filling").cast("date"), "dd MMM")),
            F.col("company"), _fmt_int(F.col("total_value").cast("bigint")), F.col("price"),
        ]).alias("row_html"))
    big = fx_bigbets.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        render_row([F.concat_ws(" - ", "ticker", "company"), F.col("percent_owned"), F.col("count")]).alias("row_html"))
    low = fx_lows.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        render_row([F.concat_ws(" - ", "ticker", "company"), F.col("percent_owned")]).alias("row_html"))
    sup = fx_super.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        render_row([F.col("company"), F.col("count"), F.col("total_amount")]).alias("row_html"))

    def part(df: DataFrame, name: str) -> DataFrame:
        return _pages(df, ["date_insert", "page"]).withColumnRenamed("rows_html", name)

    joined = (part(home, "t0").join(part(big, "t2"), ["date_insert", "page"], "full_outer")
              .join(part(low, "t3"), ["date_insert", "page"], "full_outer")
              .join(part(sup, "t4"), ["date_insert", "page"], "full_outer"))
    html = F.concat(
        F.lit("<html><body>"),
        _table(F.col("t0"), ["Date", "Company", "Value", "Price"]),
        _table(F.lit("<tr><td>news</td></tr>"), ["News"]),
        _table(F.col("t2"), ["Company", "% Owned", "Owners"]),
        _table(F.col("t3"), ["Company", "% Owned"]),
        _table(F.col("t4"), ["Company", "Buys", "Amount"]),
        F.lit("</body></html>"))
    return joined.select("date_insert", "page", html.alias("html"))


def screener_pages(fx_finviz: DataFrame, rows_per_page: int = 20) -> DataFrame:
    """Screener result pages: one classed table whose ``td`` cells, read in
    order, are 11 per row (leading row index first)."""
    rows = fx_finviz.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        F.concat(F.lit("<tr>"), *[
            F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>")) for c in [
                F.lit("1"), F.col("ticker"), F.col("company"), F.col("sector"), F.col("industry"),
                F.col("country"), F.col("market_cap"), F.col("pe"), F.lit("-"), F.lit("-"), F.lit("-")]],
            F.lit("</tr>")).alias("row_html"))
    pages = _pages(rows, ["date_insert", "page"])
    html = F.concat(F.lit("<html><body><table class=\"header\"><tr><td>Screener</td></tr></table>"),
                    F.lit(f'<table class="{SCREENER_TABLE_CLASS}">'), F.col("rows_html"),
                    F.lit("</table></body></html>"))
    return pages.select("date_insert", "page", html.alias("html"))


def magic_pages(fx_magic: DataFrame, rows_per_page: int = 30) -> DataFrame:
    """Screening result pages: the second ``tbody`` lists company, ticker,
    market cap."""
    rows = fx_magic.select(
        "date_insert", page_of(rows_per_page).alias("page"),
        render_row([F.col("company"), F.col("ticker"), F.col("market_cap")]).alias("row_html"))
    pages = _pages(rows, ["date_insert", "page"])
    html = F.concat(F.lit("<html><body><table><tbody><tr><td>Login</td></tr></tbody></table>"),
                    F.lit("<table><thead><tr><th>Company</th></tr></thead><tbody>"), F.col("rows_html"),
                    F.lit("</tbody></table></body></html>"))
    return pages.select("date_insert", "page", html.alias("html"))


def holdings_cells(fx_sec_13f: DataFrame) -> DataFrame:
    """13F information-table rows as landed text cells, with the filing's
    fund name and filing date beside them.  Odd share counts come 13 wide
    (with FIGI), even ones 12 wide; some cells are ``'None'`` and some
    issuer names contain line breaks."""
    none = F.lit("None")
    issuer = F.when(F.col("value") % 3 == 0, F.replace(F.col("name_of_issuer"), F.lit(" "), F.lit("\n"))) \
              .otherwise(F.col("name_of_issuer"))
    value = F.when(F.col("value") % 10 == 0, none).otherwise(F.col("value").cast("string"))
    head = [issuer, F.lit("COM"), F.col("cusip")]
    tail = [value, F.col("prn_amt").cast("string"), F.lit("SH"), none, F.lit("SOLE"), none,
            F.col("prn_amt").cast("string"), F.lit("0"), none]
    wide = F.array(*head, F.concat(F.lit("BBG"), F.col("cusip")), *tail)
    narrow = F.array(*head, *tail)
    return fx_sec_13f.select(
        "fund_name", F.date_format("trans_date", "yyyy-MM-dd").alias("filing_date"), "date_insert", "row_key",
        F.when(F.col("prn_amt") % 2 == 1, wide).otherwise(narrow).alias("cells"))


def filing_index_json(fx_filings: DataFrame, filings_per_page: int = 50_000) -> DataFrame:
    """Per CIK, filing year and key range, a filing-index document whose
    ``filings.recent`` holds parallel arrays (newest first)."""
    # a document lists the filings of a range of accession numbers
    block = F.floor(F.substring_index("accession_number", "-", -1).cast("bigint") / filings_per_page).alias("block")
    grouped = (fx_filings.groupBy("cik", F.year("filing_date").alias("year"), block)
               .agg(F.sort_array(F.collect_list(F.struct(
                   F.col("filing_date"), F.col("accession_number"), F.col("form"))), asc=False).alias("f")))
    recent = F.struct(
        F.transform("f", lambda x: x["form"]).alias("form"),
        F.transform("f", lambda x: x["accession_number"]).alias("accessionNumber"),
        F.transform("f", lambda x: F.date_format(x["filing_date"], "yyyy-MM-dd")).alias("filingDate"))
    doc = F.struct(F.col("cik"), F.struct(recent.alias("recent")).alias("filings"))
    return grouped.select("cik", "year", F.to_json(doc).alias("body"))


def _index_page(cik: Column, accession_number: Column, key: Column) -> Column:
    """Filing index page: a ``tableFile`` table whose row mentioning the
    information table links to it; every third filing has no such row.  The
    class is one token of several, quotes and the order of attributes vary."""
    folder = F.concat(F.lit("/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accession_number, F.lit("-"), F.lit("")), F.lit("/"))
    plain, mixed = '<table class="tableFile" summary="Document Format Files">', "<TABLE summary='Document Format Files' class='wide tableFile x'>"
    head = F.when(key % 2 == 0, plain).otherwise(mixed)
    link = F.when(key % 4 < 2, F.concat(F.lit('<a href="'), folder, F.lit('infotable.xml">'))) \
            .otherwise(F.concat(F.lit("<a id='i>2' class=doc HREF='"), folder, F.lit("infotable.xml'>")))
    info = F.concat(F.lit("<tr><td>2</td><td>INFORMATION TABLE</td><td>"), link, F.lit("infotable.xml</a></td><td>INFORMATION TABLE</td></tr>"))
    primary = F.concat(F.lit("<tr><td>1</td><td>Primary doc</td><td><a href=\""), folder, F.lit("primary.xml\">primary.xml</a></td><td>13F-HR</td></tr>"))
    return F.concat(F.lit("<html><body>"), head, F.lit("<tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr>"),
                    primary, F.when(key % 3 != 0, info).otherwise(F.lit("")), F.lit("</table></body></html>"))


def filing_index_pages(fx_filings: DataFrame) -> DataFrame:
    acc = F.col("accession_number")
    return fx_filings.select("cik", "accession_number", _index_page(F.col("cik"), acc, acc.cast("bigint")).alias("html"))


def edgar_site(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """``(url, kind, body)`` of everything the filing site serves: the index
    page of every filing and the information table of each that has holdings,
    as XML for filings of even key, else as an HTML table (issuer names with
    markup characters, numbers with thousands separators)."""
    cik, acc, key = F.col("cik"), F.col("accession_number"), F.col("filing_key")
    index = filings.select(index_page_url(cik, acc).alias("url"), F.lit("index").alias("kind"), _index_page(cik, acc, key).alias("body"))
    name = F.concat("name_of_issuer", F.lit(" & Co <A>"))
    amount, shares = F.col("value").cast("string"), F.col("prn_amt").cast("string")

    def x(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), escape(value), F.lit(f"</{tag}>"))

    xml = F.concat(
        F.lit("<infoTable>"), x("nameOfIssuer", name), x("titleOfClass", F.lit("COM")), x("cusip", F.col("cusip")),
        F.when(F.col("prn_amt") % 2 == 1, x("figi", F.concat(F.lit("BBG"), "cusip"))).otherwise(F.lit("")), x("value", amount),
        F.lit("<shrsOrPrnAmt>"), x("sshPrnamt", shares), F.lit("<sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt>"),
        F.lit("<investmentDiscretion>SOLE</investmentDiscretion><votingAuthority>"), x("Sole", shares), F.lit("<Shared>0</Shared><None>0</None></votingAuthority></infoTable>"))
    cells = [name, F.lit("COM"), F.col("cusip"), F.when(F.col("prn_amt") % 2 == 1, F.concat(F.lit("BBG"), "cusip")), _fmt_int(F.col("value")), _fmt_int(F.col("prn_amt")),
             F.lit("SH"), F.lit(""), F.lit("SOLE"), F.lit(""), shares, F.lit("0"), F.lit("0")]
    # a filing lists the lines of one order
    rows = holdings.groupBy("filing_key").agg(F.array_join(F.collect_list(F.when(key % 2 == 0, xml).otherwise(render_row(cells))), "").alias("rows"))
    table = F.when(key % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><informationTable>'), "rows", F.lit("</informationTable>"))).otherwise(
        F.concat(F.lit(f"<html><body><table summary='{INFO_TABLE_SUMMARY}' border=0><tr><td>COLUMN 1</td></tr><tr><td>NAME OF ISSUER</td></tr><tr><td>(x$1000)</td></tr>"),
                 "rows", F.lit("</table></body></html>")))
    tables = rows.join(filings.select("filing_key", "cik", "accession_number"), "filing_key").select(
        F.regexp_replace(index_page_url(cik, acc), "[^/]+$", "infotable.xml").alias("url"), F.lit("table").alias("kind"), table.alias("body"))
    return index.unionByName(tables)


def cik_lists(customer: DataFrame) -> DataFrame:
    """Fund lists as landed JSON arrays of zero-padded CIK strings, one
    document per nation and block of 1000 keys (the listed funds are the
    BUILDING segment)."""
    return (customer.where(F.col("c_mktsegment") == "BUILDING")
            .groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("block"))
            .agg(F.to_json(F.collect_list(F.lpad(F.col("c_custkey").cast("string"), 10, "0"))).alias("body")))


def metadata_docs(fx_metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per company, a nested history-metadata JSON document and a flat
    company-info JSON document (some info keys absent), for its symbol and day."""
    period = F.struct(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")).alias("pre"),
                      F.struct(F.lit(3).alias("start"), F.lit(4).alias("end")).alias("regular"))
    hist = F.struct(
        F.lit("USD").alias("currency"), F.col("symbol"), F.lit("NMS").alias("exchangeName"),
        F.lit("NasdaqGS").alias("fullExchangeName"), F.lit("EQUITY").alias("instrumentType"),
        F.lit("America/New_York").alias("exchangeTimezoneName"),
        F.concat(F.lit("Company "), F.col("symbol")).alias("shortName"),
        period.alias("currentTradingPeriod"), F.lit("1d").alias("dataGranularity"),
        F.lit("max").alias("range"), F.array(F.lit("1d"), F.lit("5d")).alias("validRanges"))
    info = F.struct(F.col("industry"), F.col("sector"), F.col("fulltimeemployees").alias("fullTimeEmployees"),
                    F.lit("summary").alias("longBusinessSummary"))
    history_docs = fx_metadata.select("symbol", "date_insert", F.to_json(hist).alias("body"))
    info_docs = fx_metadata.select("symbol", "date_insert", F.to_json(info).alias("body"))
    return history_docs, info_docs


def statement_docs(statements: DataFrame) -> DataFrame:
    """Statement JSON ``{item: {period: value}}`` per symbol, day and source
    (``freq``); a document has as many entries as items and periods."""
    cells = statements.groupBy("symbol", "date_insert", "freq", "line_item", F.date_format("date", "yyyy-MM-dd").alias("period")).agg(F.sum("value").alias("value"))
    items = cells.groupBy("symbol", "date_insert", "freq", "line_item").agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("periods"))
    docs = items.groupBy("symbol", "date_insert", "freq").agg(F.map_from_entries(F.collect_list(F.struct("line_item", "periods"))).alias("items"))
    return docs.select("symbol", "date_insert", "freq", F.to_json("items", {"ignoreNullFields": "false"}).alias("body"))


def company_docs(history: DataFrame, metadata: DataFrame, roster: DataFrame, mutual: DataFrame, institutional: DataFrame,
                 statements: dict[str, DataFrame]) -> DataFrame:
    """``(symbol, date_insert, kind, body)``: what a fetch of each company
    lands.  Histories come a document a year; the other lists are a company's
    own."""
    def rows(df: DataFrame, kind: str, columns: list[str], *more: Column) -> DataFrame:
        docs = df.groupBy("symbol", "date_insert", *more).agg(F.to_json(F.collect_list(F.struct(*columns))).alias("body"))
        return docs.select("symbol", "date_insert", F.lit(kind).alias("kind"), "body")

    meta, info = metadata_docs(metadata)
    parts = [
        rows(history, "history", ["date", "open", "high", "low", "close", "volume"], F.year("date")),
        rows(roster, "insider_roster", ["name", "position", "latest_transaction_date", "shares_owned_directly"]),
        rows(mutual, "mutual_holders", ["date_reported", "holder", "shares", "value"]),
        rows(institutional, "institutional_holders", ["date_reported", "holder", "pctheld", "shares", "value"]),
        meta.select("symbol", "date_insert", F.lit("history_metadata").alias("kind"), "body"),
        info.select("symbol", "date_insert", F.lit("info").alias("kind"), "body"),
    ]
    for name, long in statements.items():
        parts.append(statement_docs(long).select("symbol", "date_insert", F.concat(F.lit(f"{name}_"), "freq").alias("kind"), "body"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def info_table_pages(fx_sec_13f: DataFrame, keys_per_page: int = 20_000) -> DataFrame:
    """13F information-table documents: one table with the header-summary
    attribute, three header rows, then one row of 12 or 13 cells per
    holding (a document has one width).  Keyed by fund and filing date."""
    cells = holdings_cells(fx_sec_13f)
    width = F.size("cells")

    def td(c: Column) -> Column:
        return F.concat(F.lit("<td>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))

    # a cell that is null or that the row hasn't got is left out
    row = F.concat(F.lit("<tr>"), F.concat_ws("", *[td(F.get("cells", i)) for i in range(MOST_CELLS)]), F.lit("</tr>"))
    rows = cells.select("fund_name", "filing_date", "date_insert", width.alias("width"),
                        page_of(keys_per_page).alias("page"), row.alias("row_html"))
    pages = _pages(rows, ["fund_name", "filing_date", "date_insert", "width", "page"])
    head = ("<tr><td>COLUMN 1</td><td>COLUMN 2</td></tr>"
            "<tr><td>NAME OF ISSUER</td><td>TITLE OF CLASS</td><td>CUSIP</td></tr>"
            "<tr><td>(x$1000)</td><td>PRN AMT</td></tr>")
    cover = '<table summary="Form 13F-NT Cover Information"><tr><td>cover</td></tr></table>'
    html = F.concat(F.lit("<html><body>" + cover),
                    F.lit(f'<table border="0" summary="{INFO_TABLE_SUMMARY}">{head}'), F.col("rows_html"),
                    F.lit("</table></body></html>"))
    return pages.select("fund_name", "filing_date", "date_insert", html.alias("html"))
