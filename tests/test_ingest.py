import datetime as dt


from pyspark.sql import functions as F

from stocksieve.sources import ingest as I
from stocksieve.sources import landing as L

from .conftest import rows

D1 = dt.date(2024, 12, 6)


def keyed(df):
    return df.withColumn("row_key", F.monotonically_increasing_id())


def test_insider_pages_round_trip(spark):
    typed = spark.createDataFrame(
        [("AAA", "Sec A", "Jane Roe", "chief executive officer", dt.date(2024, 12, 5), "Purchase", "10", 1234567, 1500, "D", D1),
         ("", "Sec B", "John Doe", "see remarks", dt.date(2024, 12, 4), "Sale", "11", 10, 5, "I", D1),
         ("BBB", "Sec <C> & co", "A. Person", "see remark", dt.date(2024, 12, 3), "Purchase", "12", 99, 1, "D", D1)],
        "symbol string, security string, reporting_name string, relationship string, trans_date date, "
        "purchase_sale string, price string, amount bigint, shares bigint, di string, date_insert date")
    raw = I.parse_insider_pages(L.insider_pages(keyed(typed), rows_per_page=2))
    clean = I.clean_insider(raw).orderBy("symbol")
    got = rows(clean, "symbol", "security", "relationship", "trans_date", "purchase_sale", "amount", "shares", "count")
    assert got == [
        ("AAA", "Sec A", "CEO", dt.date(2024, 12, 5), "Buy", 1234567, 1500, 1),
        ("BBB", "Sec <C> & co", "Other", dt.date(2024, 12, 3), "Buy", 99, 1, 1),
    ]


def test_rollup_drops_null_keys_and_sums(spark):
    clean = spark.createDataFrame(
        [("AAA", "CEO", dt.date(2024, 1, 2), "Buy", "1", "s", "n", "D", 10, 1, 1, D1),
         ("AAA", "CEO", dt.date(2024, 1, 2), "Buy", "1", "s", "n", "D", 5, 2, 1, D1),
         ("BBB", None, dt.date(2024, 1, 2), "Buy", "1", "s", "n", "D", 7, 3, 1, D1)],
        "symbol string, relationship string, trans_date date, purchase_sale string, price string, security string, "
        "reporting_name string, di string, amount bigint, shares bigint, count int, date_insert date")
    got = rows(I.rollup_insider(clean), "symbol", "amount", "shares", "count")
    assert got == [("AAA", 15, 3, 2)]


def test_home_tables(spark):
    home = spark.createDataFrame([("T1 - Alpha", "2024-12-06", "1000", "5", D1), ("T1 - Alpha", "2024-12-02", "50", "5", D1)],
                                 "company string, date_filling string, total_value string, price string, date_insert date")
    big = spark.createDataFrame([("T2", "Beta", "3%", "4", D1)],
                                "ticker string, company string, percent_owned string, count string, date_insert date")
    low = spark.createDataFrame([("T3", "Gamma", "9%", D1)], "ticker string, company string, percent_owned string, date_insert date")
    sup = spark.createDataFrame([("T4 - Delta", "T4", "2", "$10", D1)],
                                "company string, ticker string, count string, total_amount string, date_insert date")
    landed = L.home_pages(*map(keyed, (home, big, low, sup)))
    for pages in (landed, I.home_cells(landed)):  # table by table, or all tables in one pass
        h = I.parse_home_insider(pages).orderBy("date_filling")
        assert rows(h, "ticker", "company", "date_filling", "total_value") == [
            ("T1", "Alpha", dt.date(2024, 12, 2), 50), ("T1", "Alpha", dt.date(2024, 12, 6), 1000)]
        assert rows(I.parse_bigbets(pages), "ticker", "company", "percent_owned", "count") == [("T2", "Beta", "3%", "4")]
        assert rows(I.parse_lows(pages), "ticker", "company", "percent_owned") == [("T3", "Gamma", "9%")]
        assert rows(I.parse_super(pages), "ticker", "company", "count", "total_amount") == [("T4", "Delta", "2", "$10")]


def test_equal_rows_do_not_fill_one_page(spark):
    low = spark.createDataFrame([("T3", "Gamma", "9%", D1)] * 95, "ticker string, company string, percent_owned string, date_insert date")
    low = low.withColumn("row_key", F.monotonically_increasing_id() % 1000 + F.spark_partition_id() * 1000)
    none = [spark.createDataFrame([], t) for t in ("company string, date_filling string, total_value string, price string, date_insert date, row_key long",
                                                   "ticker string, company string, percent_owned string, count string, date_insert date, row_key long",
                                                   "company string, ticker string, count string, total_amount string, date_insert date, row_key long")]
    pages = L.home_pages(none[0], none[1], low, none[2], rows_per_page=10)
    assert pages.select(F.size(F.split("html", "Gamma")) - 1).agg(F.max("(size(split(html, Gamma, -1)) - 1)")).first()[0] <= 10
    assert I.parse_lows(pages).count() == 95


def test_screener_ragged_chunk_goes_to_quarantine(spark):
    cells = "".join(f"<td>{i}</td>" for i in range(11 + 4))
    html = f'<table class="{L.SCREENER_TABLE_CLASS}"><tr>{cells}</tr></table>'
    pages = spark.createDataFrame([(D1, html)], "date_insert date, html string")
    good, bad = I.quarantine(I.parse_screener(pages))
    assert good.count() == 1 and bad.count() == 1
    assert good.first()["ticker"] == "1" and bad.first()["ticker"] == "12"


def test_holdings_layouts(spark):
    c13 = ["ISSUER\nONE", "COM", "000000001", "BBG1", "100", "10", "SH", "None", "SOLE", "None", "10", "0", "None"]
    c12 = ["ISSUER TWO", "COM", "000000002", "None", "20", "SH", "None", "SOLE", "1", "20", "0", "0"]
    c10 = ["X"] * 10
    raw = spark.createDataFrame([("fund", "2024-11-14", D1, c) for c in (c13, c12, c10)],
                                "fund_name string, filing_date string, date_insert date, cells array<string>")
    good, bad = I.clean_holdings(raw)
    got = {r["cusip"]: r for r in good.collect()}
    assert got["000000001"]["name_of_issuer"] == "ISSUER ONE"
    assert got["000000001"]["figi"] == "BBG1" and got["000000001"]["put_call"] is None
    assert got["000000002"]["figi"] is None and got["000000002"]["value"] is None  # 'None' value kept as null
    assert got["000000002"]["prn_amt"] == 20 and got["000000002"]["trans_date"] == dt.date(2024, 11, 14)
    assert bad.count() == 1


def test_holdings_value_with_thousands_separators_is_one_number(spark):
    cells = ["I", "COM", "000000003", "B", "1,234,567", "5", "SH", "None", "SOLE", "None", "5", "0", "0"]
    raw = spark.createDataFrame([(cells, "f", "2024-05-20", D1)],
                                "cells array<string>, fund_name string, filing_date string, date_insert date")
    good, _ = I.clean_holdings(raw)
    assert [r["value"] for r in good.collect()] == [1234567]


def test_holdings_value_list_explodes(spark):
    cells = ["I", "COM", "000000003", "B", "1, 2", "5", "SH", "None", "SOLE", "None", "5", "0", "0"]
    raw = spark.createDataFrame([("fund", "2024-11-14", D1, cells)],
                                "fund_name string, filing_date string, date_insert date, cells array<string>")
    good, _ = I.clean_holdings(raw)
    assert sorted(r["value"] for r in good.collect()) == [1, 2]


def test_filing_index_and_latest(spark):
    filings = spark.createDataFrame(
        [("0000000001", "0000000010", dt.date(2024, 5, 1), "13F-HR"),
         ("0000000001", "0000000011", dt.date(2024, 8, 1), "13F-HR/A"),
         ("0000000001", "0000000012", dt.date(2024, 7, 1), "13F-HR"),
         ("0000000002", "0000000020", dt.date(2023, 1, 1), "10-K")],
        "cik string, accession_number string, filing_date date, form string")
    parsed = I.parse_filing_index(L.filing_index_json(filings))
    assert parsed.count() == 4
    latest = rows(I.latest_filing(parsed), "cik", "accession_number")
    assert latest == [("0000000001", "0000000012")]
    urls = {r["accession_number"]: r["url"] for r in I.info_table_url(L.filing_index_pages(filings)).collect()}
    assert urls["0000000010"].endswith("/0000000010/infotable.xml")
    assert urls["0000000012"] is None  # 12 % 3 == 0: no information-table row


def test_metadata_flatten_drop_and_optional_keys(spark):
    from stocksieve.operators import fundamentals as FU
    fx = spark.createDataFrame([("T1", "Steel", "ASIA", 70, D1)],
                               "symbol string, industry string, sector string, fulltimeemployees bigint, date_insert date")
    hist, info = L.metadata_docs(fx)
    meta = FU.metadata(hist, info)
    r = meta.first()
    assert r["fullexchangename"] == "NasdaqGS" and r["industry"] == "Steel" and r["website"] is None
    assert "currenttradingperiod.regular.start" not in meta.columns and "validranges" not in meta.columns


def test_info_url_ignores_markup(spark):
    html = ('<table class="tableFile"><tr><th>Seq</th></tr>'
            '<tr><td><a href="/a.xml" title="information table">a.xml</a></td><td>COVER</td></tr>'
            '<tr><td>2</td><td>INFORMATION  TABLE</td><td><a href="/b.xml">b.xml</a></td></tr>'
            '<tr><td>3</td><td>Information table</td><td><a href="/c.xml">c.xml</a></td></tr></table>')
    pages = spark.createDataFrame([("1", "2", html)], "cik string, accession_number string, html string")
    assert I.info_table_url(pages).first()["url"] == "https://www.sec.gov/c.xml"


def test_holdings_cells_are_cleaned_by_one_expression(spark):
    """Cells of any width and white space, read as before; the trim stands once
    in the plan, not once a column."""
    wide = ["A\nB ", "COM", "\u00a0c1\t", "None", " 1,234 ", "5", "SH", "None", "SOLE", " None", "7", "0", None]
    rows = [wide, wide[:3] + wide[4:], wide[:2], wide[:5], wide + ["x"], [], None]
    raw = spark.createDataFrame([("f", "2024-08-14", "d", r) for r in rows], "fund_name string, filing_date string, date_insert string, cells array<string>")
    parsed = I.parse_holdings(raw)
    got = [(r.ok, r.name_of_issuer, r.cusip, r.figi, r.value, r.prn_amt, r.manager, r.voting_sole, r.voting_none) for r in parsed.collect()]
    good = (True, "A B", "c1", None, 1234, 5, "None", 7, None)
    assert got[:3] == [good, good, (False, "A B", None, None, None, None, None, None, None)]
    assert got[3] == (False, "A B", "c1", None, None, 1234, None, None, None)  # the fourth cell of a narrow row is its value
    assert got[4][:4] == (False, "A B", "c1", None) and got[4][4] is None and got[4][5] == 1234
    assert got[5] == (False, *[None] * 8) and got[6] == (None, *[None] * 8)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
