"""Tags read as data, the filing chain on odd markup and both table forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stocksieve.functions import html as H
from stocksieve.functions import markup as M
from stocksieve.sources import ingest as I
from stocksieve.sources import landing as L


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "h string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expect", [
    ("""class="a b" HREF='/x?a&amp;b' id=7 checked""", {"class": "a b", "href": "/x?a&b", "id": "7", "checked": ""}),
    ("""a="1" a="2" b = '3' c= 4""", {"a": "1", "b": "3", "c": "4"}),
    ("""title="x > y" href=/p?q=1&r=2""", {"title": "x > y", "href": "/p?q=1&r=2"}),
    ("", {}), ("/", {}), (None, None)])
def test_attributes(spark, text, expect):
    assert one(spark, text, M.attributes("h")) == expect


@pytest.mark.parametrize("text, expect", [
    ("<div id='pages'>a<div>b<div>c</div>d</div>e</div>f<div>g</div>", "a<div>b<div>c</div>d</div>e"),
    ("<div>x<DIV class=k id=pages>in</DIV></div>", "in"),
    ("<div id=pages>open <div>x</div> never closed", "open <div>x</div> never closed"),
    ("<div id=pages></div>", ""), ("<div id=other>x</div>", None), ("<divx id=pages>x</divx>", None), ("", None), (None, None),
    ("<div data-x='a>b' id=pages>w</div>", "w"), ("</div></div><div id=pages>late</div>", "late")])
def test_element_by_depth(spark, text, expect):
    assert one(spark, text, M.element("h", "div", lambda t: M.has_value(t, "id", "pages"))) == expect


def test_page_links_only_of_the_pages_div(spark):
    text = ("<div><a href='/no'>n</a></div><!-- <div id=pages><a href='/old'>o</a></div> --><sCript>var t='<div id=pages>'</sCript>"
            "<div id=pages><div><a class=x href='/b'>b</a></div><a href=/c>c</a><a href=\"/a\">a</a><a href='/b'>again</a></div><a href='/z'>z</a>")
    assert one(spark, text, H.page_links("h")) == ["/b", "/c"]
    assert one(spark, "<p>none</p>", H.page_links("h")) == []


@pytest.mark.parametrize("table", ['class="tableFile x"', "summary='s' class='tableFile'", "CLASS=tableFile", 'class="a  tableFile"'])
@pytest.mark.parametrize("link", ['<a href="/t.xml">', "<a class='c' id=1 href='/t.xml'>", "<A HREF=/t.xml>", "<a title='a > b' href='/t.xml'>"])
def test_information_table_link(spark, table, link):
    page = f"<table class=other><tr><td>information table<a href='/no'>x</a></td></tr></table><table {table}><tr><td>Primary</td><td><a href='/p'>p</a></td></tr><tr><td>Information Table</td><td>{link}t</a></td></tr></table>"
    assert one(spark, page, I.info_table_link(F.col("h"))) == "https://www.sec.gov/t.xml"


def test_information_table_link_absent(spark):
    for page in ("<table class=tableFile><tr><td>information table</td></tr></table>", "<table class=tableFile><tr><td>x</td></tr></table>",
                 "<table class=tableFiles><tr><td>information table<a href='/x'>x</a></td></tr></table>", "", None):
        assert one(spark, page, I.info_table_link(F.col("h"))) is None


XML = ("<?xml version='1.0'?><informationTable xmlns='http://x/y'><infoTable><nameOfIssuer>A &amp; B</nameOfIssuer><titleOfClass>COM</titleOfClass><cusip>1</cusip>"
       "<value>1234</value><shrsOrPrnAmt><sshPrnamt>5</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt><investmentDiscretion>SOLE</investmentDiscretion>"
       "<votingAuthority><Sole>5</Sole><Shared>0</Shared><None>0</None></votingAuthority></infoTable></informationTable>")
TABLE = ("<html><table summary='x'><tr><td>no</td></tr></table><TABLE border=0 summary='Form 13F-NT Header Information'><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr>"
         "<tr><td>C &lt;D&gt;</td><td>COM</td><td>2</td><td></td><td>1,234,567</td><td>6</td><td>SH</td><td></td><td>SOLE</td><td></td><td>6</td><td>0</td><td>0</td></tr>"
         "<tr><td>E</td><td>COM</td><td>3</td><td>7,8</td><td>9</td><td>SH</td><td></td><td>SOLE</td><td></td><td>9</td><td>0</td><td>0</td></tr>"
         "<tr><td>short</td></tr></TABLE></html>")


def test_filing_chain_of_both_forms(spark):
    day = dt.date(2024, 5, 15)
    filings = spark.createDataFrame([("1", "1-24-1", day), ("2", "2-24-2", day), ("3", "3-24-3", day), ("4", "4-24-4", day)], "cik string, accession_number string, filing_date date")
    page = lambda href: f"<table class='tableFile'><tr><td>information table</td><td><a href='{href}'>t</a></td></tr></table>"
    url = lambda c: f"https://www.sec.gov/Archives/edgar/data/{c}/{c}24{c}/{c}-24-{c}-index.htm"
    site = spark.createDataFrame([
        (url(1), "index", page("/1.xml")), (url(2), "index", page("/2.htm")), (url(3), "index", "<p>no table</p>"), (url(9), "index", page("/9.xml")),
        ("https://www.sec.gov/1.xml", "table", XML), ("https://www.sec.gov/2.htm", "table", TABLE), ("https://www.sec.gov/9.xml", "table", XML)], "url string, kind string, body string")
    good, bad = I.filing_holdings(filings, site)
    got = sorted((r.cik, r.name_of_issuer, r.value, r.prn_amt, r.figi, r.trans_date) for r in good.collect())
    assert got == [("1", "A & B", 1234, 5, None, day), ("2", "C <D>", 1234567, 6, None, day), ("2", "E", 7, 9, None, day), ("2", "E", 8, 9, None, day)]
    assert [r.cik for r in bad.collect()] == ["2"]  # the row of another width


def test_index_page_url_drops_dashes(spark):
    assert one(spark, "0001-24-000002", L.index_page_url(F.lit("77"), F.col("h"))) == "https://www.sec.gov/Archives/edgar/data/77/000124000002/0001-24-000002-index.htm"
