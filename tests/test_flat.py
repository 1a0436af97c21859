"""Tables, rows and cells read by one pattern each, beside the steps they stand for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stocksieve.functions import html as H
from stocksieve.functions import markup as M
from stocksieve.sources import ingest as I
from stocksieve.sources import landing as L

FLAT = ["<table summary='v w'>a</table>", "<p><TABLE border=0 Summary = \"v w\" x>a<tr><TD>b</td></TABLE >c", "<table summary=v>no</table><table\nid=1 summary='v w'/>a</table>",
        "</table><table summary>n</table><table summary='x' summary='v w'>n</table><table a='b'summary='v w'>a < b <i>c</i></table>", "<tablex summary='v w'>n</tablex><table summary='v w'>é \U0001f600</table>"]
WALKED = ["<table summary='v w'>a<table>b</table>c</table>", "<!-- <table summary='v w'>no</table> --><table summary='v w'>a</table>", "<script>'<table summary=\"v w\">'</script><table summary='v w'>a</table>",
          "<table summary='v w'>a<style>b</style>c</table>", "<table title='<table summary=\"v w\">'>n</table><table summary='v w'>a</table>", "<table title='a > b' summary='v w'>a</table>",
          "<table summary='v&nbsp;w'>n</table><table summary='v w'>a</table>", "<table title=a&amp;b summary='v w'>a</table>", "<table summary='v w'>never closed", "<table summary='v w'></table>",
          "<table summary=v w>a</table>", "<table summary='V w'>a</table>", "<table xsummary='v w'>a</table>", "<table title=summary='v w'>a</table>", "<table summary='v w>a</table>", "<table a=''summary='v w''>a</table>",
          "<p>none</p>", "<table", "", None]


@pytest.mark.parametrize("text", FLAT + WALKED)
def test_table_by_pattern_is_the_one_found_by_depth(spark, text):
    df = spark.createDataFrame([(text,)], "h string")
    walked = F.nullif(M.element(H.strip_noise("h"), "table", lambda t: M.has_value(t, "summary", "v w")), F.lit(""))
    flat = M.flat_element("h", "table", "summary", "v w")
    got = df.select(H.table_with_attr("h", "summary", "v w").alias("t"), walked.alias("w"), flat.alias("f")).first()
    assert got.t == got.w and got.f in (got.w, None)
    assert (got.f is not None) == (text in FLAT)


@pytest.mark.parametrize("value, text, expect", [
    ("v", "<table summary=v>a</table>", "a"), ("v", "<table summary=vw>a</table>", None), ("it's", "<table summary=\"it's\">a</table>", "a"), ("a\"b", "<table summary='a\"b'>a</table>", "a"),
    ("a&b", "<table summary='a&amp;b'>a</table>", "a"), ("a.b", "<table summary='axb'>n</table><table summary='a.b'>a</table>", "a"), ("", "<table summary=''>a</table>", "a"),
    ("a\\Eb", "<table summary='a\\Eb'>a</table>", "a")])
def test_table_by_odd_values(spark, value, text, expect):
    assert spark.createDataFrame([(text,)], "h string").select(H.table_with_attr("h", "summary", value)).first()[0] == expect


@pytest.mark.parametrize("row, expect", [
    ("<td>a</td><td>b c</td><td></td>", ["a", "b c", ""]), ("<TD class=x>1,2</TD>\n<td\tid='y'>été</td>", ["1,2", "été"]), ("<td> a </td><td> b　</td>", ["a", "b"]),
    ("<td><b>a</b> </td><td>c</td>", ["a", "c"]), ("<td>a &amp; b</td><td>&lt;</td>", ["a & b", "<"]), ("<th>n</th><td>a</td>", ["a"]), ("<tdx>n</tdx><td>a</td>", ["a"]),
    ("<td>a<td>b</td>", ["ab"]), ("<td>a", []), ("x<td>a</td>y", ["a"]), ("<td>a\nb</td><td>a<</td>", ["a\nb", "a<"]), ("", []), (None, None)])
def test_cells_of_plain_and_other_rows(spark, row, expect):
    assert spark.createDataFrame([(row,)], "r string").select(H.cells("r")).first()[0] == expect


def test_plain_pages_are_read_without_a_walk(spark):
    """All that a landed information table takes are patterns on its text."""
    rows = spark.createDataFrame([("ISSUER 1", "000000001", 30, 5, " f", dt.date(1998, 5, 1), dt.date(1998, 6, 1), 9), ("ISSUER 2", "000000002", 31, 4, " f", dt.date(1998, 5, 1), dt.date(1998, 6, 1), 10)],
                                 "name_of_issuer string, cusip string, value bigint, prn_amt bigint, fund_name string, trans_date date, date_insert date, row_key bigint")
    pages = L.info_table_pages(rows).localCheckpoint()
    assert pages.where(M.flat_element("html", "table", "summary", L.INFO_TABLE_SUMMARY).isNull()).count() == 0 < pages.count()
    body = F.explode(F.slice(H.rows(H.table_with_attr("html", "summary", L.INFO_TABLE_SUMMARY)), 4, 9)).alias("r")
    assert pages.select(body).where(~F.col("r").rlike(H._plain("td"))).count() == 0


def test_a_row_without_some_cells_is_rendered_with_the_others(spark):
    rows = spark.createDataFrame([("A & <B>", None, 31, 4, " f", dt.date(1998, 5, 1), dt.date(1998, 6, 1), 9), (None, "7", 30, 5, " f", None, dt.date(1998, 6, 1), 9)],
                                 "name_of_issuer string, cusip string, value bigint, prn_amt bigint, fund_name string, trans_date date, date_insert date, row_key bigint")
    got = {r.html.split("PRN AMT</td></tr>")[1] for r in L.info_table_pages(rows).collect()}
    tail = "<td>SH</td><td>None</td><td>SOLE</td><td>None</td><td>{0}</td><td>0</td><td>None</td></tr></table></body></html>"
    assert got == {"<tr><td>A &amp; &lt;B></td><td>COM</td><td>31</td><td>4</td>" + tail.format(4), "<tr><td>COM</td><td>7</td><td>BBG7</td><td>None</td><td>5</td>" + tail.format(5)}


def test_holdings_of_every_width(spark):
    cells = [str(i) for i in range(1, 15)]
    rows = [(str(n), "1998-01-02", cells[:n]) for n in (0, 2, 3, 4, 11, 12, 13, 14)] + [("null", "1998-01-02", None), ("odd", "x", [" None", "None", "\n a\nb ", " c", None] + cells[5:13])]
    raw = spark.createDataFrame(rows, "fund_name string, filing_date string, cells array<string>").withColumn("date_insert", F.lit("1998-06-01").cast("date"))
    got = {r.fund_name: r for r in I.parse_holdings(raw).collect()}
    for n in (0, 2, 3, 4, 11, 12, 14):  # all but 13 cells: without FIGI
        read = [*cells[:3], None, *cells[3:]]
        read = [read[i] if i < n + (n > 3) else None for i in range(13)]
        assert got[str(n)].ok == (n == 12)
        for c, x in zip(I.HOLDING_COLUMNS, read):
            assert getattr(got[str(n)], c) == (int(x) if x and c in I.HOLDING_INT_COLUMNS else x), (n, c)
    assert got["13"].ok and got["13"].figi == "4" and got["13"].voting_none == 13
    assert got["null"].ok is None and got["null"].cusip is None
    assert (got["odd"].name_of_issuer, got["odd"].title_of_class, got["odd"].cusip, got["odd"].figi, got["odd"].value) == ("None", None, "a b", "c", None)
