
from pyspark.sql import functions as F

from stocksieve.functions.html_tree import parse_tables, table_rows_of
from stocksieve.sources import ingest as I
from stocksieve.sources import landing as L

from .conftest import SMALL


def test_nested_table_keeps_outer_rows():
    html = ("<table><tr><th>a</th><th>b</th></tr>"
            "<tr><td>1</td><td>x<table><tr><td>in</td></tr></table>y</td></tr>"
            "<tr><td>2</td><td>z</td></tr></table>"
            "<script>var s='<table><tr><td>no</td></tr></table>';</script><!-- <table><tr><td>no</td></tr></table> -->")
    rows = table_rows_of(html)
    assert rows == [(0, 0, []), (0, 1, ["1", "xiny"]), (0, 2, ["2", "z"]), (1, 0, ["in"])]


def test_parser_agrees_with_regex_on_flat_pages(spark):
    from stocksieve.sources.fixtures import fixture
    pages = L.insider_pages(fixture(spark, SMALL, "fx_insider"))
    via_regex = I.parse_insider_pages(pages).select("date_insert", "symbol", "amount", "trans_date")
    parsed = parse_tables(pages, ["date_insert"]).where((F.col("table_idx") == 2) & (F.col("row_idx") >= 1))
    via_parser = parsed.select("date_insert", F.get("cells", 1).alias("symbol"), F.get("cells", 9).alias("amount"),
                               F.get("cells", 5).alias("trans_date"))
    assert via_regex.count() > 0
    assert sorted(via_regex.collect()) == sorted(via_parser.collect())
