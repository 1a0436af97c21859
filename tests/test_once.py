"""Work done once and in the right place: bodies parsed above the joins that
choose them, texts of an expression computed once, pages kept out of one task."""

import pytest
from pyspark.sql import functions as F

from stocksieve.functions.text import WHITESPACE
from stocksieve.plans import QUERIES

from .conftest import SMALL


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().replace(WHITESPACE, "WS")  # a node a line


def below(plan, node):
    """Lines under the first line that holds ``node``."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    at = next(i for i, x in enumerate(lines) if node in x)
    under = []
    for x in lines[at + 1:]:
        if depth(x) <= depth(lines[at]):
            break
        under.append(x)
    return under


def test_filing_bodies_are_parsed_once_above_their_join(spark):
    plan = optimized(QUERIES["q_13f_holdings_chain"](spark, SMALL))
    lines = [x for x in plan.splitlines() if "from_xml" in x or "information table" in x]
    assert len(lines) == 2 and all("Generate" in x for x in lines)
    assert not any("from_xml" in x for x in below(plan, "Join Inner"))


def test_chunks_and_home_tables_are_computed_once(spark):
    from stocksieve.functions import html as H
    from stocksieve.sources import ingest as I
    df = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    assert optimized(df.select(H.chunks(F.reverse("x"), 2).alias("c"))).count("reverse(") == 1
    assert df.select(H.chunks("x", 2)).first()[0] == [["a", "b"], ["c"]]
    pages = spark.createDataFrame([("d", "<table><tr><td>1</td></tr></table>")], "date_insert string, html string")
    for plan in (optimized(I.home_cells(pages)), optimized(I.parse_screener(pages))):
        assert not any("Filter" in x and "regexp_extract_all" in x for x in plan.splitlines())


def test_store_day_parses_holding_pages_once(spark):
    from stocksieve.operators.snapshot_day import Landed, snapshot_tables
    page = "date_insert date, page bigint, html string"
    empty = spark.createDataFrame([], page)
    docs = spark.createDataFrame([], "fund_name string, filing_date string, date_insert date, html string")
    tables = snapshot_tables(Landed(empty, empty, empty, empty, docs))
    for name in ("sec_13f", "sec_13f_quarantine", "finviz_screen", "finviz_screen_quarantine"):
        assert "<table" not in optimized(tables[name])


def test_text_of_a_tag_or_table_is_computed_once(spark):
    from stocksieve.functions import html as H
    from stocksieve.functions import markup as M
    df = spark.createDataFrame([("<p>",)], "h string")
    text = F.reverse("h")
    for column in (M.attribute(text, "href"), M.has_class(text, "a b"), M.element(text, "div", lambda t: M.has_value(t, "id", "x")), M.first_href(text)):
        assert optimized(df.select(column.alias("x"))).count("reverse(") == 1


@pytest.mark.parametrize("html, expect", [
    ("<table class='a&#39;b  c'>1</table>", "1"), ("<table class='c'>2</table>", "2"), ("<table class='d'>3</table>", None),
    ("<table class='c'>a\0b<table>n</table>d</table>", "a\0b<table>n</table>d"), ("\0<TABLE class=c>4", "4"), (None, None), ("", None),
    ("<table><!--x--></table><table class=c><STYLE>y</STYLE>5</table>", "5")])
def test_classed_table_on_odd_text(spark, html, expect):
    from stocksieve.functions import html as H
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.table_with_class("h", "c")).first()[0] == expect


def test_cells_are_read_before_rows_are_filtered(spark):
    from stocksieve.sources import ingest as I
    docs = spark.createDataFrame([("f", "d", "i", "<table summary='Form 13F-NT Header Information'><tr><td>1</td></tr><tr></tr><tr></tr><tr><td> a </td></tr><tr></tr></table>"),
                                  ("g", "d", "i", "<table summary='Form 13F-NT Header Information'><tr><td>1</td></tr></table>"), ("h", "d", "i", None)],
                                 "fund_name string, filing_date string, date_insert string, html string")
    rows = I.parse_info_table(docs)
    assert sorted((r.fund_name, r.cells) for r in rows.collect()) == [("f", []), ("f", ["a"])]
    plan = optimized(rows.where(F.size("cells") == 1))
    assert sum("<td" in x for x in plan.splitlines()) == 1


def test_prompts_read_staged_sections(spark, tmp_dir):
    import os
    from stocksieve.operators import context as X
    df = spark.createDataFrame([("A", 1)], "ticker string, n int")
    names = sorted({s for secs, _ in X.PROMPTS.values() for s in secs})
    sections = X.render_sections([(n, df, ["ticker"], [("ticker", False)]) for n in names])
    prompts, _ = X.report_chain(sections, lambda p, texts, reports: spark.createDataFrame([(p, "A")], "prompt_name string, report_text string"), "2024-01-31", tmp_dir)
    assert os.path.isdir(f"{tmp_dir}/sections") and prompts.count() == len(X.PROMPTS)


def test_pages_of_a_section_meet_its_head_where_they_are(spark):
    from stocksieve.operators import context as X
    df = spark.createDataFrame([(f"T{i}", i) for i in range(50)], "ticker string, n int")
    order = [("ticker", False)]
    sections = X.render_sections([("a", df, ["ticker"], order), ("none", df.where("n < 0"), ["ticker"], order)], rows_per_page=20)
    assert not any("collect_list" in x for x in below(optimized(sections), "Join LeftOuter"))
    got = sorted((r.section, r.page, r.n_rows, r.n_shown, r.text.count("\n")) for r in sections.collect())
    assert got == [("a", 0, 50, 20, 20), ("a", 1, 50, 20, 20), ("a", 2, 50, 10, 10), ("none", 0, 0, 0, 1)]
