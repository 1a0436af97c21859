import datetime as dt
import math

from pyspark.sql import functions as F

from stocksieve.functions import html as H
from stocksieve.functions.dates import home_filing_date, parse_day_month_year, text_date
from stocksieve.functions.structs import conform, flatten, normalise_columns
from stocksieve.functions.text import (comma_items, dash_part, nan_to_null, none_to_null, parse_count,
                                       parse_number, pg_initcap, pg_left, strip_ws, title_case)
from stocksieve.operators.screens import fund_display_name

from .conftest import rows


def one(spark, data, expr, schema="s string"):
    df = spark.createDataFrame([(d,) for d in data], schema)
    return [r[0] for r in df.select(expr(F.col(df.columns[0])).alias("x")).collect()]


def test_title_case_matches_python(spark):
    data = ["3com", "10% owner/director", "co-chief operating officer", "o'neil", "see remarks", "ÉCOLE du nord", None]
    got = one(spark, data, title_case)
    assert got == [d.title() if d is not None else None for d in data]


def test_pg_initcap_letters_and_digits_form_words(spark):
    got = one(spark, ["3com", "co-ceo", "o'neil", "algeria cap-partners 3m"], pg_initcap)
    assert got == ["3com", "Co-Ceo", "O'Neil", "Algeria Cap-Partners 3m"]


def test_pg_left_negative_means_all_but_last(spark):
    df = spark.createDataFrame([("abcdef", 2), ("abcdef", -2), ("abcdef", -10), ("ab", 0)], "s string, n int")
    assert [r[0] for r in df.select(pg_left("s", F.col("n"))).collect()] == ["ab", "abcd", "", ""]


def test_fund_display_name_short_names(spark):
    # 15, 20, 21 and 22 characters: length-21 goes negative for the short ones
    names = ["a" * 15, "b" * 20, "c" * 21, "dd" + " - 13F-HR Q3 filing x"]
    got = one(spark, names, fund_display_name)
    expect = []
    for s in names:
        n = len(s) - 21
        cut = s[:n] if n >= 0 else s[:max(len(s) + n, 0)]
        expect.append(cut.strip(" ").capitalize() if cut else "")
    assert got == expect


def test_strip_ws_is_python_strip(spark):
    data = ["  a b \n", "\t\xa0x ", "", None]
    assert one(spark, data, strip_ws) == [d.strip() if d is not None else None for d in data]


def test_number_parsing(spark):
    assert one(spark, ["1,234", "n/a", "", "12"], parse_count) == [1234, None, None, 12]
    assert one(spark, ["123.0", "7", "x"], parse_number) == [123, 7, None]


def test_dash_parts(spark):
    df = spark.createDataFrame([("AAA - Alpha",), ("NOHYPHEN",), ("BRK-B - Berkshire - Class B",)], "s string")
    got = rows(df.select(dash_part("s", 0).alias("a"), dash_part("s", 1).alias("b"),
                         dash_part("s", 1, whole_tail=True).alias("c")))
    assert got[0] == ("AAA", "Alpha", "Alpha")
    assert got[1] == ("NOHYPHEN", None, None)
    # the split on every hyphen cuts the ticker and loses the third part
    assert got[2] == ("BRK", "B", "B - Berkshire - Class B")


def test_day_month_year(spark):
    assert one(spark, ["5 Dec 2024", "05 Dec 2024", "n/a"], parse_day_month_year) == [
        dt.date(2024, 12, 5), dt.date(2024, 12, 5), None]


def test_today_and_year_roll(spark):
    df = spark.createDataFrame([("Today",), ("30 Dec",), ("03 Jan",)], "s string")
    as_of = "2025-01-03"
    plain = [r[0] for r in df.select(home_filing_date("s", as_of)).collect()]
    rolled = [r[0] for r in df.select(home_filing_date("s", as_of, roll_year=True)).collect()]
    assert plain == [dt.date(2025, 1, 3), dt.date(2025, 12, 30), dt.date(2025, 1, 3)]
    assert rolled == [dt.date(2025, 1, 3), dt.date(2024, 12, 30), dt.date(2025, 1, 3)]


def test_text_date_accepts_timestamp_text(spark):
    assert one(spark, ["2024-08-14", "2024-08-14 00:00:00", "bad"], text_date) == [
        dt.date(2024, 8, 14), dt.date(2024, 8, 14), None]


def test_null_markers(spark):
    assert one(spark, ["None", "x", None], none_to_null) == [None, "x", None]
    got = one(spark, [float("nan"), 1.5, None], nan_to_null, "d double")
    assert got[0] is None and got[1] == 1.5 and got[2] is None


def test_comma_items(spark):
    assert one(spark, [" AAA, BBB,,CCC "], comma_items) == [["AAA", "BBB", "CCC"]]


def test_html_cells_and_chunks(spark):
    html = ('<html><script>var t="<table>";</script><!-- <table><tr><td>x</td></tr></table> -->'
            '<table><tr><th>H</th></tr><tr><td> a &amp; b </td><td><b>c</b></td></tr></table></html>')
    df = spark.createDataFrame([(html,)], "html string")
    t = df.select(H.nth_table("html", 0).alias("t"))
    cells = t.select(F.transform(H.rows("t"), lambda r: H.cells(r)).alias("c")).first()[0]
    assert cells == [[], ["a & b", "c"]]
    arr = spark.createDataFrame([(list("abcde"),), ([],)], "a array<string>")
    got = [r[0] for r in arr.select(H.chunks("a", 2)).collect()]
    assert got == [[["a", "b"], ["c", "d"], ["e"]], []]


def test_page_links_sorted_distinct_first_dropped(spark):
    html = '<div id="pages"><a href="/p?2">2</a><a href="/p?1">1</a><a href="/p?2">2</a><a href="/p?3">3</a></div>'
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(H.page_links("html")).first()[0] == ["/p?2", "/p?3"]


def test_normalise_columns_refuses_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`Total Debt` int, total_debt int")
    try:
        normalise_columns(df)
    except ValueError as e:
        assert "total_debt" in str(e)
    else:
        raise AssertionError("collision not detected")
    long_a, long_b = "x" * 59 + "a", "x" * 59 + "b"
    df2 = spark.createDataFrame([(1, 2)], f"{long_a} int, {long_b} int")
    try:
        normalise_columns(df2)
    except ValueError:
        pass
    else:
        raise AssertionError("truncation collision not detected")
    assert normalise_columns(df2, max_len=None).columns == [long_a, long_b]


def test_flatten_and_conform(spark):
    df = spark.createDataFrame([((1, (2, "z")),)], "a struct<b:int, c:struct<d:int, e:string>>")
    flat = flatten(df)
    assert flat.columns == ["a.b", "a.c.d", "a.c.e"]
    from pyspark.sql import types as T
    target = T.StructType([T.StructField("A.B", T.LongType()), T.StructField("missing", T.DateType())])
    out = conform(flat, target)
    assert out.dtypes == [("A.B", "bigint"), ("missing", "date")]
    assert out.first()[0] == 1 and out.first()[1] is None


def test_nan_is_not_null_for_sum(spark):
    # guard for the NaN -> null rule: Spark keeps NaN distinct from null
    df = spark.createDataFrame([(float("nan"),)], "d double")
    assert math.isnan(df.first()[0])


def test_trimmed_texts_are_those_without_white_space_at_the_ends(spark):
    from stocksieve.functions.text import WHITESPACE, strip_ws, trimmed
    texts = ["", "a", "a b", "~", "!x!", "\x7f", "é", "aé", "éa", "None", None]
    texts += [t for ch in WHITESPACE for t in (ch, ch + "a", "a" + ch, "a" + ch + "b")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trimmed("t").alias("ok"), strip_ws("t").alias("s"))
    for r in df.collect():
        assert r.s == (r.t.strip() if r.t is not None else None)
        if r.ok:
            assert r.s == r.t and r.t != ""
    assert {r.t for r in df.where("ok").collect()} >= {"a", "a b", "~", "!x!", "None"}
