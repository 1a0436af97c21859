"""Property tests: the composed Spark expressions against their Python /
PostgreSQL definitions on generated strings (one Spark job per batch of
examples, so generation stays cheap)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stocksieve.functions import html as H
from stocksieve.functions.text import parse_count, pg_initcap, pg_left, strip_ws, title_case

ALPHABET = st.sampled_from(list("abcXYZ019 -/'%\t\n\xa0éÉß"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=40)


def apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def pg_initcap_ref(s: str) -> str:
    out, prev_alnum = [], False
    for ch in s:
        out.append(ch.lower() if prev_alnum else ch.upper())
        prev_alnum = ch.isalnum()
    return "".join(out)


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_title_case_is_python_title(spark, values):
    # ß title-cases to "Ss" in Python but upper-cases to "SS"; keep to letters with 1:1 case maps
    values = [v.replace("ß", "s") for v in values]
    assert apply(spark, values, title_case) == [v.title() for v in values]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_pg_initcap_definition(spark, values):
    values = [v.replace("ß", "s") for v in values]
    assert apply(spark, values, pg_initcap) == [pg_initcap_ref(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_strip_ws_is_python_strip(spark, values):
    assert apply(spark, values, strip_ws) == [v.strip() for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcdef", max_size=10), st.integers(-15, 15)), min_size=1, max_size=30))
def test_pg_left_definition(spark, pairs):
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(pairs)], "i int, s string, n int")
    got = [r[0] for r in df.orderBy("i").select(pg_left("s", F.col("n"))).collect()]
    assert got == [s[:n] if n >= 0 else s[:max(len(s) + n, 0)] for s, n in pairs]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=30))
def test_thousands_separator_round_trip(spark, numbers):
    text = [f"{n:,}" for n in numbers]
    assert apply(spark, text, parse_count) == numbers


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=2), max_size=30), min_size=1, max_size=10), st.integers(1, 12))
def test_chunks_cover_everything_in_order(spark, arrays, width):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<string>")
    got = [r[0] for r in df.orderBy("i").select(H.chunks("a", width)).collect()]
    assert got == [[a[j:j + width] for j in range(0, len(a), width)] for a in arrays]
