"""The ordered screens: written side by side, each in its caller's job group."""

import threading

from pyspark.sql import functions as F

from stocksieve.functions.text import dash_part
from stocksieve.plans import QUERIES, ordered

from .conftest import SMALL
from .test_once import optimized


def test_screens_are_numbered_side_by_side(spark, monkeypatch):
    met, seen, real = threading.Barrier(len(ordered.ORDERED)), [], ordered.numbered

    def numbered(df, order, out):
        seen.append((threading.get_ident(), spark.sparkContext.getLocalProperty("screens.test")))
        met.wait(60)  # broken when one screen waits for the end of another
        return real(df, order, out)

    monkeypatch.setattr(ordered, "numbered", numbered)
    spark.sparkContext.setLocalProperty("screens.test", "caller")
    try:
        got = QUERIES["q_ordered_screens"](spark, SMALL)
    finally:
        spark.sparkContext.setLocalProperty("screens.test", None)
    assert len({who for who, _ in seen}) == len(ordered.ORDERED) and {of for _, of in seen} == {"caller"}
    per = got.groupBy("screen").agg(F.min("nth").alias("first"), F.max("nth").alias("last"), F.countDistinct("nth").alias("n"), F.count("*").alias("rows")).collect()
    assert {r.screen for r in per} == set(ordered.ORDERED)
    assert all(r.first == 1 and r.last == r.n == r.rows for r in per)


def test_dash_parts_are_cut_without_an_array_of_parts(spark):
    texts = ["", "-", "--", "A", "A - B", " A-B", "\tA\n-\xa0B\x1f-C ", "é - É", "A-", "-B", "a-b-c-d", " - ", "\x7f-\x7f", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", *[dash_part("s", i).alias(f"p{i}") for i in range(4)])
    assert "split(" not in optimized(df)
    for r in df.collect():
        parts = r.s.split("-") if r.s is not None else []
        assert [r[f"p{i}"] for i in range(4)] == [parts[i].strip() if i < len(parts) else None for i in range(4)]
