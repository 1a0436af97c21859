"""Jobs that need nothing of one another run at once; holdings are typed once."""

import threading

import pytest
from pyspark.sql import functions as F

from stocksieve.functions import html as H
from stocksieve.session import side_by_side
from stocksieve.sources.snapshots import SnapshotStore

from .test_once import optimized


def test_jobs_meet_and_results_keep_their_names(spark):
    together = threading.Barrier(3, timeout=20)
    got = side_by_side(spark, {n: lambda n=n: (together.wait(), spark.range(n).count())[1] for n in range(3)})
    assert got == {0: 0, 1: 1, 2: 2} and list(got) == [0, 1, 2]
    assert side_by_side(spark, {}) == {}


def test_all_jobs_have_ended_when_one_fails(spark):
    ended = []

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        side_by_side(spark, {"a": fails, "b": lambda: ended.append(spark.range(5).count())})
    assert ended == [5]


def test_tables_of_a_day_are_written_at_once(spark, tmp_dir):
    together = threading.Barrier(2, timeout=20)

    class Store(SnapshotStore):
        def write(self, table, df, as_of=None):
            together.wait()
            super().write(table, df, as_of)

    store = Store(spark, tmp_dir)
    frames = {t: spark.createDataFrame([(t, i) for i in range(3)], "ticker string, n int") for t in ("a", "b")}
    store.write_many(frames, "1998-06-01")
    for t in frames:
        assert sorted((r.ticker, r.n) for r in store.read(t, "1998-06-01").collect()) == [(t, 0), (t, 1), (t, 2)]


def test_holdings_of_a_store_day_are_typed_once(spark):
    from stocksieve.operators.snapshot_day import Landed, snapshot_tables
    empty = spark.createDataFrame([], "date_insert date, page bigint, html string")
    row = "<tr>" + "".join(f"<td>{c}</td>" for c in ("A\nB", "COM", "1", "2", "3", "SH", "None", "SOLE", "None", "3", "0", "None")) + "</tr>"
    page = f"<table summary='Form 13F-NT Header Information'><tr></tr><tr></tr><tr></tr>{row}{row}<tr><td>short</td></tr></table>"
    docs = spark.createDataFrame([("f", "1998-05-01", page)], "fund_name string, filing_date string, html string").withColumn("date_insert", F.lit("1998-06-01").cast("date"))
    tables = snapshot_tables(Landed(empty, empty, empty, empty, docs.select("fund_name", "filing_date", "date_insert", "html")))
    good, bad = tables["sec_13f"], tables["sec_13f_quarantine"]
    assert [(r.name_of_issuer, r.value, r.put_call) for r in good.collect()] == [("A B", 2, None)]
    assert [r.name_of_issuer for r in bad.collect()] == ["short"]
    for df in (good, bad):
        assert "lambda" not in optimized(df)


@pytest.mark.parametrize("text, expect", [
    ("a<script>b</script>c<STYLE x>d</Style>e<!-- f --\n-->g", "aceg"), ("a<script>b<!-- c </script>d --> e", "ad --> e"), ("a<!-- <script> -->b</script>c", "ab</script>c"),
    ("a<scripts>b</scripts>", "a<scripts>b</scripts>"), ("a<script>open", "a<script>open"), ("plain", "plain"), ("", ""), (None, None)])
def test_noise(spark, text, expect):
    assert spark.createDataFrame([(text,)], "h string").select(H.strip_noise("h")).first()[0] == expect
