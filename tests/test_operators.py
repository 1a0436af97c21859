import datetime as dt
import json

import pytest
from pyspark.sql import functions as F


from stocksieve.operators import adhoc as A
from stocksieve.operators import consensus as C
from stocksieve.operators import context as X
from stocksieve.operators import conversations as CV
from stocksieve.operators import fundamentals as FU
from stocksieve.operators import screens as S
from stocksieve.sources.snapshots import SnapshotStore, prepare_for_write

from .conftest import rows

DAY = "2024-06-01"
D = dt.date(2024, 6, 1)
SUFFIX = " - 13F-HR Q3 filing x"


def holdings(spark, data):
    return spark.createDataFrame(
        [(c, f, p, dt.date(2024, 5, 20), D) for c, f, p in data],
        "cusip string, fund_name string, prn_amt bigint, trans_date date, date_insert date")


def test_13f_weights_share_denominator_across_raw_names(spark):
    cmap = spark.createDataFrame([("c1", "AAA"), ("c2", "BBB"), ("c3", "CCC")], "cusip string, ticker string")
    h = holdings(spark, [("c1", "acme fund" + SUFFIX, 30), ("c1", "acme fund" + SUFFIX, 10),
                         ("c2", "  ACME FUND" + SUFFIX, 10),  # other raw spelling, same display name
                         ("c3", "zero fund" + SUFFIX, 0)])
    got = {(r.ticker, r.fund_name): r.weight for r in S.thirteen_f_weights(h, cmap, DAY).collect()}
    assert got[("AAA", "Acme Fund")] == 75.0 and got[("BBB", "Acme Fund")] == 25.0
    assert got[("CCC", "Zero Fund")] is None  # all-zero fund: no division by zero


def test_13f_lookback_and_snapshot(spark):
    cmap = spark.createDataFrame([("c1", "AAA")], "cusip string, ticker string")
    old = spark.createDataFrame([("c1", "f" + SUFFIX, 5, dt.date(2024, 4, 2), D),
                                 ("c1", "f" + SUFFIX, 5, dt.date(2024, 5, 30), dt.date(2024, 5, 31))],
                                "cusip string, fund_name string, prn_amt bigint, trans_date date, date_insert date")
    assert S.thirteen_f_weights(old, cmap, DAY).count() == 0


def test_custom_insider_rerun_is_idempotent(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    t = spark.createDataFrame([("T1", D, "x", "1", 5), ("T1", D, "y", "2", 7)],
                              "ticker string, date_filling date, company string, price string, total_value bigint")
    store.write("screen_insider", t, DAY)
    store.write("screen_insider", t, DAY)
    assert rows(S.custom_insider(store.read("screen_insider", DAY), DAY), "ticker", "total_value") == [("T1", 12)]
    store.append("screen_insider", t, DAY)  # the source's append-twice behaviour double counts
    assert rows(S.custom_insider(store.read("screen_insider", DAY), DAY), "ticker", "total_value") == [("T1", 24)]


def test_store_evolves_schema_and_prunes_partitions(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    store.append("t", spark.createDataFrame([(1, "a")], "id int, Name string"), "2024-01-01")
    store.append("t", spark.createDataFrame([(2, "b", 3.5)], "id int, NAME string, extra double"), "2024-01-02")
    allrows = sorted(rows(store.read("t"), "id", "name", "extra"))
    assert allrows == [(1, "a", None), (2, "b", 3.5)]
    day = store.read("t", "2024-01-02")
    from .test_plans import plan_text
    plan = plan_text(day)
    assert "PartitionFilters: [isnotnull(date_insert" in plan
    assert rows(day, "id") == [(2,)]


def test_prepare_for_write(spark):
    df = spark.createDataFrame([(["a", "b"], float("nan"), "12.0", 1)], "`Tags` array<string>, v double, prn_amt string, `My Col` int")
    out = prepare_for_write(df)
    assert out.columns == ["tags", "v", "prn_amt", "my_col"]
    assert rows(out) == [("a,b", None, 12, 1)]
    assert dict(out.dtypes)["my_col"] == "bigint"


def test_consensus_and_top_k(spark):
    a = spark.createDataFrame([("T1",), ("T2",), ("T2",)], "ticker string")
    b = spark.createDataFrame([("T2",), ("T3",), (None,)], "ticker string")
    cons = C.consensus({"x": a, "y": b})
    assert sorted(rows(cons)) == [("T1", 1, "x"), ("T2", 2, "x,y"), ("T3", 1, "y")]
    top = C.top_candidates(cons, 2)
    assert rows(top, "ticker", "confidence") == [("T2", "Medium"), ("T1", "Low")]


def test_ownership_and_completeness(spark):
    w = spark.createDataFrame([("A", f"f{i}", 1.0) for i in range(6)] + [("B", "f1", 11.0), ("C", "f1", 2.0)],
                              "ticker string, fund_name string, weight double")
    assert rows(C.ownership_limits(w), "ticker") == [("C",)]
    s = spark.createDataFrame([("A", "Tech", "1M", "5"), ("A", "Energy", "1M", "5"), ("B", "Tech", None, "1"), ("C", "Tech", "2M", "3")],
                              "ticker string, sector string, market_cap string, pe string")
    assert rows(C.complete_only(s, ["sector", "market_cap", "pe"], ["sector", "market_cap"]), "ticker") == [("C",)]


def test_sector_amounts_count_once(spark):
    insider = spark.createDataFrame([("A", 10), ("A", 5), ("B", 7), ("C", 1), ("X", 9)], "ticker string, amount bigint")
    screen = spark.createDataFrame([("A", "Tech"), ("A", "Energy"), ("A", "Tech"), ("B", "Tech"), ("C", None)], "ticker string, sector string")
    got = {r.sector: (r.total_amount, r.n_tickers) for r in C.sector_concentration(insider, screen).collect()}
    assert got == {C.MIXED_SECTOR: (15, 1), "Tech": (7, 1), None: (1, 1)}


def test_fund_ids_are_dense_in_name_order(spark):
    names = [f"fund {k:03d}" for k in range(200)] + [None]
    weights = spark.createDataFrame([(n,) for n in names * 2], "fund_name string").repartition(7)
    got = {r.fund_name: r.fund_id for r in C.fund_mapping(weights).collect()}
    assert got == {n: k + 1 for k, n in enumerate(names)}


def test_conversation_operators(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"),
                                  (2, 3, "user", "q")], "conv_id long, turn long, role string, text string")
    assert sorted(rows(CV.last_message(conv), "conv_id", "turn")) == [(1, 2), (2, 3)]
    sysd = {(r.conv_id, r.turn): (r.role, r.text) for r in CV.with_system_prompt(conv, "SYS").collect()}
    assert sysd[(1, 0)] == ("system", "SYS") and sysd[(2, 3)] == ("system", "SYS") and sysd[(1, 1)][0] == "assistant"
    m = {r.conv_id: r for r in CV.metrics(conv).collect()}
    assert m[1].n_turns == 3 and m[1].n_answered == 1 and m[2].n_answered == 0
    t = {r.conv_id: json.loads(r.messages) for r in CV.transcripts(conv, page_size=2).where("page = 0").collect()}
    assert t[1] == [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}]


def test_adhoc_guard_rails(spark):
    spark.createDataFrame([(i, f"n{i}") for i in range(150)], "id int, name string").createOrReplaceTempView("adhoc_t")
    ok = json.loads(A.answer(spark, "select id, name from adhoc_t order by id").first()[0])
    assert len(ok["result"]) == A.MAX_ROWS and ok["result"][0] == {"id": 0, "name": "n0"}
    assert A.answer(spark, "select * from adhoc_t").first()[0] == A.ERROR_JSON
    assert A.answer(spark, "select nope from adhoc_t").first()[0] == A.ERROR_JSON
    assert A.answer(spark, "drop table adhoc_t").first()[0] == A.ERROR_JSON
    nulls = json.loads(A.answer(spark, "select cast(null as int) as x from adhoc_t limit 1").first()[0])
    assert nulls == {"result": [{"x": None}], "total": 1, "truncated": False}
    assert ok["total"] == 150 and ok["truncated"]
    down = json.loads(A.answer(spark, "select id % 3 as k, id from adhoc_t order by k desc, id").first()[0])["result"]
    assert [(r["k"], r["id"]) for r in down] == sorted(((i % 3, i) for i in range(150)), key=lambda p: (-p[0], p[1]))[:100]
    assert json.loads(A.answer(spark, "with t as (select id from adhoc_t where id > (select max(id) from adhoc_t) - 2) select count(*) as n from t").first()[0])["result"] == [{"n": 2}]
    refused = ["/* c */ drop view adhoc_t", "select /*+ COALESCE(1) */ * from adhoc_t", "select id from parquet.`/root/testdata/sf0.001/part.parquet`",
               "from adhoc_t insert into other select id", "select 1 as a; drop view adhoc_t", "select id, id from adhoc_t", "select t.* from adhoc_t t",
               "select cast('x' as int) as a from adhoc_t", "select raise_error('no') as a from adhoc_t", "set spark.sql.ansi.enabled=false", "", "select a from (select * from adhoc_t)"]
    for sql in refused:
        assert A.answer(spark, sql).first()[0] == A.ERROR_JSON, sql
    assert spark.table("adhoc_t").count() == 150


def test_adhoc_gate_judges_what_names_resolve_to(spark):
    spark.range(5).selectExpr("id as x", "cast(id as string) as s", "date'2024-01-31' as d").createOrReplaceTempView("gate_v")
    spark.createDataFrame([(1, "p")], "x int, secretcol string").createOrReplaceTempView("gate_other")
    spark.udf.register("gate_udf", lambda x: x)
    views = {"gate_v"}
    refused = [
        "select reflect('java.lang.System', 'getProperty', 'user.dir') from gate_v", "select java_method('java.lang.System', 'getProperty', 'user.dir') as a from gate_v",
        "select x, s.secretcol from (with gate_other as (select x from gate_v) select x from gate_other) a, gate_other s",
        "select secretcol from gate_other", "with gate_v as (select secretcol from gate_other) select secretcol from gate_v",
        "select x from gate_v where x in (select x from gate_other)", "select id from range(5)", "select input_file_name() as f from gate_v",
        "select gate_udf(x) as y from gate_v", "select x from gate_v where rand() > 0.5", "select current_user() as u", "select version() as v from gate_v",
        "create table gate_t as select x from gate_v", "insert into gate_v select x from gate_v", "select x from gate_v; drop view gate_v", "explain select x from gate_v",
        "select transform(x) using 'cat' as y from gate_v", "select spark_partition_id() as p from gate_v", "select nosuch from gate_v", "select uuid() as u from gate_v"]
    for sql in refused:
        assert A.check_sql(spark, sql, views), sql
        assert A.run_sql(spark, sql, views) is None, sql
    allowed = [
        "with a as (select x from gate_v) select a.x, b.x as z from a join a b on a.x = b.x", "select distinct x from gate_v order by x desc limit 3",
        "select s, count(x) as c, sum(x) as t, percentile_approx(x, 0.5) as m from gate_v group by s having count(x) > 0",
        "select x, row_number() over (partition by s order by x) as r from gate_v", "select x from gate_v where exists (select 1 from gate_v w where w.x = gate_v.x)",
        "select case when x > 1 then 'a' else nvl(s, 'b') end as c, round(x / 3, 2) as q, x between 1 and 2 as b, upper(substr(s, 1, 1)) as u from gate_v",
        "select year(d) as y, date_sub(d, 3) as e, date_trunc('month', d) as m, date_format(d, 'yyyy') as f, d - interval 1 day as i from gate_v",
        "select explode(array(1, 2)) as e from gate_v", "select transform(array(x), q -> q + 1) as t from gate_v", "select x from gate_v union all select 1 as x"]
    for sql in allowed:
        assert A.check_sql(spark, sql, views) is None, (sql, A.check_sql(spark, sql, views))
        assert A.run_sql(spark, sql, views).collect() is not None


def test_adhoc_runs_its_query_once(spark):
    ran = spark.sparkContext.accumulator(0)
    spark.createDataFrame(spark.sparkContext.parallelize([(i, i % 2) for i in range(10)], 1).map(lambda r: (ran.add(1), r)[1]), "x long, k long").createOrReplaceTempView("once_v")
    before = ran.value
    got = A.answer(spark, "select k, x from once_v order by k desc, x", limit=3, views={"once_v"})
    assert json.loads(got.first()[0]) == {"result": [{"k": 1, "x": 1}, {"k": 1, "x": 3}, {"k": 1, "x": 5}], "total": 10, "truncated": True}
    assert ran.value - before <= 20  # sampled for the sort's ranges, then read
    assert "parquet" in got._jdf.queryExecution().executedPlan().toString().lower()  # answered from what the run wrote


def test_sections_come_in_pages_with_every_row(spark):
    df = spark.createDataFrame([(f"T{i:03d}", float(i) if i % 10 else None) for i in range(100)], "ticker string, weight double")
    pages = X.render_sections([("s", df, ["ticker", "weight"], [("weight", True)]), ("e", df.where("weight < 0"), ["ticker"], [("ticker", False)])], rows_per_page=30)
    got = {(r.section, r.page): r for r in pages.collect()}
    assert sorted(got) == [("e", 0), ("s", 0), ("s", 1), ("s", 2), ("s", 3)]
    assert [got["s", k].n_shown for k in range(4)] == [30, 30, 30, 10] and {got["s", k].n_rows for k in range(4)} == {100}
    assert got["s", 0].text.startswith("ticker | weight\nT099 | 99.0000\nT098 | 98.0000\n") and got["s", 3].text.endswith("\nT080 | \nT090 | ")
    lines = [x for k in range(4) for x in got["s", k].text.split("\n")[1:]]
    assert len(lines) == 100 and len(set(lines)) == 100
    assert got["e", 0].n_rows == 0 and got["e", 0].text == "ticker\n"


def test_later_prompts_carry_earlier_reports(spark, tmp_dir):
    df = spark.createDataFrame([("AB", 1), ("CD", 2)], "ticker string, n int")
    names = {s for secs, _ in X.PROMPTS.values() for s in secs}
    sections = X.render_sections([(n, df, ["ticker", "n"], [("ticker", False)]) for n in sorted(names)], rows_per_page=1)
    seen = []

    def answer(prompt, prompts, reports):
        seen.append((prompt, sorted(r.prompt_name for r in reports.collect())))
        assert prompts.count() == (2 if X.PROMPTS[prompt][0] else 1)
        return spark.createDataFrame([(prompt, f"report of {prompt}")], "prompt_name string, report_text string")

    prompts, reports = X.report_chain(sections, answer, "2024-06-01", tmp_dir)
    order = list(X.PROMPTS)
    assert seen == [(p, sorted(order[:k])) for k, p in enumerate(order)]
    assert {r.prompt_name: r.report_text for r in reports.collect()} == {p: f"report of {p}" for p in order}
    text = {(r.prompt_name, r.page): r.prompt_text for r in prompts.collect()}
    senior = text["senior_report", 0]
    assert senior == "Data as of 2024-06-01\n\n" + "\n\n".join(f"### report {p}\nreport of {p}" for p in order[:4])
    assert "report of insider_report" in text["week_low_report", 0] and "report of" not in text["week_low_report", 1]
    assert text["insider_report", 1].count("CD | 2") == 3 and "AB" not in text["insider_report", 1]


def test_item_names_stay_apart(spark):
    long_a, long_b = "Some Item " * 6 + "alpha", "Some Item " * 6 + "beta"
    rows_ = [("T", "annual", D, long_a, 1.0, D), ("T", "annual", D, long_b, 2.0, D), ("T", "annual", D, "Total Debt", 4.0, D), ("T", "annual", D, None, 8.0, D)]
    df = spark.createDataFrame(rows_, "symbol string, freq string, date date, line_item string, value double, date_insert date")
    got = {r.line_item: r.value for r in FU.named_items(df).collect()}
    cut = ("some_item_" * 6)[:59]
    assert got == {cut: 1.0, cut[:53] + "_00002": 2.0, "total_debt": 4.0, None: 8.0}
    assert {(r.line_item, r.clashed) for r in FU.item_names(df.where("line_item like 'S%'")).collect()} == {(cut, True), (cut[:53] + "_00002", True)}
    assert FU.unlisted_items(df, ["total_debt"]).count() == 3


def test_two_statement_sources_are_aligned_on_the_item(spark):
    docs = lambda body: FU.parse_statement_docs(spark.createDataFrame([("T", D, body)], "symbol string, date_insert date, body string"))
    aligned = FU.align_statements(docs('{"Debt": {"2023-12-31": 1.005, "2022-12-31": null}, "Only Annual": {"2023-12-31": 2}}'),
                                  docs('{"Debt": {"2024-03-31": 3, "2023-12-31": 4}, "Only Quarterly": {"2024-03-31": 5}}'))
    got = {r.line_item: (r.annual, r.quarterly) for r in aligned.collect()}
    d = dt.date
    assert got == {"Debt": ({d(2022, 12, 31): None, d(2023, 12, 31): 1.0 if got["Debt"][0][d(2023, 12, 31)] == 1.0 else 1.01}, {d(2023, 12, 31): 4.0, d(2024, 3, 31): 3.0}),
                   "Only Annual": ({d(2023, 12, 31): 2.0}, None), "Only Quarterly": (None, {d(2024, 3, 31): 5.0})}
    periods = FU.periods_of(aligned)
    assert sorted((r.freq, r.line_item, str(r.date)) for r in periods.collect()) == [
        ("annual", "Debt", "2022-12-31"), ("annual", "Debt", "2023-12-31"), ("annual", "Only Annual", "2023-12-31"),
        ("quarterly", "Debt", "2023-12-31"), ("quarterly", "Debt", "2024-03-31"), ("quarterly", "Only Quarterly", "2024-03-31")]


def test_store_replaces_keys_inside_a_day(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    df = lambda rs: spark.createDataFrame(rs, "symbol string, v long")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "symbol string")
    store.replace_keys("t", df([("A", 1), ("B", 2), ("C", 3)]), keys("A", "B", "C"), "2024-01-01")
    store.replace_keys("t", df([("A", 9)]), keys("A"), "2024-01-02")
    store.replace_keys("t", df([("B", 20), ("B", 21)]), keys("B", "C"), "2024-01-01")  # C came back empty
    assert sorted((r.symbol, r.v) for r in store.read("t", "2024-01-01").collect()) == [("A", 1), ("B", 20), ("B", 21)]
    assert [(r.symbol, r.v) for r in store.read("t", "2024-01-02").collect()] == [("A", 9)]
    store.replace_keys("t", df([]), keys("A", "B"), "2024-01-01")  # nothing left: the day is empty
    assert store.read("t", "2024-01-01").count() == 0 and store.read("t").count() == 1
    store.write("t", df([]), "2024-01-02")
    assert store.read("t").count() == 0
    store.write("t", df([("A", 1)]).withColumn("more", F.lit("x")), "2024-01-03")
    assert store.versions("t") == [1, 2] and [r.more for r in store.read("t").collect()] == ["x"]
    with pytest.raises(ValueError):
        store.write("t", spark.createDataFrame([("A", "text")], "symbol string, v string"), "2024-01-04")


def test_ticker_mentions_and_list(spark):
    docs = spark.createDataFrame([(1, "Buy AAPL and MSFT; AAPL again. Not TOOLONG or x."), (2, None)], "doc_id long, text string")
    assert sorted(rows(X.ticker_mentions(docs))) == [(1, "AAPL", 2), (1, "MSFT", 1)]
    resp = spark.createDataFrame([("AAPL, MSFT,, AAPL\n",)], "text string")
    assert sorted(rows(X.ticker_list(resp))) == [("AAPL",), ("MSFT",)]


def test_statement_pivot_and_unpivot(spark):
    long = spark.createDataFrame(
        [("T1", "annual", D, "Total Debt", 1.004, D), ("T1", "annual", D, "Total Debt", 2.0, D),
         ("T1", "quarterly", D, "Total Assets", 5.0, D), ("T1", "annual", D, "Unknown Item", 9.0, D)],
        "symbol string, freq string, date date, line_item string, value double, date_insert date")
    wide = FU.statement_wide(long, ["total_debt", "total_assets"])
    got = {r.freq: (r.total_debt, r.total_assets) for r in wide.collect()}
    assert got == {"annual": (3.0, None), "quarterly": (None, 5.0)}
    assert sorted(rows(FU.statement_long(wide, ["total_debt", "total_assets"]), "freq", "line_item")) == [
        ("annual", "total_debt"), ("quarterly", "total_assets")]


def test_store_read_with_explicit_schema(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    store.append("t", spark.createDataFrame([(1, "a")], "id int, name string"), "2024-01-01")
    store.append("t", spark.createDataFrame([(2, "b", 3.5)], "id int, name string, extra double"), "2024-01-02")
    df = store.read("t", "2024-01-01", schema="id bigint, name string, extra double, date_insert date")
    assert rows(df) == [(1, "a", None, D.replace(month=1, day=1))]


def test_store_widens_types_across_days(spark, tmp_dir):
    store = SnapshotStore(spark, tmp_dir)
    store.append("w", spark.createDataFrame([(1, 1.5)], "n int, x float"), "2024-01-01")
    store.append("w", spark.createDataFrame([(2**40, 2.25)], "n bigint, x double"), "2024-01-02")
    df = store.read("w")
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["x"] == "double"
    assert sorted(rows(df, "n", "x")) == [(1, 1.5), (2**40, 2.25)]


def test_stage_writes_once_and_reads_back(spark, tmp_dir):
    from stocksieve.sources.snapshots import stage
    from .test_plans import plan_text
    src = spark.range(100).selectExpr("id", "id * 2 as twice").where("id % 7 = 0")
    staged = stage(spark, src, f"{tmp_dir}/staged")
    assert sorted(rows(staged)) == sorted(rows(src))
    plan = plan_text(staged)
    assert "Scan parquet" in plan and "Range" not in plan  # lineage cut at the written table
