import datetime as dt

from stocksieve.operators import catalogue as K

from .conftest import rows

D = dt.date(2024, 6, 1)


def test_run_sql_returns_none_on_error(spark):
    spark.createDataFrame([(1, "a")], "id int, s string").createOrReplaceTempView("cat_t")
    assert rows(K.run_sql(spark, "select id from cat_t")) == [(1,)]
    assert rows(K.run_sql(spark, {"query": "select s from cat_t"})) == [("a",)]
    assert K.run_sql(spark, "select missing_col from cat_t") is None
    assert K.run_sql(spark, "selec nonsense") is None


def test_every_named_screen_is_there():
    assert sorted(K.SCREENS) == ["13f_filing", "52week_lows", "custom_insider", "custom_screen", "insider_buying_activity",
                                 "insider_buying_activity_with_superinvestor", "screen_bigbet", "screen_magic"]
    assert sorted(K.TICKER_SCREENS) == ["yahoo_balance_sheet", "yahoo_cash_flow", "yahoo_holder", "yahoo_income", "yahoo_inside", "yahoo_meta", "yahoo_stock_history"]


def test_named_screen_and_ticker_as_a_value(spark):
    lows = spark.createDataFrame([("T1", "5%", D), ("T1", "5%", D), ("T2", "7%", dt.date(2024, 5, 31))],
                                 "ticker string, percent_owned string, date_insert date")
    assert rows(K.run_screen("52week_lows", lows, "2024-06-01")) == [("T1", "5%")]
    holdings = spark.createDataFrame([("c1", "acme - 13F-HR Q3 filing x", 5, dt.date(2024, 5, 20), D)], "cusip string, fund_name string, prn_amt bigint, trans_date date, date_insert date")
    cusips = spark.createDataFrame([("c1", "T1")], "cusip string, ticker string")
    assert rows(K.run_screen("13f_filing", holdings, "2024-06-01", cusip_map=cusips)) == [("T1", "Acme", 100.0)]
    meta = spark.createDataFrame(
        [("Steel", "ASIA", 70, "NasdaqGS", "America/New_York", "EQUITY", None, "Co", "T1", D),
         ("Oil", "EUROPE", 5, "NYSE", "America/New_York", "EQUITY", None, "Co2", "T1'; drop table x; --", D)],
        "industry string, sector string, fulltimeemployees bigint, fullexchangename string, "
        "exchangetimezonename string, instrumenttype string, irwebsite string, shortname string, "
        "symbol string, date_insert date")
    assert [r.industry for r in K.run_ticker("yahoo_meta", {"metadata": meta}, "T1", D).collect()] == ["Steel"]
    odd = K.run_ticker("yahoo_meta", {"metadata": meta}, "T1'; drop table x; --", "2024-06-01")
    assert [r.industry for r in odd.collect()] == ["Oil"] and "symbol" not in odd.columns
