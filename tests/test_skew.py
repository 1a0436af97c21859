"""Hot-key behaviour: one fund holds a third of all holdings.  The weights
are checked against a brute-force pandas computation with broadcasts
disabled, so the share-of-total join runs as a sort-merge join through
AQE's skew handling."""

import datetime as dt
import random

import pandas as pd

from stocksieve.operators import conversations as CV
from stocksieve.operators import screens as S

SUFFIX = " - 13F-HR Q3 filing x"
DAY = dt.date(2024, 6, 1)


def skewed_holdings(n=30_000, funds=50, tickers=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        fund = "hot fund" if i % 3 == 0 else f"fund {rnd.randrange(funds)}"
        rows.append((f"c{rnd.randrange(tickers)}", fund + SUFFIX, rnd.randrange(0, 1000), dt.date(2024, 5, 20), DAY))
    return rows


def test_weights_with_hot_fund_match_brute_force(spark):
    rows = skewed_holdings()
    h = spark.createDataFrame(rows, "cusip string, fund_name string, prn_amt bigint, trans_date date, date_insert date")
    cmap = spark.createDataFrame([(f"c{i}", f"T{i % 250}") for i in range(400)], "cusip string, ticker string")
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1k")
        got = S.thirteen_f_weights(h, cmap, "2024-06-01", sort=False).toPandas()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

    pdf = pd.DataFrame(rows, columns=["cusip", "fund_name", "prn_amt", "trans_date", "date_insert"])
    m = pdf.merge(pd.DataFrame({"cusip": [f"c{i}" for i in range(400)], "ticker": [f"T{i % 250}" for i in range(400)]}))
    per = m.groupby(["ticker", "fund_name"], as_index=False)["prn_amt"].max()
    per["fund"] = per["fund_name"].str[:-21].str.strip().str.title()
    per["weight"] = (per["prn_amt"] * 100.0 / per.groupby("fund")["prn_amt"].transform("sum")).round(4)
    want = sorted(zip(per["ticker"], per["fund"], per["weight"]))
    have = sorted(zip(got["ticker"], got["fund_name"], got["weight"]))
    assert len(have) == len(want)
    for (t1, f1, w1), (t2, f2, w2) in zip(have, want):
        assert (t1, f1) == (t2, f2) and abs(w1 - w2) < 1e-4


def test_hot_conversation_metrics(spark):
    # one conversation with a third of all turns
    rows = [(0 if i % 3 == 0 else i, i, "user" if i % 2 == 0 else "assistant", "x" * (i % 7)) for i in range(3_000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = {r.conv_id: r for r in CV.metrics(conv).collect()}
    hot = [r for r in rows if r[0] == 0]
    turns = {r[1]: r[2] for r in hot}
    answered = sum(1 for t, role in turns.items() if role == "user" and turns.get(t + 1) == "assistant")
    assert m[0].n_turns == len(hot) and m[0].n_answered == answered
    last = {r.conv_id: r.turn for r in CV.last_message(conv).collect()}
    assert last[0] == max(r[1] for r in hot)
