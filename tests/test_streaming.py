import datetime as dt

from pyspark.sql import functions as F

from stocksieve.sources import ingest as I
from stocksieve.sources import landing as L
from stocksieve.streaming.landing import batch_writer, ingest_landed, read_ingested

D = dt.date(2024, 6, 1)


def _pages(spark):
    home = spark.createDataFrame([("T1 - A", "2024-06-01", "1", "1", D)],
                                 "company string, date_filling string, total_value string, price string, date_insert date")
    big = spark.createDataFrame([("T2", "B", "1%", "1", D)],
                                "ticker string, company string, percent_owned string, count string, date_insert date")
    low = spark.createDataFrame([(f"T{i}", f"C{i}", f"{i}%", D) for i in range(40)],
                                "ticker string, company string, percent_owned string, date_insert date")
    sup = spark.createDataFrame([("T4 - D", "T4", "1", "$1", D)],
                                "company string, ticker string, count string, total_amount string, date_insert date")
    return L.home_pages(*[d.withColumn("row_key", F.monotonically_increasing_id() % 1000) for d in (home, big, low, sup)], rows_per_page=10)


def test_stream_restart_and_replayed_batch_do_not_duplicate(spark, tmp_dir):
    _pages(spark).repartition(4).write.parquet(f"{tmp_dir}/landing/drop=0")
    target, ckpt = f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    ingest_landed(spark, f"{tmp_dir}/landing/*", target, ckpt, I.parse_lows, max_files=1)
    tickers = sorted(r.ticker for r in read_ingested(spark, target).collect())
    assert tickers == sorted(f"T{i}" for i in range(40))

    # restart over the same checkpoint: no new files, nothing written twice
    ingest_landed(spark, f"{tmp_dir}/landing/*", target, ckpt, I.parse_lows, max_files=1)
    assert sorted(r.ticker for r in read_ingested(spark, target).collect()) == tickers

    # batch 0 replayed twice (at-least-once foreachBatch): its folder is replaced, not appended to
    first = spark.read.parquet(f"{target}/batch=0")
    replay = spark.createDataFrame(first.collect(), first.schema)
    write = batch_writer(target)
    write(replay, 0)
    write(replay, 0)
    assert sorted(r.ticker for r in read_ingested(spark, target).collect()) == tickers
