"""The price source by dates: filters that reach the provider, daily increments, and answers of one ticker."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.sources import prices

DAY = date(2024, 1, 1)


def provider(tickers, since, until):
    """Ten days of closes; fails where more is asked for than the tests do."""
    if set(tickers) - set("ABC") or since < DAY:
        raise ValueError(f"asked for {tickers} since {since}")
    for t in tickers:
        for k in range(10):
            if since <= DAY + timedelta(days=k) <= until:
                yield t, DAY + timedelta(days=k), float(ord(t) + k)


def test_filters_reach_the_provider(spark):
    read = spark.read.format(prices.register_dated_source(spark, provider, "dated_test")).option("batch", "2")
    some = read.load().where("ticker IN ('A', 'B', 'C') AND date > DATE '2024-01-02' AND date <= DATE '2024-01-05'").where(F.col("close") > 0)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "ticker" in plan and sorted({(r.ticker, r.date.day) for r in some.collect()}) == [(t, d) for t in "ABC" for d in (3, 4, 5)]
    assert some.rdd.getNumPartitions() == 2 and "Filter" in plan and "date#" not in plan.split("Filter")[1].split("\n")[0]  # only the close is left to Spark
    assert read.option("tickers", "A,B").load().where("ticker = 'B' AND date = DATE '2024-01-03'").count() == 1
    assert read.load().where("ticker = 'A' AND date >= DATE '2024-01-09' AND date < DATE '2024-01-04'").count() == 0
    bare = spark.read.format("dated_test")
    with pytest.raises(Exception, match="ask for tickers"):
        bare.load().count()
    with pytest.raises(Exception, match="asked for"):
        bare.load().where("ticker = 'D'").count()


def test_daily_increments(spark, tmp_path):
    name = prices.register_dated_source(spark, provider, "dated_stream")

    def run(until):
        stream = spark.readStream.format(name).option("tickers", "A,B,C").option("since", "2024-01-01").option("until", until).option("batch", "2").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.ticker, r.date.day) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("2024-01-03") == [(t, d) for t in "ABC" for d in (1, 2, 3)]
    assert run("2024-01-03") == [(t, d) for t in "ABC" for d in (1, 2, 3)]
    assert run("2024-01-06") == [(t, d) for t in "ABC" for d in range(1, 7)]


def test_symbols_of_a_table(spark):
    symbols = spark.createDataFrame([("a",), ("B",), ("A",), (None,)], "ticker string")
    got = prices.fetch_prices(symbols, lambda: provider, DAY, DAY + timedelta(days=1), batch=1)
    assert sorted((r.ticker, r.date.day, r.close) for r in got.collect()) == [("A", 1, 65.0), ("A", 2, 66.0), ("B", 1, 66.0), ("B", 2, 67.0)]


def test_flat_answer_of_one_ticker(spark):
    flat = spark.createDataFrame([(DAY, 1.0, 9.0, float("nan")), (DAY + timedelta(days=1), 2.0, 9.0, 5.0)], "date date, Open double, High double, Close double")
    assert sorted((r.ticker, r.date.day, r.close) for r in prices.from_answer(flat, ["a.ns"]).collect()) == [("A.NS", 1, None), ("A.NS", 2, 5.0)]
    wide = spark.createDataFrame([(DAY, 1.0, 2.0)], "date date, A double, B double")
    assert sorted((r.ticker, r.close) for r in prices.from_answer(wide, ["A", "B"]).collect()) == [("A", 1.0), ("B", 2.0)]
    with pytest.raises(ValueError):
        prices.from_answer(flat, ["A", "B"])
