"""Files, pages, providers, saved tables, and whole runs over small made-up tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.config import ScreeningConfig
from rankloom.operators.fundamentals import page_metrics
from rankloom.operators.institutional import scan_holdings
from rankloom.plans import recovery, screen
from rankloom.sources import pages, prices
from rankloom.sources.store import Store
from rankloom.sources.universe_csv import read_universe
from rankloom.streaming import incremental

GOLDEN = """
<ul id="top-ratios"><li><span>Market Cap</span> <span>₹ <b>1,23,456</b> Cr.</span></li><li>P/E 20</li></ul>
<section id="quarters"><table><thead><tr><th></th><th>Dec 2023</th><th>Mar 2024</th></tr></thead>
 <tbody><tr><td>Sales&nbsp;+</td><td>1,000</td><td>1,150</td></tr></tbody></table></section>
<section id="profit-loss"><table><thead><tr><th></th><th>Mar 2023</th><th>Mar 2024</th><th>TTM</th></tr></thead>
 <tbody><tr><td>Sales +</td><td>4,000</td><td>5,000</td><td>9,999</td></tr></tbody></table></section>
<section id="shareholding"><table><thead><tr><th></th><th>Dec 2023</th><th>Mar 2024</th></tr></thead><tbody>
 <tr><td>Promoters +</td><td>50.10%</td><td>51.35%</td></tr><tr><td>FIIs +</td><td>10.00%</td><td>12.50%</td></tr>
 <tr><td>DIIs +</td><td>8.00%</td><td>7.25%</td></tr></tbody></table></section>
"""


def metrics(spark, html):
    df = spark.createDataFrame([("A", "u", html)], "ticker string, page_url string, html string")
    r = page_metrics(pages.parse_pages(df)).first()
    return r.market_cap_cr, r.quarterly_growth_pct, r.annual_growth_pct, r.promoter_change_pct


def test_golden_page(spark):
    assert metrics(spark, GOLDEN) == (123456.0, 15.0, 25.0, 1.25)
    df = spark.createDataFrame([("A", "u", GOLDEN)], "ticker string, page_url string, html string")
    who = spark.createDataFrame([("a ", 1)], "ticker string, extra int")
    for holder, want in (("FII", (10.0, 12.5, 2.5)), ("DII", (8.0, 7.25, -0.75))):
        r = scan_holdings(who, pages.parse_pages(df), holder).first()
        assert (r.previous_holding_pct, r.latest_holding_pct, r.holding_change_pct) == want and (r.previous_period, r.latest_period) == ("Dec 2023", "Mar 2024")
        assert r.scan_notes == "ok" and r.market_cap == 123456e7


VARIANTS = {
    "class instead of id": (GOLDEN.replace('id="top-ratios"', 'class="a company-ratios"'), (123456.0, 15.0, 25.0, 1.25)),
    "standalone accounts": (GOLDEN.replace('id="profit-loss"', 'id="profit-loss-consolidated"'), (123456.0, 15.0, 25.0, 1.25)),
    "no section": (GOLDEN.replace('id="quarters"', ""), (123456.0, None, 25.0, 1.25)),
    "one number": (GOLDEN.replace("<td>1,000</td>", "<td></td>"), (123456.0, None, 25.0, 1.25)),
    "revenue row first": (GOLDEN.replace("<tr><td>Sales&nbsp;+", "<tr><td>Revenue</td><td>100</td><td>150</td></tr><tr><td>Sales&nbsp;+"), (123456.0, 50.0, 25.0, 1.25)),
    "nested label": (GOLDEN.replace("Sales&nbsp;+", '<button><a href="#">Sales&nbsp;<i>+</i></a></button>'), (123456.0, 15.0, 25.0, 1.25)),
    "left open": (GOLDEN.replace("</td>", "").replace("</li>", "").replace("</tr>", "").replace("</th>", ""), (123456.0, 15.0, 25.0, 1.25)),
    "two tables": (GOLDEN.replace("</table></section>\n<section id=\"profit", "</table><table><tr><td>Sales</td><td>1</td><td>9</td></tr></table></section>\n<section id=\"profit"), (123456.0, 15.0, 25.0, 1.25)),
    "no market cap number": (GOLDEN.replace("1,23,456", "-").replace("20</li>", "20</li><li>Market Cap 7</li>"), (None, 15.0, 25.0, 1.25)),
    "null page": (None, (None, None, None, None)),
    "no markup": ("plain & simple < text", (None, None, None, None)),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_page_variants(spark, name):
    assert metrics(spark, VARIANTS[name][0]) == VARIANTS[name][1]


def test_fetch_falls_back_and_tries_again():
    waits, calls = [], []

    def client(url):
        calls.append(url)
        if url.endswith("/gone/consolidated/"):
            return 404, ""
        if url.endswith("/busy/consolidated/") and len(calls) < 3:
            return 503, ""
        if url.endswith("/down/consolidated/"):
            raise OSError("no route")
        return 200, "text"

    assert pages.fetch("h/gone/consolidated/", client) == ("h/gone/", "text", None)
    calls.clear()
    assert pages.fetch("h/busy/consolidated/", client, waits.append) == ("h/busy/consolidated/", "text", None) and waits == [2.0, 4.0]
    assert pages.fetch("h/down/consolidated/", client, waits.append) == ("h/down/consolidated/", None, "no route")


def test_fetch_pages(spark):
    wanted = spark.createDataFrame([("A", "h/a/consolidated/"), ("B", "h/b/consolidated/")], "ticker string, page_url string")
    make = lambda: lambda url: (200, url) if "/a/" in url else (404, "")
    got = {r.ticker: (r.page_url, r.html, r.error) for r in pages.fetch_pages(wanted, make, pause=0.0).where("ticker = 'A'").collect()}
    assert got == {"A": ("h/a/consolidated/", "h/a/consolidated/", None)}


def test_universe_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ticker,Name,P/E\nabc,First,1\nABC,Second,2\n,x,3\nnan,y,4\nq.ns,Z,5\n")
    got = {r.ticker: (r.name, r.symbol, r["p/e"]) for r in read_universe(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"ABC": ("First", "ABC.NS", "1"), "Q.NS": ("Z", "Q.NS", "5")}
    with pytest.raises(FileNotFoundError):
        read_universe(spark, str(tmp_path / "none.csv"))
    (tmp_path / "u.csv").write_text("Symbol\na\n")
    with pytest.raises(ValueError, match="Ticker"):
        read_universe(spark, str(tmp_path / "u.csv"))


def test_wide_prices(spark):
    wide = spark.createDataFrame([(date(2024, 1, 1), 1.0, 9.0, float("nan")), (date(2024, 1, 2), 2.0, 9.0, 3.0)], "date date, `a.ns` double, `A.NS2` double, b double")
    got = {(r.ticker, r.date.day): r.close for r in prices.from_wide(wide).collect()}
    assert got == {("A.NS", 1): 1.0, ("A.NS", 2): 2.0, ("A.NS2", 1): 9.0, ("A.NS2", 2): 9.0, ("B", 1): None, ("B", 2): 3.0}
    with pytest.raises(ValueError, match="not split"):
        prices.from_wide(wide.withColumnRenamed("b", "Close"))


def provider(tickers, span):
    for t in tickers:
        for k in range(400):
            yield t, date(2023, 1, 1) + timedelta(days=k), 100.0 + k * (1 + len(t) % 3) * 0.5


def test_price_source(spark):
    spark.dataSource.register(prices.price_source(provider, "test_prices"))
    df = spark.read.format("test_prices").option("tickers", "A,B,C,D,E").option("batch", "2").load()
    assert df.rdd.getNumPartitions() == 3 and df.groupBy("ticker").count().count() == 5
    assert prices.batches(list("abcde"), 2) == [["a", "b"], ["c", "d"], ["e"]]


def fake_pages(spark):
    def of(wanted):
        raw = wanted.select("ticker", "page_url", F.when(F.col("ticker") != "BBBB", F.lit(GOLDEN)).alias("html"), F.when(F.col("ticker") == "BBBB", "HTTP status 500").alias("error"))
        return pages.parse_pages(raw)

    return of


def panel_of(spark):
    return lambda rows: spark.createDataFrame([x for t in ("A.NS", "BBBB.NS", "CC.NS") for x in provider([t], "6y")], prices.PANEL).join(rows.select(F.upper("symbol").alias("ticker")).distinct(), "ticker", "left_semi")


def test_full_run_and_recovery(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ticker,Name\na,Alpha\nbbbb,Beta\ncc,Gamma\nzz,None\n")
    store, config, told = Store(spark, str(tmp_path / "out")), ScreeningConfig(backtest_months=2), []
    quotes = spark.createDataFrame(list(provider(["^NSEI"], "6y")), prices.PANEL)
    run = screen.run_full(read_universe(spark, str(tmp_path / "t.csv")), panel_of(spark), fake_pages(spark), config, store, quotes, progress=lambda *x: told.append(x))
    assert sorted(r.ticker for r in run.momentum.collect()) == ["A", "BBBB", "CC"] and told[-1][:2] == (4, 4)
    notes = {r.ticker: r.fundamental_notes for r in run.fundamentals.collect()}
    assert notes["A"] == "passed" and notes["BBBB"] == "Page fetch failed: HTTP status 500"
    assert sorted(r.ticker for r in run.final.collect()) == ["A", "CC"]
    assert {r.series for r in run.curves.collect()} == {"Strategy", "Nifty 50"} and run.periods.count() == 2
    assert "(Alpha)" in run.periods.first().selected_names and run.allocation.count() == 2 and run.performance.count() == 2
    back = recovery.recover(store, config)
    assert sorted(r.ticker for r in back["final"].collect()) == ["A", "CC"] and back["periods"].count() == 2
    bare = screen.run_full(None, panel_of(spark), None, config, store, use_saved_returns=True)
    assert bare.fundamentals.count() == 0 and bare.final.count() == 3 and bare.curves.count() > 0
    path = store.export_csv("final", bare.final)
    assert open(path).readline().startswith("Ticker,Name,YFinance Ticker")
    none = screen.run_full(read_universe(spark, str(tmp_path / "t.csv")).limit(0), panel_of(spark), fake_pages(spark), config, store)
    assert [df.count() for df in none.tables().values()] == [0] * 8
    assert recovery.passing(spark.createDataFrame([("a", "True"), ("b", "no")], "ticker string, fundamental_pass string")).count() == 1


def test_holding_run_and_recovery(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Ticker\na\nbbbb\ncc\n")
    store, config = Store(spark, str(tmp_path / "out")), ScreeningConfig()
    rows = read_universe(spark, str(tmp_path / "t.csv"))
    got = screen.run_holdings(rows, fake_pages(spark), panel_of(spark), "fii", config, store)
    assert sorted(r.ticker for r in got["fii_top"].collect()) == ["A", "CC"] and sorted(r.ticker for r in got["fii_final"].collect()) == ["A", "CC"]
    seen = []

    def again(wanted):
        seen.extend(r.ticker for r in wanted.collect())
        return fake_pages(spark)(wanted)

    told = []
    screen.scan(rows, again, "fii", store, lambda *x: told.append(x[:2]), parts=3)
    assert seen == ["BBBB"] and told == [(1, 3), (2, 3), (3, 3)]  # only the failed one is asked for again
    assert recovery.newest_scan(store, "fii") == "fii_partial" and recovery.preview(store, "fii")["fii_all"].count() == 3
    assert sorted(r.ticker for r in recovery.recover_holdings(store, "fii", panel_of(spark), config)["fii_final"].collect()) == ["A", "CC"]

    def broken(rows):
        raise OSError("no prices")

    assert "no prices" in screen.finish_holdings(store.load("fii_partial"), broken, "fii", config, store)["fii_momentum"].first().momentum_error
    with pytest.raises(FileNotFoundError):
        recovery.recover_holdings(Store(spark, str(tmp_path / "empty")), "dii", panel_of(spark), config)
    with pytest.raises(FileNotFoundError):
        recovery.recover(Store(spark, str(tmp_path / "empty")), config)


def test_incremental_scan(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("pages", "out", "cp"))
    page = lambda t: spark.createDataFrame([(t, "u", GOLDEN, None)], incremental.PAGE_SCHEMA)
    for tickers in (["A"], ["B"]):
        for t in tickers:
            page(t).coalesce(1).write.mode("append").parquet(src)
        incremental.scan_new_pages(spark, src, out, cp, "FII").awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.ticker, r.holding_change_pct) for r in got.collect()) == [("A", 2.5), ("B", 2.5)] and got.select("batch").distinct().count() == 2


def test_market_caps(spark):
    from rankloom.operators.institutional import enrich_market_cap
    from rankloom.sources.market_caps import fetch_market_caps

    rows = spark.createDataFrame([("a.ns", None), ("B.NS", 3e9), ("C.NS", None), ("D.NS", None), (None, None), ("A.NS", None)], "symbol string, market_cap double")

    def client(symbols):
        if "D.NS" in symbols:
            raise OSError("down")
        return {"A.NS": 2e9, "C.NS": 0}

    found = fetch_market_caps(rows, lambda: client, batch=1)
    assert {r.symbol: r.market_cap for r in found.collect()} == {"A.NS": 2e9, "C.NS": None, "D.NS": None}
    assert sorted((r.symbol or "", r.market_cap_cr or 0.0) for r in enrich_market_cap(rows, found).collect()) == [("", 0.0), ("A.NS", 200.0), ("B.NS", 300.0), ("C.NS", 0.0), ("D.NS", 0.0), ("a.ns", 200.0)]


def test_settings_within_ranges_and_top_ten(spark):
    from rankloom.operators.backtest import backtest_top10

    config = ScreeningConfig.within_ranges(backtest_months=99, top_momentum=1, final_count=50)
    assert (config.backtest_months, config.top_momentum, config.final_count) == (36, 10, 50)
    picks = spark.createDataFrame([("A", "a.ns", 2.0, 10.0), ("CC", "CC.NS", 1.0, 20.0)], "ticker string, symbol string, score double, cmp double")
    curve, allocation = backtest_top10(picks, panel_of(spark)(picks), 2)
    assert curve.count() > 30 and allocation.count() == 2
