"""Queries over the test tables, one for each operator. The SQL that must give the same rows is in ``oracles``."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import oracles
from rankloom.config import DEFAULT_GATE, DEFAULT_WEIGHTS, FundamentalThresholds, ScreeningConfig
from rankloom.functions import holdings
from rankloom.functions import numeric as num
from rankloom.operators import asof
from rankloom.operators import backtest as bt
from rankloom.operators import fundamentals as fund
from rankloom.operators import institutional as inst
from rankloom.operators import performance as perf
from rankloom.operators import portfolio, rank, universe
from rankloom.operators import segmented as seg
from rankloom.operators.interval import interval_join
from rankloom.operators.momentum import all_positive, score_momentum, weighted
from rankloom.operators.returns import trailing_returns, universe_returns
from rankloom.plans import recovery, screen
from rankloom.sources import market_caps, pages, prices, store
from rankloom.sources import tables as t
from rankloom.sources import universe_csv as universe_csv_source
from rankloom.sources.scratch import scratch_dir
from rankloom.streaming import retry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.ORACLES
PLACES = 4


def query(f: Query) -> Query:
    """Register a query. Dates come out as ISO text, which every client reads alike."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = f(spark, sf_dir)
        return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in rows.dtypes if kind == "date"})

    QUERIES[f.__name__] = shown
    return f


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """Long products and sums differ in the last bits between engines: shown to four places."""
    return rows.withColumns({c: num.rounded(F.col(c), PLACES) for c in columns})


@query
def universe_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    brand = F.concat(F.lit("  "), F.lower("p_brand"), F.when(key % 3 == 0, ".ns").otherwise(""), F.lit("\t"))
    raw = t.table(spark, sf_dir, "part").select(key, F.when(key % 50 == 0, " ").when(key % 51 == 0, "nan").when(key % 53 == 0, F.lit(None)).otherwise(brand).alias("ticker"), F.col("p_name").alias("name"))
    return universe.normalize_universe(raw, F.col("p_partkey")).select("ticker", "name", "symbol", "page_url")


@query
def price_panel_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.supplier_panel(spark, sf_dir)


@query
def price_panel_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.nation_panel(spark, sf_dir)


@query
def price_panel_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.part_panel(spark, sf_dir)


@query
def price_panel_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.user_panel(spark, sf_dir)


@query
def trailing_returns_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_returns(t.nation_panel(spark, sf_dir))


@query
def trailing_returns_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_returns(t.part_panel(spark, sf_dir))


@query
def price_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some symbols are known without any close, and half of the universe is not known at all."""
    panel = t.supplier_panel(spark, sf_dir).withColumn("close", F.when(~F.endswith("ticker", F.lit("7.NS")), F.col("close")))
    return universe_returns(t.supplier_universe(spark, sf_dir), panel).select("ticker", "symbol", "name", "cmp", "data_points", "price_error", "ret_5", "ret_252")


@query
def momentum_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_momentum(trailing_returns(t.supplier_panel(spark, sf_dir)))


@query
def momentum_score_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_momentum(trailing_returns(t.nation_panel(spark, sf_dir)))


@query
def momentum_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = trailing_returns(t.user_panel(spark, sf_dir))
    return rets.select("ticker", "data_points", num.rounded(weighted(DEFAULT_WEIGHTS, True)).alias("score"), all_positive([f"ret_{h}" for h in DEFAULT_GATE]).alias("passes"))


@query
def topn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_momentum(trailing_returns(t.supplier_panel(spark, sf_dir)))
    return rank.top_n(scored, [F.desc("score"), F.asc("ticker")], 100).select("ticker", "score")


@query
def nulls_last_marketcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("market_cap_cr"))
    return rows.orderBy(*rank.nulls_last("market_cap_cr", "ticker"))


@query
def nulls_last_marketcap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in order, the missing values last."""
    rows = t.table(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("market_cap_cr"))
    return rows.orderBy(*rank.nulls_last("market_cap_cr", "ticker"))


@query
def forward_fill_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.forward_fill(t.user_panel(spark, sf_dir))


@query
def segmented_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values of every event's key, where nine in ten events are of one key: the last known value, the first, the
    largest so far and how many there were, by hours."""
    hot = F.when(F.col("event_id") % 10 < 9, F.lit("HOT.NS")).otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".NS")))
    rows = t.table(spark, sf_dir, "events").select(hot.alias("ticker"), "ts", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    scans = {"filled": seg.last_known("value"), "base": seg.first_known("value"), "top": seg.running_max("value"), "n_known": seg.running_count("value")}
    return seg.segmented_scan(rows, ["ticker"], ["ts", "event_id"], F.date_trunc("hour", "ts"), scans).drop("ts")


@query
def asof_nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the last price that a supplier of the customer's nation shipped at, up to the order's date, and the
    next one after it."""
    prices_ = t.table(spark, sf_dir, "lineitem").join(t.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    daily = prices_.groupBy(F.col("s_nationkey").alias("nation"), F.to_date("l_shipdate").alias("shipped")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    wanted = t.table(spark, sf_dir, "orders").join(t.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey"))
    wanted = wanted.select("o_orderkey", "nation", F.to_date("o_orderdate").alias("ordered"))
    return asof.asof_both(wanted, daily, ["nation"], "ordered", "shipped", {"shipped": "next_shipped", "price": "next_price"}, few=True)  # one moment a nation and day


@query
def period_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of every ticker within each holding period: how many, the lowest and the highest."""
    panel = t.supplier_panel(spark, sf_dir)
    day = lambda c: F.unix_date(c)
    periods = bt.rebalance_schedule(bt.calendar_of(panel), 12).select("pid", day("entry").alias("from_day"), day("exit").alias("to_day"))
    met = interval_join(periods, panel.withColumn("day", day("date")), "from_day", "to_day", "day", 32)
    return met.groupBy("pid", "ticker").agg(F.count("close").alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query
def rebalance_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.rebalance_schedule(bt.calendar_of(t.nation_panel(spark, sf_dir)), 6).select("pid", "entry", "exit")


@query
def signal_date_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.rebalance_schedule(bt.calendar_of(t.supplier_panel(spark, sf_dir)), 12).select("pid", "entry", "signal")


def supplier_run(spark: SparkSession, sf_dir: str) -> bt.WalkForward:
    return bt.WalkForward(t.supplier_panel(spark, sf_dir))


def nation_run(spark: SparkSession, sf_dir: str) -> bt.WalkForward:
    return bt.WalkForward(t.nation_panel(spark, sf_dir))


@query
def score_at_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_run(spark, sf_dir).scores


@query
def top10_per_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_run(spark, sf_dir).picks.select("pid", "ticker", "score", "rank")


@query
def tier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_run(spark, sf_dir).picks.select("pid", "ticker", "rank", "weight")


@query
def period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(supplier_run(spark, sf_dir).growth, "growth")


@query
def walk_forward_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(supplier_run(spark, sf_dir).curve(), "value")


@query
def walk_forward_curve_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(nation_run(spark, sf_dir).curve(), "value")


@query
def walk_forward_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".NS")).alias("ticker"), F.col("s_name").alias("name"))
    return supplier_run(spark, sf_dir).ledger(names)


@query
def walk_forward_ledger_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_run(spark, sf_dir).ledger()


#: The first candidate of the second label has no quotes, so that its second is taken; the third label has none at all.
CANDIDATES = {"First nation": ("N1.NS",), "Second": ("NONE", "N2.NS"), "Nothing": ("NOBODY",)}


@query
def benchmark_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = supplier_run(spark, sf_dir).curve()
    return settled(bt.benchmark_curves(curve, t.nation_panel(spark, sf_dir), CANDIDATES), "value")


@query
def first_available_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.first_available(t.nation_panel(spark, sf_dir), ["NONE", "N3.NS", "N1.NS"]).select("ticker", "date", "close")


@query
def normalized_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(perf.normalized(nation_run(spark, sf_dir).curve()), "value")


@query
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = t.nation_panel(spark, sf_dir).select("date", F.col("ticker").alias("series"), F.col("close").alias("value"))
    return perf.performance_summary(curves)


@query
def walk_forward_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perf.performance_summary(supplier_run(spark, sf_dir).curve())


def supplier_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = t.supplier_panel(spark, sf_dir)
    return score_momentum(universe_returns(t.supplier_universe(spark, sf_dir), panel))


@query
def current_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.current_allocation(supplier_momentum(spark, sf_dir))


@query
def buy_and_hold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve, _ = bt.buy_and_hold(supplier_momentum(spark, sf_dir), t.supplier_panel(spark, sf_dir))
    return settled(curve, "value")


@query
def buy_and_hold_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.buy_and_hold(supplier_momentum(spark, sf_dir), t.supplier_panel(spark, sf_dir))[1]


@query
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("raw"))
    priorities = t.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("raw"))
    props = t.table(spark, sf_dir, "events").select(F.col("props").alias("raw"))
    balances = t.table(spark, sf_dir, "customer").select(F.concat(F.lit("₹ 1,"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" Cr.%")).alias("raw"))
    every = brands.unionByName(priorities).unionByName(props).unionByName(balances)
    return every.groupBy("raw").agg(F.count("*").alias("n")).withColumn("number", num.parse_number(F.col("raw")))


@query
def clean_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_type", F.lit("  + "), "p_brand", F.lit(" "))
    rows = t.table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).withColumn("label", num.clean_label(raw))
    return rows.select("label", "n", num.starts_with_any(F.col("label"), ("standard", "Promo", "ECONOMY")).alias("matches"))


@query
def last_two_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = t.quarterly_sales(spark, sf_dir).select("ticker", F.struct("cells").alias("row"))
    return cells.select("ticker", holdings.trailing_growth(holdings.numeric_cells(F.col("row"))).alias("growth_pct"))


@query
def holding_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.weekly_holdings(spark, sf_dir)
    both = [c.alias(f"{h.lower()}_{n}") for h, labels in inst.HOLDER_LABELS.items() for n, c in holdings.holding_change(F.col("rows"), labels).items()]
    return rows.select("ticker", *both)


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return t.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("ticker"),
        F.when(key % 9 != 0, balance).alias("market_cap_cr"),
        F.when(key % 7 != 0, (key % 40).cast("double")).alias("quarterly_growth_pct"),
        F.when(key % 11 != 0, (key % 60).cast("double")).alias("annual_growth_pct"),
        F.when(key % 13 != 0, (key % 17 - 8).cast("double")).alias("promoter_change_pct"),
    )


@query
def fundamental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fund.apply_rules(stand_ins(spark, sf_dir)).where("fundamental_pass").select("ticker", *fund.METRICS)


@query
def fundamental_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fund.apply_rules(stand_ins(spark, sf_dir)).select("ticker", "fundamental_pass", "fundamental_notes")


@query
def exact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on values with more than two decimals, ties of the binary number among them: eighths of the part's price."""
    part = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 8).alias("market_cap_cr"), (F.col("l_quantity") / 40).alias("quarterly_growth_pct"), (F.col("l_tax") * 12.5).alias("annual_growth_pct"), (F.col("l_discount") * 1000.125).alias("promoter_change_pct"))
    return fund.apply_rules(part, FundamentalThresholds(1e6, 10.0, 15.0, 5.0)).select("l_orderkey", "l_linenumber", "fundamental_notes")


LENIENT = FundamentalThresholds(1000.0, 5.0, 10.0, 5.0)


def supplier_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fund.screen_fundamentals(rank.top_n(supplier_momentum(spark, sf_dir), [F.desc("score"), F.asc("ticker")], 100), pages.parse_pages(t.supplier_pages(spark, sf_dir)), LENIENT)


@query
def page_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics read from the HTML of a page for each supplier."""
    return fund.page_metrics(pages.parse_pages(t.supplier_pages(spark, sf_dir))).select("ticker", *fund.METRICS)


@query
def final_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = supplier_screen(spark, sf_dir).where("fundamental_pass")
    return rank.top_n(passed, [F.desc("score"), F.asc("ticker")], 100).select("ticker", "score", "fundamental_notes", *fund.METRICS)


def user_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of every user; each fifth has no page."""
    rows = t.weekly_holdings(spark, sf_dir)
    users = t.table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id").distinct()
    every = users.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    every = every.withColumns({"symbol": F.concat("ticker", F.lit(".NS")), "page_url": universe.page_url(F.col("ticker"))})
    cap = F.array(F.concat(F.lit("Market Cap ₹ "), (F.crc32(F.col("ticker").cast("binary")) % 9000).cast("string"), F.lit(" Cr.")))
    found = rows.where("NOT endswith(ticker, '5')").select("ticker", F.concat(F.lit("https://pages.example.com/company/"), "ticker", F.lit("/")).alias("page_url"), F.lit(None).cast("string").alias("error"), cap.alias("items"), F.array(F.lit("shareholding")).alias("sections"), "rows")
    return inst.scan_holdings(every, found, "FII")


@query
def institutional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_scan(spark, sf_dir).select("ticker", "page_url", "scan_notes", *inst.HOLDING_FIELDS)


@query
def institutional_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inst.shortlist(user_scan(spark, sf_dir).drop("market_cap_cr"), 50).select("ticker", "holding_change_pct")


@query
def institutional_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rising = inst.shortlist(user_scan(spark, sf_dir).drop("market_cap_cr"), 500)
    panel = t.user_panel(spark, sf_dir)
    scored = score_momentum(universe_returns(rising, panel), gate=(5,))
    return rank.top_n(scored, [F.desc("score"), F.asc("ticker")], 3).select("ticker", "score", "holding_change_pct")


@query
def marketcap_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.table(spark, sf_dir, "supplier").withColumn("symbol", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ns")))
    have = s.select("symbol", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") * 1e6).alias("market_cap"))
    lookup = s.where("s_suppkey % 3 <> 0").select(F.upper("symbol").alias("symbol"), F.when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.abs("s_acctbal") * 1e6).alias("market_cap"))
    return inst.enrich_market_cap(have, lookup)


def saved_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan saved in two goes: the first failed for each third supplier, the second did some of them again."""
    key = F.col("s_suppkey")
    s = t.table(spark, sf_dir, "supplier").select(key, F.concat(F.lit("S"), key.cast("string")).alias("ticker"))
    note = F.when(key % 3 == 0, F.lit(f"{fund.FETCH_FAILED}: timeout")).otherwise("ok")
    once = s.where("s_suppkey % 10 < 8").select("ticker", F.lit(1).alias("scan_order"), note.alias("scan_notes"), key.cast("double").alias("market_cap_cr"), F.lit(0.5).alias("holding_change_pct"))
    again = s.where("s_suppkey % 10 < 4").select("ticker", F.lit(2).alias("scan_order"), F.when(key % 6 == 0, F.lit(f"{fund.FETCH_FAILED}: busy")).otherwise("missing FII row").alias("scan_notes"), key.cast("double").alias("market_cap_cr"), F.lit(None).cast("double").alias("holding_change_pct"))
    return once.unionByName(again)


@query
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inst.pending(t.supplier_universe(spark, sf_dir).where("NOT startswith(ticker, 'X')"), inst.completed(saved_scan(spark, sf_dir))).select("ticker", "name")


@query
def resume_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = inst.completed(saved_scan(spark, sf_dir)).drop("scan_order")
    new = resume_pending(spark, sf_dir).select("ticker", "name", F.lit("ok").alias("scan_notes"))
    return inst.resumed(done, new)


@query
def unpivot_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all nations under their symbols, made wide and melted."""
    names = [f"N{k}.NS" for k in range(25)]
    curves = t.nation_panel(spark, sf_dir).select("date", F.col("ticker").alias("series"), F.col("close").alias("value"))
    plain = perf.wide(curves, names).toDF("date", *[n.removesuffix(".NS") for n in names])
    return perf.long(plain, [n.removesuffix(".NS") for n in names])


@query
def unpivot_curve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of all nations, made wide and melted."""
    names = [f"N{k}" for k in range(25)]
    curves = t.nation_panel(spark, sf_dir).select("date", F.regexp_replace("ticker", r"\.NS$", "").alias("series"), F.col("close").alias("value"))
    return perf.long(perf.wide(curves, names), names)


@query
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inst.scan_counts(user_scan(spark, sf_dir))


@query
def text_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ["True", "1", "YES", "false", "0", "", "y"])), (F.col("s_suppkey") % 8 + 1).cast("int"))
    flag = F.when(F.col("s_suppkey") % 8 < 7, word)
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", num.text_bool(flag).alias("passed"))


@query
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "n/a").when(F.col("p_partkey") % 4 == 1, "NaN").otherwise(F.col("p_size").cast("string")).alias("Holding Change %"), F.col("p_brand").alias("Brand"))
    found = num.percent_like(raw.columns)
    return raw.withColumns({c: num.to_double(F.col(f"`{c}`")) for c in found}).withColumnsRenamed({c: "change_pct" for c in found}).drop("Brand")


@query
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.concat("p_brand", F.lit("&~* +"), F.col("p_size").cast("string"))
    return t.table(spark, sf_dir, "part").select("p_partkey", universe.page_url(symbol).alias("page_url"))


@query
def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.latest_rows(t.part_panel(spark, sf_dir))


@query
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the ratio list and the rows of the tables, out of the HTML of every supplier's page."""
    found = pages.parse_pages(t.supplier_pages(spark, sf_dir))
    cells = F.array_join(F.transform("rows", lambda r: F.concat(r["section"], F.lit(":"), r["label"], F.lit("="), F.array_join(F.transform(r["cells"], lambda c: F.concat_ws(" ", c["period"], c["raw"])), "|"))), ";")
    return found.select("ticker", F.array_join("items", ";").alias("items"), cells.alias("cells"))


def provider(tickers: list[str], span: str):
    """Sixty days of made-up closes, whatever the span."""
    for ticker in tickers:
        step = int(ticker[1:].split(".")[0]) + 1
        for k in range(60):
            yield ticker, date(2023, 1, 1) + timedelta(days=k), 100.0 + step * k * 0.5


@query
def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of all nations asked for in batches of ten, each a partition of the data source."""
    spark.dataSource.register(prices.price_source(provider, "screening_prices"))
    symbols = t.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".ns")).alias("s"))
    names = ",".join(sorted(r.s for r in symbols.collect()))
    return prices.long_panel(spark.read.format("screening_prices").option("tickers", names).option("batch", "10").option("span", "15mo").load())


def nation_provider(spark: SparkSession, sf_dir: str):
    """A stand-in for a price service: it has the closes of the nations' panel (25 tickers by trading dates, sorted), and
    fails when it is asked for other tickers than those."""
    rows = t.nation_panel(spark, sf_dir).where("close IS NOT NULL").toPandas().sort_values("date")
    known = {ticker: (of["date"].tolist(), of["close"].tolist()) for ticker, of in rows.groupby("ticker")}

    def answer(tickers: list[str], since: date, until: date):
        for ticker in tickers:
            days, closes = known[ticker]
            for k in range(bisect_left(days, since), bisect_right(days, until)):
                yield ticker, days[k], closes[k]

    return answer


@query
def pushed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year of three tickers, which the price source takes from the query's filters."""
    name = prices.register_dated_source(spark, nation_provider(spark, sf_dir), f"nation_prices_{uuid.uuid4().hex[:8]}")
    wanted = F.col("ticker").isin("N3.NS", "N7.NS", "N11.NS") & F.col("date").between(F.lit(date(1997, 1, 1)), F.lit(date(1997, 12, 31)))
    return spark.read.format(name).load().where(wanted & (F.col("close") > 0))


@query
def streamed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All closes of the nations by daily increments, in two runs of one stream."""
    folder, tickers = scratch_dir(spark, "stream"), ",".join(f"N{k}.NS" for k in range(25))
    name = prices.register_dated_source(spark, nation_provider(spark, sf_dir), f"nation_stream_{uuid.uuid4().hex[:8]}")
    for until in ("1996-06-30", "2010-12-31"):
        rows = spark.readStream.format(name).option("tickers", tickers).option("since", "1990-01-01").option("until", until).option("batch", "10").load()
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(prices.PANEL).parquet(f"{folder}/out")


@query
def fetched_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of every nation's symbol, asked for on the executors in batches of ten."""
    answer = nation_provider(spark, sf_dir)
    symbols = t.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".ns")).alias("ticker"))
    found = t.nation_panel(spark, sf_dir).select("ticker").distinct()
    wanted = symbols.join(found, F.upper(symbols["ticker"]) == found["ticker"], "left_semi")
    return prices.long_panel(prices.fetch_prices(wanted, lambda: answer, date(1994, 1, 1), date(1996, 12, 31), batch=10))


@query
def flat_ticker_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat answer for one ticker: date, open and close without a ticker."""
    one = t.nation_panel(spark, sf_dir).where("ticker = 'N5.NS'").select(F.col("date").alias("Date"), (F.col("close") / 2).alias("Open"), F.col("close").alias("Close"))
    return prices.from_answer(one, ["n5.ns"], date="Date")


@query
def wide_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each nation and back: every symbol has a row for every date, with or without a close."""
    names = [f"N{k}.NS" for k in range(25)]
    curves = t.nation_panel(spark, sf_dir).select("date", F.col("ticker").alias("series"), F.col("close").alias("value"))
    return prices.from_wide(perf.wide(curves, names))


def page_client():
    """A site whose consolidated pages are missing for each fifth company."""

    def get(url: str) -> tuple[int, str]:
        key = int(url.split("/company/S")[1].split("/")[0])
        if key % 5 == 0 and url.endswith(pages.CONSOLIDATED):
            return 404, ""
        return 200, f'<ul id="top-ratios"><li>Market Cap {key + 1}.50 Cr.</li></ul>'

    return get


@query
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticker = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    wanted = t.table(spark, sf_dir, "supplier").select(ticker.alias("ticker"), universe.page_url(ticker).alias("page_url"))
    found = pages.parse_pages(pages.fetch_pages(wanted, page_client, pause=0.0))
    return found.select("ticker", "page_url", "error", fund.market_cap(F.col("items")).alias("market_cap_cr"))


def site_in_run(run: int):
    """Which suppliers' pages a site can't give in each of three runs."""

    def get(url: str) -> tuple[int, str]:
        key = int(url.split("/company/S")[1].split("/")[0])
        down = (key % 5 == 1, key % 7 == 0, key % 21 == 0)[run]
        return (503, "") if down else (200, f'<ul id="top-ratios"><li>Market Cap {key + 1}.50 Cr.</li></ul>')

    return lambda: get


@query
def retried_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's page by a stream in three runs: half of them are wanted in the first and half in the second; what
    fails comes back a run later, and is given up after two tries."""
    ticker = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    wanted = t.table(spark, sf_dir, "supplier").select("s_suppkey", ticker.alias("ticker"), universe.page_url(ticker).alias("page_url"))
    folder = scratch_dir(spark, "retry")
    for run in range(3):
        if run < 2:
            retry.want(wanted.where(F.col("s_suppkey") % 2 == run), f"{folder}/wanted")
        else:
            retry.beat(spark, f"{folder}/wanted")
        retry.fetch_wanted(spark, f"{folder}/wanted", f"{folder}/out", f"{folder}/checkpoint", site_in_run(run), attempts=2, backoff=0.0).awaitTermination()
    found = pages.parse_pages(spark.read.schema(retry.FETCHED).parquet(f"{folder}/out"))
    return found.select("ticker", "error", "tries", fund.market_cap(F.col("items")).alias("market_cap_cr"))


def cap_client():
    return lambda symbols: {s: float(s[1:].split(".")[0]) * 1e7 if int(s[1:].split(".")[0]) % 4 else 0 for s in symbols if not s.startswith("S1")}


@query
def fetched_market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that leaves symbols out and knows others as zero."""
    rows = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ns")).alias("symbol"))
    return inst.enrich_market_cap(rows, market_caps.fetch_market_caps(rows, cap_client))


@query
def universe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker file written and read, the first of equal tickers by its place in the file."""
    key = F.col("p_partkey")
    ticker = F.concat(F.lower("p_brand"), F.when(key % 3 == 0, ".ns").otherwise(""))
    folder = f"{scratch_dir(spark, 'universe')}/ticker.csv"
    t.table(spark, sf_dir, "part").coalesce(1).sortWithinPartitions("p_partkey").select(ticker.alias("Ticker"), F.col("p_name").alias("Name")).write.option("header", True).csv(folder)
    return universe_csv_source.read_universe(spark, folder).select("ticker", "name", "symbol", "page_url")


@query
def saved_and_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum list saved, saved again, exported and read from the file, under internal names and types."""
    saved = store.Store(spark, scratch_dir(spark, "store"))
    ranked = score_momentum(trailing_returns(t.nation_panel(spark, sf_dir)))
    saved.save("momentum", ranked.limit(1))
    saved.export_csv("momentum", saved.save("momentum", ranked))
    assert saved.newest(["returns", "momentum"]) == "momentum"
    return saved.load_csv("momentum", "ticker string, data_points long, cmp double, score double, ret_5 double, ret_252 double")


def user_pages(spark: SparkSession, sf_dir: str):
    """Parsed pages of the users that have one, for whatever table asks."""
    cap = F.array(F.concat(F.lit("Market Cap ₹ "), (F.crc32(F.col("ticker").cast("binary")) % 9000).cast("string"), F.lit(" Cr.")))
    found = t.weekly_holdings(spark, sf_dir).where("NOT endswith(ticker, '5')").select("ticker", F.concat(F.lit("https://pages.example.com/company/"), "ticker", F.lit("/")).alias("page_url"), F.lit(None).cast("string").alias("error"), cap.alias("items"), F.array(F.lit("shareholding")).alias("sections"), "rows")
    return lambda wanted: found.join(wanted.select("ticker"), "ticker", "left_semi")


def screened_users(spark: SparkSession, sf_dir: str):
    """Every user as a security, and their prices for whatever table asks."""
    users = t.table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id").distinct()
    rows = users.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"))
    rows = rows.withColumns({"symbol": F.concat("ticker", F.lit(".NS")), "page_url": universe.page_url(F.col("ticker"))})
    panel = t.user_panel(spark, sf_dir)
    return rows, lambda some: panel.join(some.select(F.upper("symbol").alias("ticker")).distinct(), "ticker", "left_semi")


@query
def holdings_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole holding screen in two saved parts, and made anew from what it saved."""
    rows, quoted = screened_users(spark, sf_dir)
    saved, config = store.Store(spark, scratch_dir(spark, "holdings")), ScreeningConfig(gate=(5,))
    screen.run_holdings(rows, user_pages(spark, sf_dir), quoted, "FII", config, saved, top=500, parts=2)
    return recovery.recover_holdings(saved, "FII", quoted, config, top=500)["fii_final"].select("ticker", "score", "holding_change_pct")


def full_run(spark: SparkSession, sf_dir: str) -> tuple[screen.Bundle, store.Store, ScreeningConfig]:
    saved, config = store.Store(spark, scratch_dir(spark, "run")), ScreeningConfig(thresholds=LENIENT)
    panel, site = t.supplier_panel(spark, sf_dir), pages.parse_pages(t.supplier_pages(spark, sf_dir))
    quoted = lambda rows: panel.join(rows.select(F.upper("symbol").alias("ticker")).distinct(), "ticker", "left_semi")
    found = lambda rows: site.join(rows.select("ticker"), "ticker", "left_semi")
    return screen.run_full(t.supplier_universe(spark, sf_dir), quoted, found, config, saved, parts=2), saved, config


@query
def full_run_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, momentum, fundamentals, final list and back-test in one run; the final list as it was saved."""
    run, *_ = full_run(spark, sf_dir)
    return run.final.select("ticker", "score", "fundamental_notes", *fund.METRICS)


@query
def dii_holdings_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holding screen of the other holder, saved in three parts."""
    rows, quoted = screened_users(spark, sf_dir)
    saved = store.Store(spark, scratch_dir(spark, "dii"))
    return screen.run_holdings(rows, user_pages(spark, sf_dir), quoted, "DII", ScreeningConfig(gate=(5,)), saved, top=500, parts=3)["dii_final"].select("ticker", "score", "holding_change_pct")


@query
def saved_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers, rises, failed fetches and the largest change of a scan in two parts, as observed while it was saved."""
    rows, _ = screened_users(spark, sf_dir)
    saved = store.Store(spark, scratch_dir(spark, "counts"))
    screen.scan(rows, user_pages(spark, sf_dir), "FII", saved, parts=2)
    found = screen.saved_counts(saved, "fii_partial")
    return spark.createDataFrame([tuple(found.values())], "n_tickers long, n_rising long, n_failed long, max_change double")


@query
def saved_momentum_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that saved its returns and no more: its momentum list is made of them, and the final list is the first of it."""
    saved, config = store.Store(spark, scratch_dir(spark, "fallback")), ScreeningConfig(final_count=40)
    panel = t.supplier_panel(spark, sf_dir)
    screen.price_returns(t.supplier_universe(spark, sf_dir), lambda rows: panel, saved)
    return recovery.recover(saved, config)["final"].select("ticker", "score")


@query
def bare_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without fundamentals, with settings brought into their ranges: every table is there, and how many rows each has."""
    config = ScreeningConfig.within_ranges(top_momentum=1, final_count=99_999, backtest_months=99)
    saved, panel = store.Store(spark, scratch_dir(spark, "bare")), t.supplier_panel(spark, sf_dir)
    tables = screen.run_full(t.supplier_universe(spark, sf_dir), lambda rows: panel, None, config, saved).tables()
    return spark.createDataFrame([(name, saved.rows(name)) for name in tables if name not in ("curves", "normalized_curves")], "name string, n long")


@query
def recovered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after its fundamentals were fetched: the final list is what passes of the saved parts, or the
    best by momentum where nothing does."""
    saved, config = store.Store(spark, scratch_dir(spark, "recovered")), ScreeningConfig(thresholds=LENIENT)
    panel, site = t.supplier_panel(spark, sf_dir), pages.parse_pages(t.supplier_pages(spark, sf_dir))
    momentum = screen.run_momentum(t.supplier_universe(spark, sf_dir), lambda rows: panel, config, saved)
    best = rank.top_n(momentum, [F.desc("score"), F.asc("ticker")], config.top_momentum)
    screen.screen_in_parts(best, lambda rows: site.join(rows.select("ticker"), "ticker", "left_semi"), config, saved, parts=2)
    return recovery.recover(saved, config)["final"].select("ticker", "score")


@query
def backtest_of_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk-forward curve of the symbols that pass the momentum gate today."""
    curve, _ = bt.backtest_top10(supplier_momentum(spark, sf_dir), t.supplier_panel(spark, sf_dir))
    return settled(curve, "value")
