"""Golden cases worked out by hand, and properties."""

from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.config import FundamentalThresholds, ScreeningConfig
from rankloom.functions import holdings
from rankloom.functions import numeric as num
from rankloom.operators import backtest as bt
from rankloom.operators import fundamentals as fund
from rankloom.operators import institutional as inst
from rankloom.operators import performance, portfolio, universe
from rankloom.operators.momentum import score_momentum
from rankloom.operators.returns import NO_HISTORY, NO_TICKER, trailing_returns, universe_returns
from rankloom.sources.tables import supplier_panel

PANEL = "ticker string, date date, close double"
DAY = date(2024, 1, 1)


def series(ticker, closes, start=DAY):
    return [(ticker, start + timedelta(days=k), None if c is None else float(c)) for k, c in enumerate(closes)]


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return row.select(column.alias("x")).first().x


def test_universe(spark):
    raw = spark.createDataFrame([(k, t) for k, t in enumerate([" abc ", "ABC", "", "nan", None, "xyz.ns", "\tq&a\r"])], "k int, ticker string")
    got = {r.ticker: (r.symbol, r.k, r.page_url.split("/company/")[1]) for r in universe.normalize_universe(raw, F.col("k")).collect()}
    assert got == {"ABC": ("ABC.NS", 0, "ABC/consolidated/"), "XYZ.NS": ("XYZ.NS", 5, "XYZ.NS/consolidated/"), "Q&A": ("Q&A.NS", 6, "Q%26A/consolidated/")}


NUMBERS = [("Market Cap ₹ 1,23,456.7 Cr.", 123456.7), ("45.2%", 45.2), ("-3.1%", -3.1), (".5", 5.0), ("-", None), ("", None), (None, None), ("3-MEDIUM", 3.0), ("FY-24", -24.0), ("1e+16", 1.0)]


def test_parse_number_and_labels(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS], "t string").select("t", num.parse_number(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in df.collect()] == NUMBERS
    assert one(spark, num.clean_label(F.col("t")), t=("Sales +", "string")) == "Sales"
    assert one(spark, num.clean_label(F.col("t")), t=(" Foreign   Institutional + ", "string")) == "Foreign Institutional"
    assert one(spark, num.text_bool(F.col("t")), t=("YES", "string")) is True
    assert one(spark, num.text_bool(F.col("t")), t=(None, "string")) is False
    assert one(spark, num.to_double(F.col("t")), t=("NaN", "string")) is None
    assert one(spark, num.percent_encode(F.col("t")), t=("a b*~&/é", "string")) == "a%20b%2A~%26%2F%C3%A9"
    assert num.percent_like(["1M Return", "5 days ret", "x %", "Name", "Holding %"]) == ["1M Return", "5 days ret", "x %", "Holding %"]


def test_rounding_is_numpys(spark):
    import numpy as np

    values = [k / 1000 for k in range(-3000, 3001)] + [None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(num.rounded(F.col("v")).alias("x")).collect()]
    assert got[-1] is None and got[:-1] == (np.round(np.array(values[:-1]), 2) + 0.0).tolist()
    assert str(got[2999]) == "0.0"  # no negative zero


@pytest.mark.parametrize(("values", "want"), [(["100", "110"], 10.0), (["0", "5"], None), (["5"], None), (["100", "", "150"], 50.0), ([None, "1,000", "1,150"], 15.0)])
def test_trailing_growth(spark, values, want):
    row = ("quarters", 0, "Sales +", [(f"Q{k}", v) for k, v in enumerate(values)] + [("TTM", "9,999")])
    kind = "struct<section:string,row_no:int,label:string,cells:array<struct<period:string,raw:string>>>"
    assert one(spark, holdings.trailing_growth(holdings.numeric_cells(F.col("r"))), r=(row, kind)) == want


def test_first_matching_row_wins(spark):
    rows = [("quarters", 1, "Sales", [("a", "1")]), ("quarters", 0, " revenue +", [("a", "2")]), ("other", 0, "Sales", [])]
    kind = "array<struct<section:string,row_no:int,label:string,cells:array<struct<period:string,raw:string>>>>"
    assert one(spark, holdings.metric_row(F.col("r"), "quarters", ("Sales", "Revenue")), r=(rows, kind)).label == " revenue +"
    assert one(spark, holdings.metric_row(F.col("r"), "nowhere", ("Sales",)), r=(rows, kind)) is None


def test_trailing_returns(spark):
    panel = spark.createDataFrame(series("A", [100, 101, 99, 100, 105, 112]) + series("B", [1, 2, 3, 4, 5]) + series("C", [0, 1, 2, 3, 4, 5]) + series("D", [10, None, 11, 12]) + series("E", [None, None]), PANEL)
    got = {r.ticker: r for r in trailing_returns(panel, (2, 5)).collect()}
    assert got["A"].ret_5 == 12.0 and got["A"].cmp == 112.0 and got["A"].data_points == 6
    assert got["B"].ret_5 is None and got["C"].ret_5 is None
    assert got["D"].ret_2 == 20.0 and got["D"].data_points == 3
    assert got["E"].data_points == 0 and got["E"].cmp is None


def test_status_column(spark):
    panel = spark.createDataFrame(series("A.NS", [1.0, 2.0]) + series("B.NS", [None]), PANEL)
    rows = spark.createDataFrame([("A", "a.ns", 7.0), ("B", "B.NS", 7.0), ("C", "C.NS", 7.0)], "ticker string, symbol string, cmp double")
    got = {r.ticker: (r.price_error, r.cmp, r.data_points) for r in universe_returns(rows, panel, panel.select("ticker"), (1,)).collect()}
    assert got == {"A": ("", 2.0, 2), "B": (NO_HISTORY, None, 0), "C": (NO_TICKER, None, 0)}


def test_momentum(spark):
    names = [5, 15, 21, 42, 63, 126]
    schema = "ticker string, " + ", ".join(f"ret_{h} double" for h in names)
    rows = spark.createDataFrame([("A", 10.0, 10.0, 10.0, None, 10.0, 10.0), ("B", 0.0, 10.0, 10.0, 10.0, 10.0, 10.0), ("C", None, 10.0, 10.0, 10.0, 10.0, 10.0)], schema)
    assert [(r.ticker, r.score) for r in score_momentum(rows).collect()] == [("A", 8.0)]
    with pytest.raises(ValueError, match="more than zero"):
        score_momentum(rows, {5: 0.0})
    with pytest.raises(KeyError):
        score_momentum(rows, gate=(84,))


@pytest.mark.parametrize(("n", "want"), [(1, [1.0]), (5, [0.2] * 5), (6, [0.14] * 5 + [0.3]), (10, [0.14] * 5 + [0.06] * 5), (12, [0.14] * 5 + [0.06] * 5 + [0.0] * 2)])
def test_tier_weights(spark, n, want):
    got = [r.w for r in spark.range(1, n + 1).select(portfolio.tier_weight(F.col("id"), F.lit(n)).alias("w")).collect()]
    assert got == pytest.approx(want) and sum(got) == pytest.approx(1.0)


def test_allocation(spark):
    rows = [(f"T{k}", f"t{k}.ns", 10.0 - k, 50.0 if k else 0.0) for k in range(6)] + [("T1.NS", "T1.NS", 1.0, 50.0)]
    got = portfolio.current_allocation(spark.createDataFrame(rows, "ticker string, symbol string, score double, cmp double")).orderBy("rank").collect()
    assert [(r.amount, r.shares) for r in got] == [(14000.0, None), *[(14000.0, 280.0)] * 4, (30000.0, 600.0)]
    assert got[0].cmp is None and got[0].name == "" and len(got) == 6


RULES = "market_cap_cr double, quarterly_growth_pct double, annual_growth_pct double, promoter_change_pct double"


def test_fundamental_rules(spark):
    rows = [(1500.0, 10.0, 15.0, 5.0), (1000.0, None, 20.0, 0.0), (None, None, None, None), (2000.0, 20.0, 20.0, -5.0)]
    got = [(r.fundamental_pass, r.fundamental_notes) for r in fund.apply_rules(spark.createDataFrame(rows, RULES)).collect()]
    assert got[0] == got[3] == (True, "passed")
    assert got[1] == (False, "market cap 1000.00 fails >= 1500.00; missing quarterly revenue growth; promoter holding change 9999.00 fails <= 5.00")
    assert got[2] == (False, "missing market cap; missing quarterly revenue growth; missing annual revenue growth; promoter holding change 9999.00 fails <= 5.00")
    assert fund.apply_rules(spark.createDataFrame([(1500.0, 10.0, 15.0, 0.0)], RULES), zero_is_missing=False).first().fundamental_pass


DATES = [date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1), date(2024, 3, 28), date(2024, 3, 31)]


@pytest.mark.parametrize(("months", "want"), [(2, [(DATES[3], DATES[6], DATES[2])]), (1, [(DATES[3], DATES[6], DATES[2])])])
def test_schedule(spark, months, want):
    """With two months the first period begins on the first date, before which there is no signal."""
    calendar = spark.createDataFrame([(d,) for d in DATES], "date date")
    assert [(r.entry, r.exit, r.signal) for r in bt.rebalance_schedule(calendar, months).collect()] == want


def test_forward_fill_and_stale_days(spark):
    panel = spark.createDataFrame(series("A", [10.0, 11.0, None]) + series("B", [None, 5.0, 6.0]), PANEL)
    got = {(r.ticker, r.date.day): r.filled for r in bt.forward_fill(panel).collect()}
    assert got == {("A", 1): 10.0, ("A", 2): 11.0, ("A", 3): 11.0, ("B", 1): None, ("B", 2): 5.0, ("B", 3): 6.0}
    dense = bt.forward_fill(panel).where("filled IS NOT NULL").select("ticker", "date", "close", "filled")
    assert sorted(map(repr, dense.collect())) == sorted(map(repr, bt.carry_forward(panel, bt.calendar_of(panel)).collect()))


def walk_by_loop(panel, months, weights, gate, capital=100_000.0):
    """An independent version: plain loops over periods and tickers."""
    from dateutil.relativedelta import relativedelta

    last = max(d for _, d, _ in panel)
    rows = [r for r in panel if r[1] > last - relativedelta(months=months + 9)]
    dates = sorted({d for _, d, c in rows if c is not None})
    filled = {}
    for t in {t for t, *_ in rows}:
        known, value = {d: c for u, d, c in rows if u == t and c is not None}, None
        for d in dates:
            value = known.get(d, value)
            if value is not None:
                filled.setdefault(t, {})[d] = value
    start = dates[-1] - relativedelta(months=months)
    anchors = [start + relativedelta(months=k) for k in range(months + 1)]
    entries = sorted({min(d for d in dates if d >= a) for a in anchors if any(d >= a for d in dates)})
    curve, total = {}, sum(weights.values())
    for entry, stop in zip(entries, entries[1:]):
        before = [d for d in dates if d < entry]
        if not before:
            continue
        scored = []
        for t, f in filled.items():
            s = [f[d] for d in dates if d <= before[-1] and d in f]
            if len(s) <= max(weights):
                continue
            ret = {h: (s[-1] / s[-1 - h] - 1) * 100 if s[-1 - h] else None for h in weights}
            if any(ret[h] is None or ret[h] <= 0 for h in gate):
                continue
            scored.append((-round(sum(ret[h] * (w / total) for h, w in weights.items()), 2), t))
        picks = [t for _, t in sorted(scored)[:10]]
        if not picks:
            continue
        share = [1 / len(picks)] * len(picks) if len(picks) <= 5 else [0.14] * 5 + [0.3 / (len(picks) - 5)] * (len(picks) - 5)
        begun = capital
        for d in [d for d in dates if entry <= d <= stop]:
            curve[d] = capital = begun * sum(w * filled[t][d] / filled[t][entry] for t, w in zip(picks, share))
    return curve


def test_walk_forward_equals_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    panel = []
    for k in range(14):
        price = 100.0
        for j in range(420):
            price *= 1 + rng.normal(0.0005, 0.02)
            if rng.random() > 0.1:
                panel.append((f"T{k:02}", DAY + timedelta(days=j), float(price)))
    weights, gate = {5: 0.5, 15: 0.3, 21: 0.2}, (5, 15)
    run = bt.WalkForward(spark.createDataFrame(panel, PANEL), 6, weights=weights, gate=gate)
    got = {r.date: r.value for r in run.curve().collect()}
    want = walk_by_loop(panel, 6, weights, gate)
    assert len(want) > 100 and set(got) == set(want) and all(got[d] == pytest.approx(want[d], rel=1e-9) for d in want)
    cut = DAY + timedelta(days=400)
    held = bt.score_at_dates(run.filled.where(F.col("date") <= cut), run.periods, weights, gate).where(F.col("signal") <= cut)
    every = bt.score_at_dates(run.filled, run.periods, weights, gate).where(F.col("signal") <= cut)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, every.collect()))  # later rows change no earlier signal


def test_no_weights_no_picks(spark):
    run = bt.WalkForward(spark.createDataFrame(series("A", [float(x) for x in range(1, 400)]), PANEL), 2, weights={5: 0.0})
    assert run.picks.count() == 0 and run.curve().count() == 0 and run.ledger().count() == 0


def test_boundary_date_has_the_later_period(spark):
    growth = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + timedelta(days=1), 1.5), (2, DAY + timedelta(days=1), 1.0), (2, DAY + timedelta(days=2), 2.0)], "pid int, date date, growth double")
    got = {r.date.day: r.value for r in bt.strategy_curve(growth, 100.0).collect()}
    assert got == {1: 100.0, 2: 150.0, 3: 300.0}


def test_benchmarks(spark):
    curve = spark.createDataFrame([(DAY, "Strategy", 1.0), (DAY + timedelta(days=2), "Strategy", 2.0)], "date date, series string, value double")
    quotes = spark.createDataFrame(series("A", [None, 5.0]) + series("C", [4.0, 5.0, 6.0]) + [("D", DAY + timedelta(days=2), 3.0)], PANEL)
    got = bt.benchmark_curves(curve, quotes, {"x": ("A",), "y": ("B", "c"), "z": ("D",), "none": ("E",)}).collect()
    assert sorted((r.series, r.date.day, r.value) for r in got) == [("y", 1, 100_000.0), ("y", 3, 150_000.0), ("z", 3, 100_000.0)]


def test_performance(spark):
    rows = [(d, "s", v) for _, d, v in series("s", [100.0, 120.0, None, 90.0, 130.0])]
    got = performance.performance_summary(spark.createDataFrame(rows, "date date, series string, value double")).first()
    assert (got.return_pct, got.max_drawdown_pct, got.start_value, got.end_value) == (30.0, -25.0, 100.0, 130.0)


def test_resume(spark):
    saved = spark.createDataFrame([("A", 1.0, 0.1, "ok", 1), ("B", 1.0, None, "Page fetch failed: x", 2), ("A", 2.0, 0.2, "ok", 3)], "ticker string, market_cap_cr double, holding_change_pct double, scan_notes string, scan_order int")
    done = inst.completed(saved)
    assert [(r.ticker, r.market_cap_cr) for r in done.collect()] == [("A", 2.0)]
    rows = spark.createDataFrame([("A",), (" b",), ("C",)], "ticker string")
    assert sorted(r.ticker for r in inst.pending(rows, done).collect()) == [" b", "C"]
    assert inst.completed(saved.drop("scan_notes")) is None and inst.pending(rows, None) is rows


def test_shortlist_and_market_caps(spark):
    rows = spark.createDataFrame([("a", "3"), ("b", None), ("c", "0"), ("d", "-1"), ("e", "5"), ("f", "n/a")], "ticker string, holding_change_pct string")
    assert [r.ticker for r in inst.shortlist(rows, 1).collect()] == ["e"]
    assert inst.shortlist(rows.select("ticker")).count() == 0
    caps = spark.createDataFrame([("x", "A.NS", 2e9), ("y", "B.NS", None), ("z", "C.NS", None)], "ticker string, symbol string, market_cap double")
    lookup = spark.createDataFrame([("b.ns", 3.4567e10), ("C.NS", 0.0)], "symbol string, market_cap double")
    assert {r.ticker: r.market_cap_cr for r in inst.enrich_market_cap(caps, lookup).collect()} == {"x": 200.0, "y": 3456.7, "z": None}
    assert [r.market_cap_cr for r in inst.by_market_cap(spark.createDataFrame([("a", 5.0), ("b", None), ("c", 9.0)], "ticker string, market_cap_cr double")).collect()] == [9.0, 5.0, None]


def test_config_is_checked():
    with pytest.raises(ValueError):
        ScreeningConfig(weights={7: 1.0})
    with pytest.raises(ValueError):
        ScreeningConfig(backtest_months=0)
    assert FundamentalThresholds().min_market_cap_cr == 1500.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0.01, 1e4), min_size=6, max_size=12), st.floats(0.1, 100))
def test_scaling_prices_keeps_growth(closes, c):
    a = [(x / closes[0] - 1) * 100 for x in closes]
    b = [(x * c / (closes[0] * c) - 1) * 100 for x in closes]
    assert a == pytest.approx(b, rel=1e-6, abs=1e-6)


def test_spans_give_what_the_filled_grid_gives(spark):
    """Scores and growth, with gaps and late tickers."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for k in range(14):
        values = [float(x) for x in 50 + np.cumsum(rng.normal(0.3, 1.0, 420))]
        closes = [None if rng.random() < 0.3 or d < 20 * k else round(max(v, 0.0), 2) for d, v in enumerate(values)]
        rows += series(f"T{k}", closes)
    run = bt.WalkForward(spark.createDataFrame(rows, PANEL), 4)
    key = lambda rows: sorted((r.pid, r.signal, r.ticker, r.score) for r in rows.collect())
    want = bt.score_at_dates(run.filled, run.periods)
    assert key(run.scores) == key(want) and run.scores.count() > 10
    grown = lambda df: {(r.pid, r.date): pytest.approx(r.growth) for r in df.collect()}
    assert grown(run.growth) == grown(bt.period_growth(run.picks, run.periods, run.filled))
    plain = bt.rebalance_schedule(run.calendar, 4)
    assert sorted(map(tuple, plain.select("pid", "entry", "exit", "signal").collect())) == sorted(map(tuple, run.periods.collect()))
    money = {r.pid: r.before for r in bt.carried_capital(run.growth).collect()}
    want = {r.date: money[r.pid] * r.growth for r in sorted(run.growth.collect(), key=lambda r: r.pid)}
    assert {r.date: r.value for r in run.curve().collect()} == {d: pytest.approx(v) for d, v in want.items()}


def test_schedule_on_the_driver(spark):
    for months in (1, 2, 3, 7):
        got = [(p.entry, p.exit, p.signal) for p in bt.schedule(DATES, months)]
        assert got == [(r.entry, r.exit, r.signal) for r in bt.rebalance_schedule(spark.createDataFrame([(d,) for d in DATES], "date date"), months).orderBy("pid").collect()]
    assert bt.schedule([], 3) == []
    days = [date(2023, 12, 31), date(2024, 2, 29), date(2024, 8, 30), date(2024, 1, 1)]
    shown = spark.createDataFrame([(d, k) for d in days for k in (-14, -6, -1, 0, 1, 12)], "d date, k int").selectExpr("d", "k", "add_months(d, k) AS m").collect()
    assert all(bt.add_months(r.d, r.k) == r.m for r in shown)


def test_plans(spark):
    """Top rows without a full sort, history cut within shares of a ticker, and no Python in the price path."""
    panel = spark.createDataFrame(series("A", [1.0, 2.0]), PANEL)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(trailing_returns(panel))  # the default horizons, 1260 observations deep, in any session
    assert "<= 1261" in plan and "partial_collect_list" in plan and "hashpartitioning(ticker" in plan and "_share" in plan
    run = bt.WalkForward(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close")))
    plan = text(run.curve())
    assert "Python" not in plan and "WindowGroupLimit" in plan and "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    assert "TakeOrderedAndProject" in text(inst.shortlist(spark.createDataFrame([("a", 1.0)], "ticker string, holding_change_pct double"), 3))


def test_spans_are_shuffled_once(spark):
    """Scores and growth read one shuffle of the panel; prices without a ticker count for nobody."""
    rows = series("A", [100.0 * 1.01**j for j in range(420)])
    curve = bt.WalkForward(spark.createDataFrame(rows, PANEL), 2, weights={5: 1.0}, gate=(5,)).curve()
    want = sorted(map(tuple, curve.collect()))
    nameless = [(None, d, 1.0 + k * k) for k, (_, d, _) in enumerate(rows)]
    assert want == sorted(map(tuple, bt.WalkForward(spark.createDataFrame(rows + nameless, PANEL), 2, weights={5: 1.0}, gate=(5,)).curve().collect()))
    grouped = supplier_panel(spark, "/root/testdata/sf0.001")
    curve = bt.WalkForward(grouped).curve()
    curve.collect()  # adaptive execution reuses as it runs
    final = curve._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan parquet") == 1 and final.count("ReusedExchange") == 1
