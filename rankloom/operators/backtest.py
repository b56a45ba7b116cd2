"""Monthly walk-forward back-test as one lazy plan: no loop over periods and none over tickers.

A close holds from its trading date to the day before the ticker's next one. Those spans are made by one window over
the closes; a period's returns look up the spans that cover its signal date and the dates a horizon before it, so that
no grid of tickers and dates is made. Picks are ranked within each period (tasks keep ten before the shuffle), holdings
are spread over their period's dates alone, and capital carried from period to period is a running product. The dates
that the panel has, some 250 a year, are the one thing that is fetched before the plan is made: the schedule is worked
out of them on the driver and goes into the plan as local tables, and the window's first date is a literal bound on the
panel.
"""

from __future__ import annotations

from bisect import bisect_left
from calendar import monthrange
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import BENCHMARKS, DEFAULT_GATE, DEFAULT_WEIGHTS, INITIAL_CAPITAL
from rankloom.functions.numeric import growth_pct, rounded
from rankloom.operators.asof import first_on_or_after, last_before
from rankloom.operators.interval import interval_join
from rankloom.operators.momentum import all_positive, weighted
from rankloom.operators.portfolio import NAMES, current_allocation, tier_weight
from rankloom.operators.rank import keep_first, top_per
from rankloom.operators.segmented import first_known, last_known, segmented_scan
from rankloom.operators.universe import SUFFIX
from rankloom.sources.local import local_table

#: Calendar months of prices before the first rebalance.
LEAD_MONTHS = 9
#: Trading dates to a bin of the lookup of spans; most spans are of a day or two.
BIN = 16


def calendar_of(panel: DataFrame) -> DataFrame:
    """The dates with any price."""
    return panel.where("close IS NOT NULL").select("date").distinct()


def forward_fill(panel: DataFrame) -> DataFrame:
    """ticker, date, close and filled on every calendar date; filled is the last known close, null before the first.

    The result has every ticker on every date. The dates, some 250 a year, are one value of the plan; a ticker's rows
    are filled by years, so that no task meets its whole history.
    """
    dates = calendar_of(panel).agg(F.collect_set("date")).scalar()
    grid = panel.select("ticker").distinct().select("ticker", F.explode(dates).alias("date"))
    dense = grid.join(panel.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), "close"), F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("date") == F.col("_d")), "left").drop("_t", "_d")
    return segmented_scan(dense, ["ticker"], ["date"], F.year("date"), {"filled": last_known("close")})


def carry_forward(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows of ``forward_fill`` that have a value, without a grid: each close is repeated up to the ticker's next.

    One shuffle by ticker serves this, and windows by ticker over the result.
    """
    order = Window.orderBy("date")  # trading dates: some 250 a year
    days = calendar.select("date", F.row_number().over(order).alias("pos"), F.count("*").over(Window.partitionBy()).alias("n_days"))
    by_pos = Window.partitionBy("ticker").orderBy("pos")
    known = panel.where("close IS NOT NULL").join(F.broadcast(days), "date").select("ticker", "pos", "close", "n_days")
    until = F.coalesce(F.lead("pos").over(by_pos) - 1, F.col("n_days").cast("int"))
    known = known.withColumn("until", until)
    spans = known.select("ticker", "close", F.col("pos").alias("at"), F.explode(F.sequence("pos", "until")).alias("pos"))
    return spans.join(F.broadcast(days.select("pos", "date")), "pos").select("ticker", "date", F.when(F.col("pos") == F.col("at"), F.col("close")).alias("close"), F.col("close").alias("filled"))


def rebalance_schedule(calendar: DataFrame, months: int) -> DataFrame:
    """pid, entry, exit and signal of each period: trading dates on or after month anchors counted back from the last
    date, each period's end, and the last date before its entry. Periods without a signal date stay out."""
    months = max(int(months), 1)
    start = calendar.agg(F.add_months(F.max("date"), -months).alias("start"))
    anchors = start.select(F.explode(F.sequence(F.lit(0), F.lit(months))).alias("k"), "start").select(F.expr("add_months(start, k)").alias("anchor"))
    entries = first_on_or_after(anchors, calendar).where("entry IS NOT NULL").select("entry").distinct()
    order = Window.orderBy("entry")  # at most months + 1 rows
    periods = entries.select(F.row_number().over(order).alias("pid"), "entry", F.lead("entry").over(order).alias("exit")).where("exit IS NOT NULL")
    return last_before(periods, calendar).where("signal IS NOT NULL")


def score_at_dates(filled: DataFrame, periods: DataFrame, weights: Mapping[int, float] | None = None, gate: Sequence[int] = DEFAULT_GATE) -> DataFrame:
    """pid, signal, ticker and score of the tickers that pass at each period's signal date.

    A ticker needs more observations than the longest weighted horizon; returns are not rounded, the score is.
    """
    weights = weights or DEFAULT_WEIGHTS
    if sum(weights.values()) <= 0 or any(h not in weights for h in gate):  # nobody passes
        weights, gate, nobody = DEFAULT_WEIGHTS, (), True
    else:
        nobody = False
    by_date = Window.partitionBy("ticker").orderBy("date")
    known = filled.where("filled IS NOT NULL")
    rows = known.select("ticker", "date", F.row_number().over(by_date).alias("n_obs"), *[growth_pct(F.col("filled"), F.lag("filled", h).over(by_date)).alias(f"ret_{h}") for h in weights])
    at = rows.join(F.broadcast(periods.select("pid", F.col("signal").alias("date"))), "date")
    passed = at.where((F.col("n_obs") > max(weights)) & all_positive([f"ret_{h}" for h in gate]))
    scored = passed.select("pid", F.col("date").alias("signal"), "ticker", rounded(weighted(weights, False)).alias("score")).where("score IS NOT NULL")
    return scored.where(F.lit(False)) if nobody else scored


def picks_of(scores: DataFrame) -> DataFrame:
    """The ten best of each period (score, then ticker) with rank and weight."""
    best = top_per(scores, ["pid"], [F.desc("score"), F.asc("ticker")], NAMES)
    return best.withColumn("weight", tier_weight(F.col("rank"), F.count("*").over(Window.partitionBy("pid"))))


def period_growth(picks: DataFrame, periods: DataFrame, filled: DataFrame) -> DataFrame:
    """pid, date and growth since the entry of each period's holdings, on every date from entry to exit.

    A holding whose entry price is zero drops out.
    """
    held = picks.select("pid", "ticker", "weight").join(periods.select("pid", "entry", "exit"), "pid")
    held = F.broadcast(held)  # ten rows a period at most
    prices = filled.select("ticker", "date", "filled").join(held, "ticker").where(F.col("date").between(F.col("entry"), F.col("exit")))
    base = F.first("filled").over(Window.partitionBy("pid", "ticker").orderBy("date"))
    return prices.withColumn("_base", base).where("_base <> 0").groupBy("pid", "date").agg(F.sum(F.col("weight") * F.col("filled") / F.col("_base")).alias("growth")).where("growth > 0")


def carried_capital(growth: DataFrame, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """pid, growth over the period, and the capital before and after it; a period without picks changes nothing."""
    ends = growth.groupBy("pid").agg(F.max_by("growth", "date").alias("growth"))
    order = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a period
    return ends.withColumn("after", F.lit(capital) * F.product("growth").over(order)).select("pid", "growth", F.coalesce(F.lag("after").over(Window.orderBy("pid")), F.lit(capital)).alias("before"), "after")


def strategy_curve(growth: DataFrame, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """date, series and value; a date that ends one period and begins the next has the later period's value."""
    order = Window.orderBy("pid", "date")  # one row for each trading date of the back-test
    ends = growth.withColumn("_end", F.when(F.coalesce(F.lead("pid").over(order) != F.col("pid"), F.lit(True)), F.col("growth")).otherwise(1.0))
    before = F.coalesce(F.product("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)) * capital
    rows = ends.select("pid", "date", (before * F.col("growth")).alias("_value"))
    return rows.groupBy("date").agg(F.max_by("_value", "pid").alias("value")).select("date", F.lit("Strategy").alias("series"), "value")


def ledger(picks: DataFrame, periods: DataFrame, growth: DataFrame, names: DataFrame | None = None, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """One row a period: dates, what was picked, capital before and after, and the return.

    ``names`` (ticker, name) adds names; the first of a ticker by name counts.
    """
    shown = picks.withColumn("_shown", F.replace("ticker", F.lit(SUFFIX), F.lit("")))
    if names is not None:
        first = names.groupBy(F.upper("ticker").alias("ticker")).agg(F.min("name").alias("name"))
        shown = shown.join(first, "ticker", "left")
    else:
        shown = shown.withColumn("name", F.lit(None).cast("string"))
    named = F.concat("_shown", F.when(F.col("name") != "", F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise(""))
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("_shown").alias("ticker"), named.alias("named"))))  # ten at most
    lists = shown.groupBy("pid").agg(listed.alias("of")).select("pid", F.array_join("of.ticker", ", ").alias("selected_tickers"), F.array_join("of.named", ", ").alias("selected_names"))
    money = carried_capital(growth, capital)
    return (
        periods.join(lists, "pid").join(money, "pid").select(
            "pid", F.col("entry").alias("rebalance_date"), F.col("signal").alias("signal_date"), F.col("exit").alias("exit_date"), "selected_tickers", "selected_names",
            rounded(F.col("before")).alias("starting_capital"), rounded(F.col("after")).alias("ending_capital"), rounded((F.col("after") / F.col("before") - 1.0) * 100.0).alias("return_pct"),
        )
    )


def benchmark_curves(curve: DataFrame, quotes: DataFrame, candidates: Mapping[str, Sequence[str]] = BENCHMARKS, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """Each label's first candidate with any quote, on the curve's dates, carried forward and scaled to ``capital``.

    ``quotes`` is (ticker, date, close). Dates are matched before filling: a quote on another date isn't carried.
    """
    spark = curve.sparkSession
    wanted = local_table(spark, [(label, symbol.upper(), k) for label, symbols in candidates.items() for k, symbol in enumerate(symbols)], "series string, ticker string, priority int")
    known = quotes.where("close IS NOT NULL")
    have = known.select(F.upper("ticker").alias("ticker")).distinct().join(F.broadcast(wanted), "ticker")
    chosen = have.groupBy("series").agg(F.min_by("ticker", "priority").alias("ticker"))
    rows = known.withColumn("ticker", F.upper("ticker")).join(F.broadcast(chosen), "ticker").select("series", "date", "close")
    dates = curve.agg(F.collect_set("date")).scalar()  # dates of the back-test
    grid = chosen.select("series", F.explode(dates).alias("date")).join(rows, ["series", "date"], "left")
    filled = segmented_scan(grid, ["series"], ["date"], F.year("date"), {"filled": last_known("close"), "base": first_known("close")}).where("filled IS NOT NULL")
    return filled.select("date", "series", (F.col("filled") / F.col("base") * capital).alias("value"))


@dataclass(frozen=True)
class Period:
    """A period's dates and their places (from 1) among the trading dates."""

    pid: int
    entry: date
    exit: date
    signal: date
    entry_pos: int
    exit_pos: int
    signal_pos: int


def add_months(day: date, months: int) -> date:
    """The same day of another month, or that month's last day."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def schedule(days: Sequence[date], months: int) -> list[Period]:
    """``rebalance_schedule`` of sorted trading dates that the driver has."""
    if not days:
        return []
    start = add_months(days[-1], -max(int(months), 1))
    at = sorted({k for k in (bisect_left(days, add_months(start, k)) for k in range(max(int(months), 1) + 1)) if k < len(days)})
    return [Period(k + 1, days[i], days[j], days[i - 1], i + 1, j + 1, i) for k, (i, j) in enumerate(zip(at, at[1:])) if i]


def close_spans(panel: DataFrame, days: DataFrame, n_days: int) -> DataFrame:
    """ticker, close, the places ``pos`` to ``until`` of the dates it holds, and the ticker's ``first`` place.

    ``days`` (date, pos) numbers the trading dates and is small. One shuffle by ticker. A price without a ticker is
    nobody's; that it is left out here, and not by the joins on top, keeps the shuffle alike wherever spans are used, so
    that Spark runs it once.
    """
    by_pos = Window.partitionBy("ticker").orderBy("pos")
    known = panel.where("close IS NOT NULL AND ticker IS NOT NULL").join(F.broadcast(days), "date").select("ticker", "pos", "close")
    return known.select("ticker", "close", "pos", F.coalesce(F.lead("pos").over(by_pos) - 1, F.lit(n_days)).alias("until"), F.first("pos").over(by_pos).alias("first"))


def score_spans(spans: DataFrame, periods: Sequence[Period], weights: Mapping[int, float] | None = None, gate: Sequence[int] = DEFAULT_GATE) -> DataFrame:
    """What ``score_at_dates`` gives, from spans: each period asks for its signal date and one date for each horizon."""
    weights = weights or DEFAULT_WEIGHTS
    nobody = sum(weights.values()) <= 0 or any(h not in weights for h in gate)
    asked = [] if nobody else [(p.pid, p.signal, p.signal_pos, h, p.signal_pos - h) for p in periods for h in (0, *weights) if p.signal_pos > max(weights)]
    asked = local_table(spans.sparkSession, asked, "pid int, signal date, signal_pos int, h int, at int")
    met = interval_join(spans, F.broadcast(asked), "pos", "until", "at", BIN)  # periods by horizons
    price = lambda h: F.max(F.when(F.col("h") == h, F.col("close")))
    rows = met.where(F.col("signal_pos") - F.col("first") + 1 > max(weights)).groupBy("ticker", "pid", "signal").agg(*[price(h).alias(f"_p{h}") for h in (0, *weights)])
    rows = rows.select("pid", "signal", "ticker", *[growth_pct(F.col("_p0"), F.col(f"_p{h}")).alias(f"ret_{h}") for h in weights])
    passed = rows if nobody else rows.where(all_positive([f"ret_{h}" for h in gate]))
    score = rounded(weighted(DEFAULT_WEIGHTS if nobody else weights, False)) if not nobody else F.lit(None).cast("double")
    return passed.select("pid", "signal", "ticker", score.alias("score")).where("score IS NOT NULL")


def span_growth(picks: DataFrame, periods: Sequence[Period], spans: DataFrame, days: DataFrame) -> DataFrame:
    """What ``period_growth`` gives, from spans: only the spans of held tickers, over their period's dates."""
    local = local_table(spans.sparkSession, [(p.pid, p.entry_pos, p.exit_pos) for p in periods], "pid int, entry_pos int, exit_pos int")
    held = F.broadcast(picks.select("pid", "ticker", "weight").join(F.broadcast(local), "pid"))  # ten rows a period at most
    met = spans.join(held, "ticker").where((F.col("pos") <= F.col("exit_pos")) & (F.col("until") >= F.col("entry_pos")))
    held_on = met.select("pid", "ticker", "weight", "close", F.explode(F.sequence(F.greatest("pos", "entry_pos"), F.least("until", "exit_pos"))).alias("pos"))
    base = F.first("close").over(Window.partitionBy("pid", "ticker").orderBy("pos"))
    grown = held_on.withColumn("_base", base).where("_base <> 0").groupBy("pid", "pos").agg(F.sum(F.col("weight") * F.col("close") / F.col("_base")).alias("growth"))
    return grown.where("growth > 0").join(F.broadcast(days), "pos").select("pid", "date", "growth")


class WalkForward:
    """The parts of a back-test over a panel of eligible tickers, each a lazy DataFrame. Making it reads the panel's
    dates once; its dates and periods are local tables."""

    def __init__(self, panel: DataFrame, months: int = 6, capital: float = INITIAL_CAPITAL, weights: Mapping[int, float] | None = None, gate: Sequence[int] = DEFAULT_GATE):
        months = max(int(months), 1)
        spark = panel.sparkSession
        seen = panel.where("date IS NOT NULL").groupBy("date").agg(F.count("close").alias("n")).collect()  # a row for each date
        bound = add_months(max(r.date for r in seen), -(months + LEAD_MONTHS)) if seen else None
        days = sorted(r.date for r in seen if r.n and r.date > bound)
        recent = panel.where(F.col("date") > F.lit(bound)) if bound else panel
        schedule_ = schedule(days, months)
        numbered = local_table(spark, [(d, k) for k, d in enumerate(days, 1)], "date date, pos int")
        self.capital, self.recent = capital, recent
        self.calendar = numbered.select("date")
        self.periods = local_table(spark, [(p.pid, p.entry, p.exit, p.signal) for p in schedule_], "pid int, entry date, exit date, signal date")
        spans = close_spans(recent, numbered, len(days))
        self.scores = score_spans(spans, schedule_, weights, gate)
        self.picks = picks_of(self.scores)
        self.growth = span_growth(self.picks, schedule_, spans, numbered)

    @property
    def filled(self) -> DataFrame:
        """The whole window, carried forward."""
        return carry_forward(self.recent, self.calendar)

    def curve(self) -> DataFrame:
        return strategy_curve(self.growth, self.capital)

    def ledger(self, names: DataFrame | None = None) -> DataFrame:
        return ledger(self.picks, self.periods, self.growth, names, self.capital)


def backtest_top10(picks: DataFrame, panel: DataFrame, months: int = 6, capital: float = INITIAL_CAPITAL) -> tuple[DataFrame, DataFrame]:
    """The walk-forward curve of the picks' symbols, and the allocation to the best of them."""
    symbols = picks.select(F.upper("symbol").alias("ticker")).distinct()
    return WalkForward(panel.join(symbols, "ticker", "left_semi"), months, capital).curve(), current_allocation(picks, capital)


def buy_and_hold(picks: DataFrame, panel: DataFrame, capital: float = INITIAL_CAPITAL) -> tuple[DataFrame, DataFrame]:
    """Curve and holdings of the ten best current picks, each held from its first price. For comparison only: it picks
    with hindsight. The weight of a pick without prices stays uninvested.

    The prices of ten tickers become a row for each date with a column for each rank, so that the panel is read once and
    the curve is a scan of dates.
    """
    ten = keep_first(picks.select(F.upper("symbol").alias("ticker"), "score"), ["ticker"], [F.desc("score")])
    ten = ten.orderBy(F.desc("score"), "ticker").limit(NAMES).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ticker")))
    ten = F.broadcast(ten.select("ticker", "rank", F.count("*").over(Window.partitionBy()).alias("n")))
    few = panel.where("close IS NOT NULL").join(ten, "ticker")
    weight = lambda rank: tier_weight(rank, F.col("n"))
    lot = lambda rank, entry: F.coalesce(F.lit(capital) * weight(rank) / F.nullif(entry, F.lit(0.0)), F.lit(0.0))

    ranks = range(1, NAMES + 1)
    dates = few.groupBy("date").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("rank") == r, F.col("close"))).alias(f"close_{r}") for r in ranks])
    by_date = Window.orderBy("date")  # a row for each trading date
    so_far, ever = by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = dates.select("date", "n", *[c for r in ranks for c in (F.last(f"close_{r}", ignorenulls=True).over(so_far).alias(f"now_{r}"), F.first(f"close_{r}", ignorenulls=True).over(ever).alias(f"entry_{r}"))])
    # Before a ticker's first price the whole curve is undefined, as a sum with a missing part is.
    for r in ranks:
        known = known.where(F.col(f"entry_{r}").isNull() | F.col(f"now_{r}").isNotNull())
    value = sum((F.coalesce(F.col(f"now_{r}") * lot(F.lit(r), F.col(f"entry_{r}")), F.lit(0.0)) for r in ranks), F.lit(0.0))
    curve = known.select("date", F.lit("Strategy").alias("series"), value.alias("value"))

    held = few.groupBy("ticker", "rank", "n").agg(F.min_by("close", "date").alias("entry"))
    rank = F.col("rank")
    holdings = held.select("rank", "ticker", weight(rank).alias("weight"), rounded(weight(rank) * capital).alias("allocation"), rounded(F.col("entry")).alias("entry_price"), rounded(lot(rank, F.col("entry")), 4).alias("shares"))
    return curve, holdings
