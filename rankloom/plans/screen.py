"""The runs: prices to returns to momentum, fundamentals to final list to back-test, and holding screens.

A run takes tables (universe, panel, pages, quotes), saves what it makes in a store, and gives back a bundle of lazy
DataFrames read from there, so that each part is computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import BENCHMARKS, ScreeningConfig
from rankloom.operators import institutional as inst
from rankloom.operators.backtest import WalkForward, benchmark_curves
from rankloom.operators.fundamentals import FETCH_FAILED, METRICS, screen_fundamentals
from rankloom.operators.momentum import score_momentum
from rankloom.operators.performance import normalized, performance_summary
from rankloom.operators.portfolio import current_allocation
from rankloom.operators.rank import top_n
from rankloom.operators.returns import universe_returns
from rankloom.sources.store import Store

#: Called with done, total and a message after each part of a run.
Progress = Callable[[int, int, str], None]
#: Gives the panel (ticker, date, close) of a table with a symbol column.
Prices = Callable[[DataFrame], DataFrame]
#: Gives parsed pages (ticker, page_url, error, items, sections, rows) of a table with ticker and page_url.
Pages = Callable[[DataFrame], DataFrame]


def _best_first() -> list:
    return [F.desc("score"), F.asc("ticker")]


def _tell(progress: Progress | None, done: int, total: int, message: str) -> None:
    if progress:
        progress(done, total, message)


@dataclass
class Bundle:
    """The tables of a full run; each is there, with no rows where a part was left out."""

    momentum: DataFrame
    fundamentals: DataFrame
    final: DataFrame
    curves: DataFrame
    normalized_curves: DataFrame
    periods: DataFrame
    allocation: DataFrame
    performance: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def price_returns(universe: DataFrame, prices: Prices, store: Store, progress: Progress | None = None) -> DataFrame:
    panel = prices(universe)
    _tell(progress, 1, 2, "prices")
    saved = store.save("returns", universe_returns(universe, panel))
    _tell(progress, 2, 2, "returns")
    return saved


def momentum_of(returns: DataFrame, config: ScreeningConfig, store: Store) -> DataFrame:
    saved = store.save("momentum", score_momentum(returns, config.weights, config.gate))
    return saved.orderBy(*_best_first())


def run_momentum(universe: DataFrame | None, prices: Prices | None, config: ScreeningConfig, store: Store, use_saved_returns: bool = False, progress: Progress | None = None) -> DataFrame:
    """Momentum from saved returns, or from the universe's prices."""
    returns = store.require("returns") if use_saved_returns else price_returns(universe, prices, store, progress)
    return momentum_of(returns, config, store)


def no_fundamentals(candidates: DataFrame) -> DataFrame:
    """A table like that of fundamentals, without rows."""
    blank = {m: F.lit(None).cast("double") for m in METRICS} | {"fundamental_pass": F.lit(None).cast("boolean"), "fundamental_notes": F.lit(None).cast("string")}
    return candidates.withColumns(blank).where(F.lit(False))


#: What is observed while parts are written.
PASSED = {"passed": "count_if(fundamental_pass)"}
RISING = {"n_rising": "count_if(holding_change_pct > 0)", "max_change": "max(holding_change_pct)", "n_failed": f"count_if(startswith(scan_notes, '{FETCH_FAILED}'))"}


def screen_in_parts(candidates: DataFrame, pages: Pages, config: ScreeningConfig, store: Store, parts: int = 1, progress: Progress | None = None) -> DataFrame:
    """The fundamental rules applied to the candidates, saved after each of ``parts`` parts (dealt by a hash of the
    ticker), so that a run that stops leaves what it fetched for ``recover``."""
    name, saved = "fundamentals_partial", None
    dealt = candidates.withColumn("_part", F.pmod(F.xxhash64("ticker"), F.lit(parts)))
    for k in range(parts):
        some = dealt.where(F.col("_part") == k).drop("_part")
        judged = screen_fundamentals(some, pages(some), config.thresholds)
        saved = store.save(name, judged, PASSED) if saved is None else store.append(name, judged, PASSED, f"{store.run}-{k}")
        _tell(progress, k + 1, parts, f"fundamentals of {store.rows(name)} fetched, {sum(m['passed'] for m in store.metrics(name))} pass")
    return saved


def run_fundamentals(
    momentum: DataFrame, panel: Prices, pages: Pages | None, config: ScreeningConfig, store: Store, quotes: DataFrame | None = None, progress: Progress | None = None, parts: int = 1
) -> Bundle:
    """The best of the momentum list through the fundamental rules, the final list, and the back-test of all that pass.

    Without ``pages`` the rules are left out and the final list is back-tested.
    """
    candidates = top_n(momentum, _best_first(), config.top_momentum)
    if pages is not None:
        fundamentals = store.save("fundamentals", screen_in_parts(candidates, pages, config, store, parts))
        passed = fundamentals.where("fundamental_pass")
    else:
        fundamentals = store.save("fundamentals", no_fundamentals(candidates))
        passed = candidates
    _tell(progress, 1, 4, "fundamentals")
    final = store.save("final", top_n(passed, _best_first(), config.final_count))
    eligible = passed if pages is not None else final
    _tell(progress, 2, 4, "final list")

    tickers = eligible.select(F.upper("symbol").alias("ticker")).distinct()
    prices = panel(eligible).join(tickers, "ticker", "left_semi")
    run = WalkForward(prices, config.backtest_months, config.initial_capital, config.weights, config.gate)
    curve = run.curve()
    if quotes is not None:
        curve = curve.unionByName(benchmark_curves(curve, quotes, BENCHMARKS, config.initial_capital))
    curves = store.save("curves", curve)
    names = eligible.select(F.col("symbol").alias("ticker"), "name") if "name" in eligible.columns else None
    periods = store.save("periods", run.ledger(names))
    _tell(progress, 3, 4, "back-test")
    bundle = Bundle(
        momentum, fundamentals, final.orderBy(*_best_first()), curves,
        store.save("normalized_curves", normalized(curves, config.initial_capital)), periods,
        store.save("allocation", current_allocation(eligible, config.initial_capital)), store.save("performance", performance_summary(curves)),
    )
    _tell(progress, 4, 4, "performance")
    return bundle


def run_full(universe: DataFrame | None, panel: Prices, pages: Pages | None, config: ScreeningConfig, store: Store, quotes: DataFrame | None = None, use_saved_returns: bool = False, progress: Progress | None = None, parts: int = 1) -> Bundle:
    store = store.begin()
    momentum = run_momentum(universe, panel, config, store, use_saved_returns, progress)
    return run_fundamentals(momentum, panel, pages, config, store, quotes, progress, parts)


def scan(universe: DataFrame, pages: Pages, holder: str, store: Store, progress: Progress | None = None, parts: int = 1) -> DataFrame:
    """The holding scan of a universe, going on with what was saved: done tickers are not fetched, failed ones are.

    The scan is saved after each of ``parts`` parts, which are dealt by a hash of the ticker. Each part is appended, so
    nothing is written twice however many there are.
    """
    name = f"{holder.lower()}_partial"
    done = inst.completed(store.load(name))
    saved = store.save(name, done, RISING) if done is not None else None
    left = inst.pending(universe, saved).withColumn("_part", F.pmod(F.xxhash64("ticker"), F.lit(parts)))
    for k in range(parts):
        some = left.where(F.col("_part") == k).drop("_part")
        new = inst.scan_holdings(some, pages(some), holder).withColumn("scan_order", F.current_timestamp())
        saved = store.save(name, new, RISING) if saved is None else store.append(name, new, RISING, f"{store.run}-{k}")
        seen = saved_counts(store, name)
        _tell(progress, k + 1, parts, f"{holder.upper()} scan: {seen['n_tickers']} done, {seen['n_rising']} rising")
    return store.require(name)


def saved_counts(store: Store, name: str) -> dict[str, float | None]:
    """Tickers, rises, failed fetches and the largest change of a saved scan, as observed while it was written."""
    found = store.metrics(name)
    largest = [m["max_change"] for m in found if m["max_change"] is not None]
    return {"n_tickers": store.rows(name), "n_rising": sum(m["n_rising"] for m in found), "n_failed": sum(m["n_failed"] for m in found), "max_change": max(largest, default=None)}


def finish_holdings(all_scan: DataFrame, prices: Prices, holder: str, config: ScreeningConfig, store: Store, top: int = 50, final: int = 3) -> dict[str, DataFrame]:
    """The whole scan by market cap, the largest rises, their momentum, and the best of it.

    If prices can't be had, momentum is one row with the error and final has none.
    """
    prefix = holder.lower()
    everything = store.save(f"{prefix}_all", inst.by_market_cap(all_scan))
    rising = store.save(f"{prefix}_top", inst.shortlist(everything, top))
    try:
        panel = prices(rising)
        returns = universe_returns(rising, panel)
        momentum = store.save(f"{prefix}_momentum", score_momentum(returns, config.weights, config.gate))
        best = top_n(momentum, _best_first(), final)
    except Exception as error:  # noqa: BLE001  the scan's tables must survive a price source that fails
        row = [(f"{holder.upper()} scan saved, but its prices can't be had: {error}",)]
        momentum = store.save(f"{prefix}_momentum", all_scan.sparkSession.createDataFrame(row, "momentum_error string"))
        best = momentum.where(F.lit(False))
    return {f"{prefix}_all": everything, f"{prefix}_top": rising, f"{prefix}_momentum": momentum, f"{prefix}_final": store.save(f"{prefix}_final", best)}


def run_holdings(
    universe: DataFrame, pages: Pages, prices: Prices, holder: str, config: ScreeningConfig, store: Store, market_caps: DataFrame | None = None, top: int = 50, final: int = 3, progress: Progress | None = None, parts: int = 1
) -> dict[str, DataFrame]:
    """Scan, market caps from ``market_caps`` (symbol, market_cap) if the scan has none at all, and the screen."""
    store = store.begin()
    found = scan(universe, pages, holder, store, progress, parts)
    if market_caps is not None and not found.where("market_cap_cr IS NOT NULL").take(1):
        found = store.save(f"{holder.lower()}_marketcap_partial", inst.enrich_market_cap(found, market_caps))
    return finish_holdings(found, prices, holder, config, store, top, final)
