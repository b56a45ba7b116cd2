"""Taking up a run from its saved tables, in a fixed order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import ScreeningConfig
from rankloom.functions.numeric import text_bool
from rankloom.operators.institutional import by_market_cap
from rankloom.operators.rank import top_n
from rankloom.plans.screen import Prices, finish_holdings, momentum_of
from rankloom.sources.store import Store


#: The tables that a full run writes.
RUN_TABLES = ("returns", "momentum", "fundamentals_partial", "fundamentals", "final", "curves", "normalized_curves", "periods", "allocation", "performance")


def last_run(store: Store) -> str | None:
    """The full run that wrote last."""
    newest = store.newest(RUN_TABLES)
    return store.run_of(newest) if newest else None


def saved_momentum(store: Store, config: ScreeningConfig) -> DataFrame | None:
    """The last run's momentum list, or one made of its returns, or else those of an earlier run, or None."""
    run = last_run(store)
    if store.run_of("returns") == run != store.run_of("momentum") and store.exists("returns"):
        return momentum_of(store.require("returns"), config, store.begin(run))
    found = store.load("momentum")
    if found is not None:
        return found.orderBy(F.desc("score"), "ticker")
    return momentum_of(store.require("returns"), config, store.begin(run)) if store.exists("returns") else None


def current_or_saved_momentum(current: DataFrame | None, store: Store, config: ScreeningConfig) -> DataFrame:
    """The list at hand, or else the saved one."""
    found = current if current is not None else saved_momentum(store, config)
    if found is None:
        raise FileNotFoundError(f"neither momentum nor returns are saved in {store.folder}")
    return found


def passing(fundamentals: DataFrame) -> DataFrame:
    """The rows that passed; the flag may be text."""
    kind = dict(fundamentals.dtypes)["fundamental_pass"]
    return fundamentals.where(text_bool(F.col("fundamental_pass")) if kind == "string" else F.col("fundamental_pass").cast("boolean"))


def recover(store: Store, config: ScreeningConfig) -> dict[str, DataFrame | None]:
    """All tables of the last run, and none that an earlier one left: fundamentals or their partial scan; the final list,
    or what passed, or the best momentum. Only momentum and returns may be of an earlier run, as a run can go on from them."""
    momentum = current_or_saved_momentum(None, store, config)
    run = last_run(store)
    own = lambda name: store.load(name) if store.run_of(name) == run else None
    fundamentals = own("fundamentals")
    if fundamentals is None:
        fundamentals = own("fundamentals_partial")
    final = own("final")
    if final is None and fundamentals is not None and "fundamental_pass" in fundamentals.columns:
        passed = passing(fundamentals)
        final = passed if passed.take(1) else None
    if final is None:
        final = top_n(momentum, [F.desc("score"), F.asc("ticker")], config.final_count)
    others = {name: own(name) for name in ("curves", "normalized_curves", "periods", "allocation", "performance")}
    return {"momentum": momentum, "fundamentals": fundamentals, "final": final, **others}


def newest_scan(store: Store, holder: str) -> str | None:
    prefix = holder.lower()
    return store.newest([f"{prefix}_partial", f"{prefix}_marketcap_partial", f"{prefix}_all"])


def preview(store: Store, holder: str) -> dict[str, DataFrame | None]:
    """The newest scan by market cap and the saved tables made of it."""
    prefix, source = holder.lower(), newest_scan(store, holder)
    found = store.load(source) if source else None
    return {f"{prefix}_all": by_market_cap(found) if found is not None else None} | {f"{prefix}_{t}": store.load(f"{prefix}_{t}") for t in ("top", "momentum", "final")}


def recover_holdings(store: Store, holder: str, prices: Prices, config: ScreeningConfig, top: int = 50, final: int = 3) -> dict[str, DataFrame]:
    """The screen made anew from the newest saved scan."""
    source = newest_scan(store, holder)
    found = store.load(source) if source else None
    if found is None:
        raise FileNotFoundError(f"no {holder.upper()} scan is saved in {store.folder}")
    return finish_holdings(found, prices, holder, config, store, top, final)
