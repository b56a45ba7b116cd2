"""Trailing returns over a count of observations, from a long price panel (ticker, date, close)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import HORIZONS
from rankloom.functions.numeric import growth_pct, rounded

#: Shares into which a ticker's history is dealt.
DEALT = 8
#: Fixed values of the status column.
NO_HISTORY = "No price history from Yahoo Finance"
NO_TICKER = "Ticker missing from Yahoo Finance response"


def trailing_returns(panel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """ticker, data_points, cmp and ret_<h> for each horizon: the change from the h-th observation before the last.

    Missing closes are no observations. A ticker's rows are first dealt by a hash of their dates into ``DEALT`` shares,
    each of which is ranked by itself, counted in the same pass, and cut to its last max(h) + 1 observations; the
    shares' remainders are then put together. One scan, and no task meets more than a share of a ticker's history or
    more than ``DEALT`` remainders.
    """
    depth = max(horizons) + 1
    share = ["ticker", "_share"]
    dealt = panel.select("ticker", "date", "close", F.pmod(F.xxhash64("date"), F.lit(DEALT)).alias("_share"))
    known = F.col("close").isNotNull()
    nth = F.row_number().over(Window.partitionBy(*share).orderBy(F.desc(known), F.desc("date")))
    ranked = dealt.withColumns({"_nth": nth, "_count": F.count("close").over(Window.partitionBy(*share))}).where(F.col("_nth") <= depth)
    last = F.sort_array(F.collect_list(F.when(known, F.struct("date", "close"))), asc=False)  # DEALT * depth at most
    found = ranked.groupBy("ticker").agg(last.alias("_last"), F.sum(F.when(F.col("_nth") == 1, F.col("_count"))).alias("data_points"))
    at = lambda k: F.get("_last", F.lit(k))["close"]
    rets = [rounded(growth_pct(at(0), at(h))).alias(f"ret_{h}") for h in horizons]
    return found.select("ticker", "data_points", rounded(at(0)).alias("cmp"), *rets)


def universe_returns(universe: DataFrame, panel: DataFrame, symbols: DataFrame | None = None, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The universe with data_points, cmp, returns and price_error; ``symbols`` (ticker) lists what the source returned,
    where that is more than the panel's tickers.

    Columns of the universe that clash with the computed ones are replaced.
    """
    rets = trailing_returns(panel, horizons).withColumnRenamed("ticker", "_symbol")
    made = {"data_points", "cmp", "price_error", *(f"ret_{h}" for h in horizons)}
    base = universe.drop(*[c for c in universe.columns if c in made])
    joined = base.join(rets, F.upper("symbol") == F.col("_symbol"), "left")
    if symbols is None:
        joined = joined.withColumn("_known", F.col("_symbol"))
    else:
        known = symbols.select(F.upper("ticker").alias("_known")).distinct()
        joined = joined.join(known, F.upper("symbol") == F.col("_known"), "left")
    count = F.coalesce("data_points", F.lit(0).cast("long"))
    error = F.when(F.col("_known").isNull() & F.col("_symbol").isNull(), NO_TICKER).when(count == 0, NO_HISTORY).otherwise("")
    return joined.withColumns({"data_points": count, "price_error": error}).drop("_symbol", "_known")
