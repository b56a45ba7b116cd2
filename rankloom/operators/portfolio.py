"""Tiered weights by rank, and the allocation of capital to current picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import INITIAL_CAPITAL
from rankloom.functions.numeric import rounded
from rankloom.operators.rank import keep_first

#: Names held, of which the first ones share the larger part.
NAMES, TOP, TOP_SHARE, TAIL_SHARE = 10, 5, 0.70, 0.30


def tier_weight(rank: Column, count: Column) -> Column:
    """The weight of a rank among ``count`` names: equal up to five; else 70 % to the first five, 30 % to the others."""
    n = F.least(count, F.lit(NAMES))
    tiered = F.when(rank <= TOP, F.lit(TOP_SHARE / TOP)).when(rank <= n, F.lit(TAIL_SHARE) / (n - TOP))
    return F.when(rank > n, F.lit(0.0)).when(n <= TOP, F.lit(1.0) / n).otherwise(tiered)


def current_allocation(picks: DataFrame, capital: float = INITIAL_CAPITAL) -> DataFrame:
    """rank, ticker, symbol, name, weight, cmp, amount and shares of the ten best picks (score, then ticker).

    A symbol that is there twice counts once, as the better pick.
    """
    name = F.coalesce("name", F.lit("")) if "name" in picks.columns else F.lit("")
    rows = picks.select("ticker", F.upper("symbol").alias("symbol"), name.alias("name"), "score", "cmp")
    rows = keep_first(rows, ["symbol"], [F.desc("score"), F.asc("ticker")])
    ten = rows.orderBy(F.desc("score"), "ticker").limit(NAMES)
    ten = ten.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ticker")))
    ten = ten.withColumn("_w", tier_weight(F.col("rank"), F.count("*").over(Window.partitionBy())))
    price = F.when(F.col("cmp") > 0, F.col("cmp"))
    amount = F.col("_w") * capital
    return ten.select("rank", "ticker", "symbol", "name", rounded(F.col("_w"), 4).alias("weight"), rounded(price).alias("cmp"), rounded(amount).alias("amount"), rounded(amount / price, 4).alias("shares"))
