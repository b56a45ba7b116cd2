"""The weighted score of trailing returns and the gate of positive ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import DEFAULT_GATE, DEFAULT_WEIGHTS
from rankloom.functions.numeric import rounded


def weighted(weights: Mapping[int, float], missing_as_zero: bool, prefix: str = "ret_") -> Column:
    """The returns' weighted mean, added in the order of the weights. A missing return counts as zero or makes it null."""
    total = sum(weights.values())
    value = lambda h: F.coalesce(f"{prefix}{h}", F.lit(0.0)) if missing_as_zero else F.col(f"{prefix}{h}")
    return reduce(lambda acc, h: acc + value(h) * (weights[h] / total), weights, F.lit(0.0))


def all_positive(columns: Sequence[str]) -> Column:
    """Whether every column is above zero; a missing one isn't."""
    return reduce(lambda acc, c: acc & F.coalesce(F.col(c) > 0, F.lit(False)), columns, F.lit(True))


def score_momentum(returns: DataFrame, weights: Mapping[int, float] | None = None, gate: Sequence[int] = DEFAULT_GATE) -> DataFrame:
    """The rows whose gate returns are all positive, with score and pass, best first (ties by ticker)."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    usable = {h: w for h, w in weights.items() if f"ret_{h}" in returns.columns}
    if sum(usable.values()) <= 0:
        raise ValueError("the weights of the horizons that there are must sum to more than zero")
    absent = [h for h in gate if f"ret_{h}" not in returns.columns]
    if absent:
        raise KeyError(f"no returns for the gate's horizons {absent}")
    scored = returns.withColumns({"score": rounded(weighted(usable, True)), "pass": all_positive([f"ret_{h}" for h in gate])})
    return scored.where("pass").orderBy(F.desc("score"), "ticker")
