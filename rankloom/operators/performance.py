"""Curves as long rows (date, series, value): base values, scales, returns and drawdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.config import INITIAL_CAPITAL
from rankloom.functions.numeric import growth_pct, rounded
from rankloom.operators.segmented import running_max, segmented_scan


def performance_summary(curves: DataFrame) -> DataFrame:
    """series, start, end, start_value, end_value, return_pct and max_drawdown_pct of each series; missing values don't count.

    The running maximum is taken by years, so that no task meets a whole series."""
    rows = segmented_scan(curves.where("value IS NOT NULL"), ["series"], ["date"], F.year("date"), {"_top": running_max("value")})
    rows = rows.withColumn("_draw", (F.col("value") / F.col("_top") - 1.0) * 100.0)
    first, last = F.min_by("value", "date"), F.max_by("value", "date")
    return rows.groupBy("series").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        rounded(first).alias("start_value"),
        rounded(last).alias("end_value"),
        rounded(growth_pct(last, first)).alias("return_pct"),
        rounded(F.min("_draw")).alias("max_drawdown_pct"),
    )


def normalized(curves: DataFrame, base: float = INITIAL_CAPITAL, to: float = 100.0) -> DataFrame:
    """Values per ``to`` of the capital that all began with."""
    return curves.withColumn("value", F.col("value") / base * to)


def wide(curves: DataFrame, series: Sequence[str]) -> DataFrame:
    """One column for each of the given series, one row for each date."""
    return curves.groupBy("date").pivot("series", list(series)).agg(F.first("value"))


def long(curves: DataFrame, series: Sequence[str]) -> DataFrame:
    """Wide curves as rows; missing values stay out."""
    return curves.unpivot("date", list(series), "series", "value").where("value IS NOT NULL")
