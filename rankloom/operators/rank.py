"""Order-dependent choices with the order spelled out: first and last of equal keys, top rows, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by ``order``. Tasks drop the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def top_n(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, in order."""
    return rows.orderBy(*order).limit(int(n))


def top_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def nulls_last(column: str, *ties: str) -> list[Column]:
    """Largest first, missing values at the end, ties by the other columns."""
    return [F.col(column).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
