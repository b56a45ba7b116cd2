"""Market caps of symbols from a provider, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.sources.prices import batches

#: Gives the market caps of a batch of symbols; it may leave symbols out.
CapClient = Callable[[list[str]], dict[str, float | None]]
#: Fixed value: symbols asked for at once.
BATCH = 40


def usable_cap(value: object) -> float | None:
    """A number other than zero; anything else is missing."""
    try:
        return float(value) or None
    except (TypeError, ValueError):
        return None


def fetch_market_caps(rows: DataFrame, make_client: Callable[[], CapClient], batch: int = BATCH, max_partitions: int = 4) -> DataFrame:
    """symbol and market_cap of the distinct symbols of ``rows`` that have none yet; a batch that fails has none."""
    wanted = rows.where("market_cap IS NULL") if "market_cap" in rows.columns else rows
    symbols = wanted.where("symbol IS NOT NULL").select(F.upper("symbol").alias("symbol")).distinct()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            for some in batches(frame["symbol"].tolist(), batch):
                try:
                    found = client(some)
                except Exception:  # noqa: BLE001  symbols without an answer stay without a market cap
                    found = {}
                yield pd.DataFrame({"symbol": some, "market_cap": pd.Series([usable_cap(found.get(s)) for s in some], dtype="float64")})

    return symbols.repartition(max_partitions).mapInPandas(of, "symbol string, market_cap double")
