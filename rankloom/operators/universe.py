"""The ticker universe: cleaned, each ticker once, with its price symbol and page address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import percent_encode, strip
from rankloom.operators.rank import keep_first

SUFFIX = ".NS"
#: Where company pages are; a deployment names its own site.
PAGE_TEMPLATE = ("https://pages.example.com/company/", "/consolidated/")


def normal_ticker(ticker: Column) -> Column:
    return F.upper(strip(ticker))


def price_symbol(ticker: Column) -> Column:
    """With the exchange suffix, unless it is there already."""
    return F.when(F.endswith(ticker, F.lit(SUFFIX)), ticker).otherwise(F.concat(ticker, F.lit(SUFFIX)))


def page_url(ticker: Column, template: tuple[str, str] = PAGE_TEMPLATE) -> Column:
    return F.concat(F.lit(template[0]), percent_encode(ticker), F.lit(template[1]))


def normalize_universe(raw: DataFrame, order: Column, template: tuple[str, str] = PAGE_TEMPLATE) -> DataFrame:
    """Rows with a ticker, the first of each by ``order``; other columns pass through."""
    rows = raw.withColumn("ticker", normal_ticker(F.col("ticker"))).where("ticker IS NOT NULL AND ticker NOT IN ('', 'NAN')")
    rows = keep_first(rows, ["ticker"], [order])
    return rows.withColumns({"symbol": price_symbol(F.col("ticker")), "page_url": page_url(F.col("ticker"), template)})
