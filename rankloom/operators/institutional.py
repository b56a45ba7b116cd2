"""Holding scans that can be resumed, shortlists of rising holdings, and market-cap enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import CRORE, HOLDER_LABELS
from rankloom.functions.holdings import holding_change
from rankloom.functions.numeric import rounded, to_double
from rankloom.operators.fundamentals import FETCH_FAILED, market_cap
from rankloom.operators.rank import keep_first, nulls_last, top_n
from rankloom.operators.universe import normal_ticker

HOLDING_FIELDS = ("previous_period", "latest_period", "previous_holding_pct", "latest_holding_pct", "holding_change_pct")
#: What a saved scan must have to be gone on with.
REQUIRED = ("ticker", "market_cap_cr", "holding_change_pct", "scan_notes")


def scan_holdings(universe: DataFrame, pages: DataFrame, holder: str) -> DataFrame:
    """``universe`` with a holder's periods, holdings and change, market cap (rupees and crore) and scan_notes."""
    prefix = holder.upper()
    cap = market_cap(F.col("items"))
    found = pages.select(F.col("ticker").alias("_ticker"), F.col("page_url").alias("_url"), "error", cap.alias("market_cap_cr"), *[c.alias(n) for n, c in holding_change(F.col("rows"), HOLDER_LABELS[prefix]).items()])
    base = universe.drop("market_cap", "market_cap_cr", "scan_notes", "error", *HOLDING_FIELDS)
    joined = base.join(found, normal_ticker(F.col("ticker")) == F.col("_ticker"), "left")
    failed = F.col("_ticker").isNull() | F.col("error").isNotNull()
    notes = F.when(failed, F.concat(F.lit(f"{FETCH_FAILED}: "), F.coalesce("error", F.lit("no page")))).when(F.col("holding_change_pct").isNotNull(), "ok").otherwise(f"missing {prefix} row")
    out: dict[str, Column] = {"market_cap_cr": F.when(~failed, F.col("market_cap_cr")), "scan_notes": notes}
    out |= {f: F.when(~failed, F.col(f)) for f in HOLDING_FIELDS}
    if "page_url" in universe.columns:
        out["page_url"] = F.when(failed, F.col("page_url")).otherwise(F.col("_url"))
    return joined.withColumns(out).withColumn("market_cap", F.col("market_cap_cr") * CRORE).drop("_ticker", "_url", "error")


def completed(saved: DataFrame | None, order: str = "scan_order") -> DataFrame | None:
    """The rows of a saved scan that need no new try: the last of each ticker, unless its fetch failed. None where the
    scan lacks what it must have, and all is to be scanned."""
    if saved is None or not set(REQUIRED) <= set(saved.columns):
        return None
    nth = F.col(order) if order in saved.columns else F.monotonically_increasing_id()  # without an order, that of the rows
    last = keep_first(saved.withColumn("_order", nth), ["ticker"], [F.desc("_order")]).drop("_order")
    return last.where(~F.startswith(F.coalesce("scan_notes", F.lit("")), F.lit(FETCH_FAILED)))


def pending(universe: DataFrame, done: DataFrame | None) -> DataFrame:
    """The tickers still to scan."""
    if done is None:
        return universe
    keys = done.select(normal_ticker(F.col("ticker")).alias("_done")).distinct()
    return universe.join(keys, normal_ticker(F.col("ticker")) == F.col("_done"), "left_anti")


def resumed(done: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old and new rows; columns that either lacks are null. Tickers that left the universe stay."""
    return new if done is None else done.unionByName(new, allowMissingColumns=True)


def by_market_cap(scan: DataFrame) -> DataFrame:
    """The whole scan, largest market cap first, missing ones last."""
    if "market_cap_cr" not in scan.columns:
        return scan
    return scan.withColumn("market_cap_cr", to_double(F.col("market_cap_cr").cast("string"))).orderBy(*nulls_last("market_cap_cr", "ticker"))


def shortlist(scan: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` largest rises (ties by market cap, then ticker); no column or no rise, no rows."""
    if "holding_change_pct" not in scan.columns:
        scan = scan.withColumn("holding_change_pct", F.lit(None).cast("double"))
    rows = scan.withColumn("holding_change_pct", to_double(F.col("holding_change_pct").cast("string"))).where("holding_change_pct > 0")
    ties = [F.desc_nulls_last("market_cap_cr")] if "market_cap_cr" in scan.columns else []
    return top_n(rows, [F.desc("holding_change_pct"), *ties, F.asc("ticker")], n)


def enrich_market_cap(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Market caps from ``lookup`` (symbol, market_cap) where ``rows`` have none, and the same in crore.

    A zero in the lookup is a missing value. Without a symbol column nothing changes.
    """
    if "symbol" not in rows.columns:
        return rows
    have = to_double(F.col("market_cap").cast("string")) if "market_cap" in rows.columns else F.lit(None).cast("double")
    found = lookup.groupBy(F.upper("symbol").alias("_symbol")).agg(F.max(F.nullif(F.col("market_cap").cast("double"), F.lit(0.0))).alias("_cap"))
    joined = rows.withColumn("market_cap", have).join(found, F.upper("symbol") == F.col("_symbol"), "left")
    cap = F.coalesce("market_cap", "_cap")
    return joined.withColumn("market_cap", cap).withColumn("market_cap_cr", rounded(F.col("market_cap") / CRORE)).drop("_symbol", "_cap")


def scan_counts(scan: DataFrame) -> DataFrame:
    """The counts that a report shows: tickers, rises, and the largest change."""
    change = to_double(F.col("holding_change_pct").cast("string"))
    return scan.agg(F.count("*").alias("n_tickers"), F.count_if(change > 0).alias("n_rising"), F.max(change).alias("max_change"))
