"""Fundamental metrics from parsed pages, and the four rules with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import PROMOTER_LABELS, SALES_LABELS, FundamentalThresholds
from rankloom.functions.holdings import change, metric_row, numeric_cells, trailing_growth
from rankloom.functions.numeric import fixed_text, parse_number

#: What a failed fetch begins with; such rows are tried again.
FETCH_FAILED = "Page fetch failed"
METRICS = ("market_cap_cr", "quarterly_growth_pct", "annual_growth_pct", "promoter_change_pct")


def market_cap(items: Column) -> Column:
    """The number in the first list item that names the market cap; null if it has none."""
    named = F.filter(items, lambda t: F.contains(t, F.lit("Market Cap")))
    return parse_number(F.get(named, F.lit(0)))


def page_metrics(pages: DataFrame) -> DataFrame:
    """``pages`` with parsed items, sections and rows becomes ``pages`` with the four metrics in their place."""
    rows = F.col("rows")
    annual = F.when(F.array_contains("sections", "profit-loss"), F.lit("profit-loss")).otherwise(F.lit("profit-loss-consolidated"))
    annual_rows = F.transform(F.filter(rows, lambda r: r["section"] == annual), lambda r: r.withField("section", F.lit("annual")))
    metrics = {
        "market_cap_cr": market_cap(F.col("items")),
        "quarterly_growth_pct": trailing_growth(numeric_cells(metric_row(rows, "quarters", SALES_LABELS))),
        "annual_growth_pct": trailing_growth(numeric_cells(metric_row(annual_rows, "annual", SALES_LABELS))),
        "promoter_change_pct": change(numeric_cells(metric_row(rows, "shareholding", PROMOTER_LABELS))),
    }
    return pages.withColumns(metrics).drop("items", "sections", "rows")


def promoter_size(change_pct: Column, zero_is_missing: bool = True) -> Column:
    """The absolute change. A missing one counts as 9999, and so does exactly zero unless told otherwise."""
    value = F.nullif(change_pct, F.lit(0.0)) if zero_is_missing else change_pct
    return F.abs(F.coalesce(value, F.lit(9999.0)))


def apply_rules(rows: DataFrame, thresholds: FundamentalThresholds | None = None, zero_is_missing: bool = True) -> DataFrame:
    """``rows`` with the four metrics gains fundamental_pass and fundamental_notes.

    Bounds are inclusive. Notes list what is missing or fails, in the order of the rules, or say ``passed``.
    """
    t = thresholds or FundamentalThresholds()
    checks = [
        (F.col("market_cap_cr"), t.min_market_cap_cr, ">=", "market cap"),
        (F.col("quarterly_growth_pct"), t.min_quarterly_growth_pct, ">=", "quarterly revenue growth"),
        (F.col("annual_growth_pct"), t.min_annual_growth_pct, ">=", "annual revenue growth"),
        (promoter_size(F.col("promoter_change_pct"), zero_is_missing), t.max_promoter_change_pct, "<=", "promoter holding change"),
    ]
    passed, notes = F.lit(True), []
    for value, bound, sign, label in checks:
        fine = value >= bound if sign == ">=" else value <= bound
        passed = passed & F.coalesce(fine, F.lit(False))
        failing = F.concat(F.lit(f"{label} "), fixed_text(value), F.lit(f" fails {sign} {bound:.2f}"))
        notes.append(F.when(value.isNull(), f"missing {label}").when(~fine, failing))
    return rows.withColumns({"fundamental_pass": passed, "fundamental_notes": F.when(passed, "passed").otherwise(F.concat_ws("; ", *notes))})


def screen_fundamentals(candidates: DataFrame, pages: DataFrame, thresholds: FundamentalThresholds | None = None) -> DataFrame:
    """``candidates`` with the metrics of their pages and the rules' outcome.

    ``pages`` has ticker, page_url, error (null if fetched) and the parsed columns; a candidate without a page, or with
    an error, fails with a note. Columns of the candidates that clash are replaced.
    """
    metrics = page_metrics(pages).select(F.col("ticker").alias("_ticker"), F.col("page_url").alias("_url"), "error", *METRICS)
    base = candidates.drop(*METRICS, "error", "fundamental_pass", "fundamental_notes")
    joined = base.join(metrics, F.col("ticker") == F.col("_ticker"), "left")
    judged = apply_rules(joined, thresholds)
    failed = F.col("_ticker").isNull() | F.col("error").isNotNull()
    note = F.concat(F.lit(f"{FETCH_FAILED}: "), F.coalesce("error", F.lit("no page")))
    out = {m: F.when(~failed, F.col(m)) for m in METRICS}
    out |= {"fundamental_pass": F.col("fundamental_pass") & ~failed, "fundamental_notes": F.when(failed, note).otherwise(F.col("fundamental_notes"))}
    if "page_url" in candidates.columns:
        out["page_url"] = F.coalesce("_url", "page_url")
    return judged.withColumns(out).drop("_ticker", "_url", "error")
