"""Expressions over a page's table rows: arrays of (section, row_no, label, cells of (period, raw))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.numeric import clean_label, growth_pct, parse_number, rounded, starts_with_any, strip


def metric_row(rows: Column, section: str, labels: tuple[str, ...]) -> Column:
    """The first row of the section, in table order, whose label starts with any of the labels; null without one."""
    fits = F.filter(rows, lambda r: (r["section"] == section) & starts_with_any(clean_label(r["label"]), labels))
    return F.try_element_at(F.array_sort(fits, lambda a, b: a["row_no"] - b["row_no"]), F.lit(1))


def numeric_cells(row: Column, include_ttm: bool = False) -> Column:
    """(period, value) of the cells that hold a number, in order."""
    cells = F.coalesce(row["cells"], F.array().cast("array<struct<period:string,raw:string>>"))
    parsed = F.transform(cells, lambda c: F.struct(strip(c["period"]).alias("period"), parse_number(c["raw"]).alias("value")))
    return F.filter(parsed, lambda c: c["value"].isNotNull() & (F.lit(include_ttm) | (F.upper(c["period"]) != "TTM")))


def last_two(cells: Column) -> tuple[Column, Column]:
    """The last but one and the last cell; both null where there are fewer than two."""
    pair = F.when(F.size(cells) >= 2, F.slice(cells, -2, 2))
    return F.get(pair, 0), F.get(pair, 1)


def trailing_growth(cells: Column) -> Column:
    previous, latest = last_two(cells)
    return rounded(growth_pct(latest["value"], previous["value"]))


def change(cells: Column) -> Column:
    previous, latest = last_two(cells)
    return rounded(latest["value"] - previous["value"])


def holding_change(rows: Column, labels: tuple[str, ...], section: str = "shareholding") -> dict[str, Column]:
    """Periods, holdings and the change between the last two periods of a holder's row."""
    cells = numeric_cells(metric_row(rows, section, labels))
    previous, latest = last_two(cells)
    return {
        "previous_period": previous["period"],
        "latest_period": latest["period"],
        "previous_holding_pct": rounded(previous["value"]),
        "latest_holding_pct": rounded(latest["value"]),
        "holding_change_pct": change(cells),
    }
