"""Company pages: raw HTML to list items and table rows, and fetching them from a site.

A page becomes one row with ``items`` (texts of the ratio list), ``sections`` (ids that have a table) and ``rows``
(section, row_no, label, cells of (period, raw)). The parser is a small helper per page; all extraction from its rows
is column expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ids of the sections whose first table is read, and where the ratio list stands.
SECTION_IDS = ("quarters", "profit-loss", "profit-loss-consolidated", "shareholding")
RATIO_ID, RATIO_CLASS = "top-ratios", "company-ratios"
PARSED = "items array<string>, sections array<string>, rows array<struct<section:string,row_no:int,label:string,cells:array<struct<period:string,raw:string>>>>"
#: Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends of its own kind when that was left open.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Where the search for a left-open element stops.
SCOPES = {"li": {"ul", "ol", "menu"}, "p": {"div", "section", "td", "th", "li"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
#: Texts of missing cells.
MISSING = frozenset({"", "NaN", "nan", "NA", "N/A", "null", "None"})


class PageParser(HTMLParser):
    """Collects texts of ratio items and the rows of each section's first table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, str | None]] = []  # tag, whether it holds the ratios, the section it begins
        self.items: list[str] = []
        self.open_items: list[list[str]] = []
        self.tables: dict[str, list[tuple[bool, list[str]]] | None] = {}
        self.seen: set[str] = set()
        self.inside: list[tuple[str, int]] = []  # sections whose table is being read, and the table's depth
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in SCOPES[tag]:
                    break
                if self.stack[k][0] in CLOSES[tag]:
                    self._close(k)
        named = dict(attrs)
        key = named.get("id")
        ratios = (key == RATIO_ID and RATIO_ID not in self.seen) or RATIO_CLASS in (named.get("class") or "").split()
        section = key if key in SECTION_IDS and key not in self.seen else None
        if key:
            self.seen.add(key)
        if tag in VOID:
            return
        if tag == "li" and any(r for _, r, _ in self.stack):
            self.open_items.append([])
        elif tag == "table":
            for _, _, s in self.stack:
                if s and s not in self.tables:
                    self.tables[s] = []
                    self.inside.append((s, len(self.stack)))
        elif self.inside and tag == "tr":
            for s, _ in self.inside:
                self.tables[s].append((self._in_head(), []))
        elif self.inside and tag in ("td", "th"):
            self.cell = []
            for s, _ in self.inside:
                if not self.tables[s]:
                    self.tables[s].append((self._in_head(), []))
        self.stack.append((tag, ratios, section))

    def _in_head(self) -> bool:
        return any(t == "thead" for t, *_ in self.stack)

    def _close(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            if tag == "li" and self.open_items and any(r for _, r, _ in self.stack):
                texts = self.open_items.pop()
                self.items.append(" ".join(" ".join(texts).split()))
                if self.open_items:
                    self.open_items[-1] += texts
            elif tag in ("td", "th") and self.cell is not None:
                text = " ".join("".join(self.cell).split())
                for s, _ in self.inside:
                    self.tables[s][-1][1].append(text)
                self.cell = None
            elif tag == "table":
                self.inside = [(s, depth) for s, depth in self.inside if depth < len(self.stack)]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        if self.open_items and data.strip():
            self.open_items[-1].append(data.strip())


def parse_page(html: str | None) -> tuple[list[str], list[str], list[tuple[str, int, str, list[tuple[str, str]]]]]:
    """items, sections and rows of one page. The header is the table head's first row, or else the first row."""
    if not html:
        return [], [], []
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser._close(0)
    rows = []
    for section, table in parser.tables.items():
        head = next((k for k, (in_head, _) in enumerate(table) if in_head), 0)
        if not table:
            continue
        periods = [p.strip() for p in table[head][1]]
        body = [cells for k, (in_head, cells) in enumerate(table) if not in_head and k != head and cells]
        for n, cells in enumerate(body):
            padded = cells + [""] * (len(periods) - len(cells))
            pairs = [(p, None if raw in MISSING else raw) for p, raw in zip(periods[1:], padded[1:])]
            rows.append((section, n, padded[0], pairs))
    return parser.items, list(parser.tables), rows


def parsed(html: Column) -> Column:
    """items, sections and rows of a page's HTML, as a struct."""

    @F.pandas_udf(PARSED)
    def parse(column: pd.Series) -> pd.DataFrame:
        out = [parse_page(h) for h in column]
        named = [[{"section": s, "row_no": n, "label": label, "cells": [{"period": p, "raw": r} for p, r in cells]} for s, n, label, cells in rows] for *_, rows in out]
        return pd.DataFrame({"items": [i for i, *_ in out], "sections": [s for _, s, _ in out], "rows": named})

    return parse(html)


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the HTML replaced by items, sections and rows; an ``error`` column is added if there is none."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    if "error" not in pages.columns:
        others.append(F.lit(None).cast("string").alias("error"))
    return pages.withColumn("_parsed", parsed(F.col(html))).select(*others, "_parsed.*")


#: A client: gives status and text of an address, or raises.
Client = Callable[[str], tuple[int, str]]
#: What is tried again, how often, and the seconds between tries (times the try).
RETRY_STATUS, ATTEMPTS, BACKOFF = frozenset({429, 500, 502, 503, 504}), 3, 2.0
CONSOLIDATED = "/consolidated/"


def fetch(url: str, client: Client, sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> tuple[str, str | None, str | None]:
    """The address that answered, its text, and the error if there was none. A missing consolidated page falls back to
    the plain one; busy answers and failed connections are tried again."""
    error = ""
    for attempt in range(1, attempts + 1):
        try:
            used = url
            status, text = client(url)
            if status == 404 and url.endswith(CONSOLIDATED):
                used = url.removesuffix(CONSOLIDATED) + "/"
                status, text = client(used)
            if status < 400:
                return used, text, None
            error = f"HTTP status {status}"
        except Exception as failure:  # noqa: BLE001  a page that fails must not end the scan
            error = str(failure) or type(failure).__name__
        if attempt < attempts:
            sleep(BACKOFF * attempt)
    return url, None, error


def paced(pages: Iterable[tuple[str, str, str]], client: Client, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """ticker, page_url, html and error of each (ticker, page_url, lane), with ``gap`` seconds at least between two pages of
    one lane."""
    last: dict[str, float] = {}
    for ticker, url, lane in pages:
        if lane in last:
            sleep(max(0.0, last[lane] + gap - clock()))
        last[lane] = clock()
        yield ticker, *fetch(url, client, sleep)


def fetch_pages(wanted: DataFrame, make_client: Callable[[], Client], pause: float = 0.6, max_partitions: int = 4) -> DataFrame:
    """ticker, page_url, html and error for each (ticker, page_url).

    A host is asked for a page every ``pause`` seconds at most, however many tasks there are: its pages are dealt into
    ``max_partitions`` lanes, every lane is in one task, and waits so many pauses between its pages. Hosts don't wait for
    one another but where they share a task. Pages asked again at once are the business of ``fetch``; those that are to be
    tried later, and partial results that outlive a failed task, that of ``streaming.retry``.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        rows = ((ticker, url, lane) for batch in batches for ticker, url, lane in zip(batch["ticker"], batch["page_url"], batch["lane"]))
        for found in paced(rows, client, pause * max_partitions):
            yield pd.DataFrame([found], columns=["ticker", "page_url", "html", "error"])

    host = F.coalesce(F.regexp_extract("page_url", r"^[^:/]*://([^/?#]*)", 1), F.lit(""))
    lane = F.concat(host, F.lit(" "), F.pmod(F.xxhash64("page_url"), F.lit(max_partitions)).cast("string"))
    dealt = wanted.select("ticker", "page_url", lane.alias("lane"))
    return dealt.repartition("lane").mapInPandas(of, "ticker string, page_url string, html string, error string")
