"""Price panels in long form (ticker, date, close): from wide or long tables, and from a provider in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from rankloom.functions.numeric import not_nan
from rankloom.operators.rank import keep_first

PANEL = "ticker string, date date, close double"


def long_panel(rows: DataFrame, ticker: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """Upper-case tickers, dates without time, NaN as null; of equal keys the largest close."""
    panel = rows.select(F.upper(F.col(f"`{ticker}`").cast("string")).alias("ticker"), F.to_date(F.col(f"`{date}`")).alias("date"), not_nan(F.col(f"`{close}`").cast("double")).alias("close"))
    return panel.where("ticker IS NOT NULL AND date IS NOT NULL").groupBy("ticker", "date").agg(F.max("close").alias("close"))


def from_wide(wide: DataFrame, date: str = "date") -> DataFrame:
    """One column per ticker becomes long rows; of columns that are equal but for case the first stays."""
    names = [c for c in wide.columns if c != date]
    kept = list({c.upper(): c for c in reversed(names)}.values())[::-1]
    if any(c.upper() == "CLOSE" for c in kept) and len(kept) > 1:
        raise ValueError("a column named close among tickers: the provider's answer was not split by ticker")
    typed = wide.select(F.col(f"`{date}`").alias("_date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in kept])
    return long_panel(typed.unpivot(["_date"], [F.col(f"`{c}`") for c in kept], "ticker", "close"), date="_date")


def symbols_of(panel: DataFrame) -> DataFrame:
    """The tickers that the source knows, with or without a close."""
    return panel.select("ticker").distinct()


def batches(values: Sequence[str], size: int) -> list[list[str]]:
    return [list(values[k : k + size]) for k in range(0, len(values), size)]


#: A provider: rows (ticker, date, close) of a batch of tickers over a span such as ``6y`` or ``15mo``.
Provider = Callable[[list[str], str], Iterator[tuple]]


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        self.tickers = tickers


class PriceReader(DataSourceReader):
    def __init__(self, provider: Provider, tickers: list[str], span: str, size: int):
        self.provider, self.tickers, self.span, self.size = provider, tickers, span, size

    def partitions(self) -> list[Batch]:
        return [Batch(b) for b in batches(self.tickers, self.size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if partition.tickers:
            yield from self.provider(partition.tickers, self.span)


def price_source(provider: Provider, name: str = "prices") -> type[DataSource]:
    """A data source class around a provider; register it with ``spark.dataSource.register``.

    Options: tickers (comma-separated), span (default 6y), batch (default 80). Each batch is a partition, so that
    executors ask in parallel and a lost one asks again for its batch alone.
    """

    class PriceSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PANEL

        def reader(self, schema) -> PriceReader:
            tickers = [t for t in self.options.get("tickers", "").split(",") if t]
            return PriceReader(provider, tickers, self.options.get("span", "6y"), int(self.options.get("batch", "80")))

    return PriceSource


#: A provider by dates: rows (ticker, date, close) of a batch of tickers from one date to another, both included.
DatedProvider = Callable[[list[str], date, date], Iterator[tuple]]
#: The setting without which Spark hands Python sources no filters.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: What is asked for where no filter or option says otherwise.
FIRST_DAY = date(1900, 1, 1)


class Ask(InputPartition):
    """A batch of tickers over some dates."""

    def __init__(self, tickers: list[str], since: date, until: date):
        self.tickers, self.since, self.until = tickers, since, until


class DatedReader(DataSourceReader):
    """Takes tickers and dates out of the filters of a query, so that the provider is asked for nothing else."""

    def __init__(self, provider: DatedProvider, tickers: list[str] | None, since: date, until: date, size: int):
        self.provider, self.tickers, self.since, self.until, self.size = provider, tickers, since, until, size

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        day = timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("ticker",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = sorted(asked if self.tickers is None else asked & set(self.tickers))
            elif column == ("date",) and isinstance(f, EqualTo):
                self.since, self.until = max(self.since, f.value), min(self.until, f.value)
            elif column == ("date",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.since = max(self.since, f.value + day if isinstance(f, GreaterThan) else f.value)
            elif column == ("date",) and isinstance(f, LessThan | LessThanOrEqual):
                self.until = min(self.until, f.value - day if isinstance(f, LessThan) else f.value)
            elif column in (("ticker",), ("date",)) and isinstance(f, IsNotNull):
                pass  # a provider has no rows without them
            else:
                yield f

    def partitions(self) -> list[Ask]:
        if self.tickers is None:
            raise ValueError("ask for tickers by a filter (ticker = ... or ticker IN (...)) or by the option tickers")
        return asks(self.tickers, self.since, self.until, self.size) or [Ask([], self.since, self.until)]

    def read(self, partition: Ask) -> Iterator[tuple]:
        if partition.tickers:
            yield from self.provider(partition.tickers, partition.since, partition.until)


class DatedStream(DataSourceStreamReader):
    """Closes day by day: the offset is the last date that was read."""

    def __init__(self, provider: DatedProvider, tickers: list[str], since: date, until: date, size: int):
        self.provider, self.tickers, self.since, self.until, self.size = provider, tickers, since, until, size

    def initialOffset(self) -> dict:
        return {"date": (self.since - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        return {"date": max(self.until, self.since - timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Ask]:
        return asks(self.tickers, date.fromisoformat(start["date"]) + timedelta(days=1), date.fromisoformat(end["date"]), self.size)

    def read(self, partition: Ask) -> Iterator[tuple]:
        yield from self.provider(partition.tickers, partition.since, partition.until)


def asks(tickers: list[str], since: date, until: date, size: int) -> list[Ask]:
    return [Ask(b, since, until) for b in batches(tickers, size)] if since <= until else []


def register_dated_source(spark: SparkSession, provider: DatedProvider, name: str = "dated_prices") -> str:
    """Register a provider as a source for ``spark.read`` and ``spark.readStream``, and give its name.

    Tickers and dates come from the query's filters; a stream, which has no filters to give, takes the options tickers
    (comma-separated), since and until (ISO dates; until is today unless given, and each start of the stream reads what
    has come up since the last). Each batch of tickers is a partition (option batch). Filters reach Python sources only
    with a setting of the session, which concerns no other source and is turned on here.
    """

    class DatedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PANEL

        def _asked(self) -> tuple:
            option = lambda key, other: date.fromisoformat(self.options[key]) if key in self.options else other
            named = [t for t in self.options.get("tickers", "").split(",") if t]
            return named, option("since", FIRST_DAY), option("until", date.today()), int(self.options.get("batch", "80"))

        def reader(self, schema) -> DatedReader:
            named, *rest = self._asked()
            return DatedReader(provider, named or None, *rest)

        def streamReader(self, schema) -> DatedStream:
            return DatedStream(provider, *self._asked())

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(DatedSource)
    return name


def fetch_prices(symbols: DataFrame, make_provider: Callable[[], DatedProvider], since: date, until: date, batch: int = 80, max_partitions: int = 4) -> DataFrame:
    """ticker, date and close of the distinct symbols (a column ticker) of a table of any size, asked for where they are:
    each partition goes through its symbols in batches, and the number of partitions bounds the requests at a time."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for frame in frames:
            for some in batches(frame["ticker"].tolist(), batch):
                yield pd.DataFrame(list(provider(some, since, until)), columns=["ticker", "date", "close"])

    wanted = symbols.where("ticker IS NOT NULL").select(F.upper("ticker").alias("ticker")).distinct()
    return wanted.repartition(max_partitions, "ticker").mapInPandas(of, PANEL)


def from_answer(answer: DataFrame, tickers: Sequence[str], date: str = "date") -> DataFrame:
    """A provider's answer as long rows. An answer for one ticker is flat: date, open, close and others, without a column
    for the ticker, and its close counts; any other answer has a column of closes for each ticker."""
    low = {c.lower(): c for c in answer.columns}
    if len(tickers) == 1 and "close" in low and tickers[0].lower() not in low:
        return long_panel(answer.select(F.lit(tickers[0]).alias("ticker"), F.col(f"`{date}`").alias("date"), F.col(f"`{low['close']}`").alias("close")))
    return from_wide(answer, date)


def first_available(quotes: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """The rows of the first candidate that has any close."""
    order = F.array_position(F.array(*[F.lit(c.upper()) for c in candidates]), F.upper("ticker"))
    ranked = quotes.withColumn("_k", order).where("_k > 0 AND close IS NOT NULL")
    best = ranked.agg(F.min("_k").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_k") == F.col("_best")).drop("_k", "_best")


def latest_rows(panel: DataFrame) -> DataFrame:
    """The last close of each ticker."""
    return keep_first(panel.where("close IS NOT NULL"), ["ticker"], [F.desc("date")])
