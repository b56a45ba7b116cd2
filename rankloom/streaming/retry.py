"""Fetching pages as a stream that tries failed ones again: what waits, how often it was tried and when it is due are
state per ticker, and not a list that somebody has to work out anew.

Wanted pages come up as files. A page that can't be had is kept in the state and a timer brings it back later, until it
is there or ``attempts`` tries have failed; either way it is written just once, with the number of tries. Every run takes
what is there and what is due, and ends; the checkpoint keeps the rest for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankloom.sources.pages import ATTEMPTS, BACKOFF, Client, fetch

WANTED = "ticker string, page_url string"
FETCHED = "ticker string, page_url string, html string, error string, tries int"
#: The ticker of a row that only makes a run look for what is due.
BEAT = ""
#: Settings of the stream's own session: state with timers needs this store, and a run ends when no new files are there.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class PageFetcher(StatefulProcessor):
    """Fetches a ticker's page, or keeps it for a later try. ``backoff`` seconds times the tries pass in between."""

    def __init__(self, make_client: Callable[[], Client], attempts: int, backoff: float):
        self.make_client, self.attempts, self.backoff = make_client, attempts, backoff

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.client = handle, self.make_client()
        self.waiting = handle.getValueState("waiting", "page_url string, tries int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked = sorted(r.page_url for r in rows if r.page_url)
        if key[0] != BEAT and asked and not self.waiting.exists():
            yield from self._try(key[0], asked[0], 1, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            url, tries = self.waiting.get()
            yield from self._try(key[0], url, tries + 1, timerValues)

    def _try(self, ticker: str, url: str, tries: int, timers) -> Iterator[Row]:
        used, html, error = fetch(url, self.client, attempts=1)
        if error is None or tries >= self.attempts:
            self.waiting.clear()
            yield Row(ticker=ticker, page_url=used, html=html, error=error, tries=tries)
        else:
            self.waiting.update((url, tries))
            wait = max(1, int(1000 * self.backoff * tries))  # a timer that is due at once would still be of this run
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait)

    def close(self) -> None:
        pass


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, whose settings stay as they are."""
    own = spark.newSession()
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(key, value)
    return own


def fetch_wanted(spark: SparkSession, wanted_dir: str, out_dir: str, checkpoint_dir: str, make_client: Callable[[], Client], attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> StreamingQuery:
    """Fetch the wanted pages (files of ``WANTED``) that are new and those that are due, write them (``FETCHED``), and stop.

    A run without new files does nothing: ``beat`` adds one when only what is due is to be tried. A ticker that is wanted
    again while it waits keeps its place; one that was written is fetched anew. The number of shuffle partitions bounds
    how many pages are asked for at once, and is that of the first run.
    """
    wanted = own_session(spark).readStream.schema(WANTED).parquet(wanted_dir).where("ticker IS NOT NULL")
    fetched = wanted.groupBy("ticker").transformWithState(PageFetcher(make_client, attempts, backoff), FETCHED, "Append", "ProcessingTime")
    return fetched.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def want(rows: DataFrame, wanted_dir: str) -> None:
    """Add pages (ticker, page_url) to those that are wanted."""
    rows.select("ticker", "page_url").write.mode("append").parquet(wanted_dir)


def beat(spark: SparkSession, wanted_dir: str) -> None:
    """Make the next run look for what is due, without new pages."""
    want(spark.createDataFrame([(BEAT, None)], WANTED).coalesce(1), wanted_dir)
