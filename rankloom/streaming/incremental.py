"""An extension: the holding scan as an incremental stream of page files.

New page files are scanned when they come up and appended to a table; the stream's checkpoint is the set of files that
are done. Pages whose fetch failed are fetched again by ``retry``, before they come here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.institutional import scan_holdings
from rankloom.sources.pages import parse_pages

PAGE_SCHEMA = "ticker string, page_url string, html string, error string"


def scan_new_pages(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint_dir: str, holder: str) -> StreamingQuery:
    """Scan the page files that are there and not done yet, then stop."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(pages_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        universe = batch.select("ticker", "page_url")
        found = scan_holdings(universe, parse_pages(batch), holder).withColumn("scan_order", F.lit(batch_id).cast("long"))
        found.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_dir)  # a batch that runs twice replaces itself

    return pages.writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).foreachBatch(write).start()


def daily_closes(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """A stream of (ticker, ts, price) as daily last prices, with a watermark for late ticks."""
    timed = ticks.withWatermark("ts", late)
    day = F.window("ts", "1 day")
    return timed.groupBy("ticker", day).agg(F.max_by("price", "ts").alias("close")).select("ticker", F.to_date("window.start").alias("date"), "close")
