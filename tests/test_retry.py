"""Pages by rate and by state: lanes of a host, tries over several runs, and nothing written twice."""

import time

from pyspark.sql import functions as F

from rankloom.sources import pages
from rankloom.streaming import incremental, retry


def test_lanes_keep_their_distance():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(round(seconds, 3))
        now[0] += seconds

    def client(url):
        now[0] += 0.25
        return (429, "") if url == "b" and waits.count(2.0) < 1 else (200, url)

    got = list(pages.paced([("A", "a", "x"), ("B", "b", "x"), ("C", "c", "y"), ("D", "d", "x")], client, 1.0, lambda: now[0], sleep))
    assert [g[0] for g in got] == list("ABCD") and all(g[3] is None for g in got)
    assert waits == [0.75, 2.0, 0.0]  # the lane, what was busy, and a lane that has waited long enough


def test_a_host_is_asked_at_a_bounded_rate(spark):
    wanted = spark.createDataFrame([(f"T{k}", f"http://{'one' if k < 18 else 'two'}.example/{k}") for k in range(24)], "ticker string, page_url string")
    client = lambda: lambda url: (200, repr(time.time()))
    got = pages.fetch_pages(wanted, client, pause=0.1, max_partitions=3).collect()
    assert len(got) == 24
    for host in ("one", "two"):
        at = sorted(float(r.html) for r in got if host in r.page_url)
        # Three lanes, each with a page every 0.3 seconds: no more than three in any such span, and a little for the clock.
        assert all(b - a > 0.28 for a, b in zip(at, at[3:]))


def test_failed_pages_come_back(spark, tmp_path):
    wanted, out, cp = (str(tmp_path / x) for x in ("wanted", "out", "cp"))
    rows = lambda *names: spark.createDataFrame([(n, f"h/{n}/consolidated/") for n in names], retry.WANTED)

    def run(down, attempts=3):
        client = lambda: lambda url: (503, "") if any(f"/{d}/" in url for d in down) else ((404, "") if url == "h/B/consolidated/" else (200, "text"))
        retry.fetch_wanted(spark, wanted, out, cp, client, attempts, 0.0).awaitTermination()
        return sorted((r.ticker, r.page_url, r.html, r.error, r.tries) for r in spark.read.schema(retry.FETCHED).parquet(out).collect())

    before = {k: spark.conf.get(k, None) for k in retry.SETTINGS}
    retry.want(rows("A", "B", "C", "D"), wanted)
    assert run("CD") == [("A", "h/A/consolidated/", "text", None, 1), ("B", "h/B/", "text", None, 1)]
    retry.want(rows("C", "E"), wanted)  # C is wanted again while it waits
    got = run("D")
    assert ("C", "h/C/consolidated/", "text", None, 2) in got and len(got) == 4
    assert run("") == got  # nothing new, nothing tried
    retry.beat(spark, wanted)
    assert [r for r in run("D") if r[0] == "D"] == [("D", "h/D/consolidated/", None, "HTTP status 503", 3)]
    retry.beat(spark, wanted)
    assert len(run("")) == 5  # given up for good
    assert {k: spark.conf.get(k, None) for k in retry.SETTINGS} == before


def test_daily_closes_of_ticks(spark, tmp_path):
    ticks = spark.createDataFrame([("a", "2024-01-01 09:00:00", 1.0), ("a", "2024-01-01 15:00:00", 2.0), ("b", "2024-01-02 10:00:00", 3.0), ("a", "2024-01-09 00:00:00", 9.0)], "ticker string, at string, price double")
    ticks.select("ticker", F.to_timestamp("at").alias("ts"), "price").write.parquet(str(tmp_path / "in"))
    stream = incremental.daily_closes(spark.readStream.schema("ticker string, ts timestamp, price double").parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.ticker, str(r.date), r.close) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "2024-01-01", 2.0), ("b", "2024-01-02", 3.0)]  # the last day is still open
