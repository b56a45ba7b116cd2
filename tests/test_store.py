"""Saved tables: writes that count whole or not at all, runs, counts taken while writing, and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom import cli
from rankloom.config import ScreeningConfig
from rankloom.functions.numeric import fixed_text
from rankloom.plans import recovery, screen
from rankloom.sources.store import Store


def rows(spark, *values):
    return spark.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "ticker string, score double")


def failing(spark):
    """One of its tasks fails after others have written."""
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string"))
    return spark.range(0, 100, 1, 4).select(bad.cast("string").alias("ticker"), F.lit(1.0).alias("score"))


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save("momentum", rows(spark, "a", "b"))
    for write in (store.append, store.save):
        with pytest.raises(Exception, match="lost"):
            write("momentum", failing(spark))
        assert sorted(r.ticker for r in Store(spark, str(tmp_path / "s")).require("momentum").collect()) == ["a", "b"] and store.rows("momentum") == 2
    store.append("momentum", rows(spark, "c"))
    assert sorted(r.ticker for r in store.require("momentum").collect()) == ["a", "b", "c"]
    store.save("momentum", store.require("momentum").where("ticker <> 'b'"))  # from the table it replaces
    assert sorted(r.ticker for r in store.require("momentum").collect()) == ["a", "c"]
    assert len([p for p in (tmp_path / "s" / "momentum").iterdir() if p.name.startswith("data-")]) == 1  # what failed is cleared away


def test_a_batch_counts_once_and_new_columns_are_null(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for _ in range(2):
        store.append("final", rows(spark, "a"), batch="one")
    store.append("final", rows(spark, "b").withColumn("more", F.lit(7)), batch="two")
    assert sorted((r.ticker, r.more) for r in store.require("final").collect()) == [("a", None), ("b", 7)]
    assert [p["batch"] for p in store.entry("final")["parts"]] == ["one", "two"] and all(p["files"] for p in store.entry("final")["parts"])


def test_optional_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.load("curves") is None and store.load_or_empty("curves", "date date, value double").dtypes == [("date", "date"), ("value", "double")]
    with pytest.raises(FileNotFoundError):
        store.require("curves")
    with pytest.raises(KeyError):
        store.exists("other")
    store.save("curves", rows(spark, "a").limit(0))
    assert store.load("curves") is None and store.exists("curves") and store.load_or_empty("curves", "x int").columns == ["ticker", "score"]
    assert store.newest(["final", "momentum"]) is None and store.rows("final") == 0


def test_lost_files_are_told(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("final", rows(spark, "a"))
    next((tmp_path / "final" / store.entry("final")["parts"][0]["folder"]).glob("part-*")).unlink()
    with pytest.raises(FileNotFoundError, match="lacks"):
        store.require("final")


def test_another_writer_is_noticed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("final", rows(spark, "a"))
    with pytest.raises(FileExistsError):
        store._commit("final", {}, 1)


def test_counts_are_taken_while_writing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("final", rows(spark, "a", "b", "c"), {"best": "max(score)"})
    store.append("final", rows(spark, "d"), {"best": "max(score)"})
    assert store.rows("final") == 4 and [m["best"] for m in store.metrics("final")] == [2.0, 0.0]
    assert cli.report(store, ["final", "curves"]).splitlines()[:2] == [f"{'final':20}{4:>10,}", f"{'curves':20}{0:>10,}"]


FUND = "ticker string, score double, fundamental_pass boolean"


def test_recovery_is_of_one_run(spark, tmp_path):
    """A run that stopped in its fundamentals is not mixed with what an earlier one left."""
    config, folder = ScreeningConfig(), str(tmp_path)
    old, new = Store(spark, folder, "old"), Store(spark, folder, "new")
    old.save("momentum", rows(spark, "a", "b"))
    old.save("fundamentals_partial", spark.createDataFrame([("a", 1.0, True)], FUND))
    old.save("fundamentals", spark.createDataFrame([("a", 1.0, True)], FUND))
    old.save("final", rows(spark, "a"))
    old.save("curves", rows(spark, "x"))
    assert [r.ticker for r in recovery.recover(new, config)["final"].collect()] == ["a"] and recovery.last_run(new) == "old"
    new.save("momentum", rows(spark, "c", "d"))
    new.save("fundamentals_partial", spark.createDataFrame([("c", 1.0, True), ("d", 2.0, False)], FUND))
    back = recovery.recover(old, config)
    assert [r.ticker for r in back["final"].collect()] == ["c"] and back["fundamentals"].count() == 2 and back["curves"] is None
    assert sorted(r.ticker for r in back["momentum"].collect()) == ["c", "d"]
    shown = rows(spark, "mine")
    assert recovery.current_or_saved_momentum(shown, old, config) is shown
    assert [r.ticker for r in recovery.current_or_saved_momentum(None, old, config).collect()] == ["d", "c"]


def test_newer_returns_beat_an_older_list(spark, tmp_path):
    config = ScreeningConfig(weights={5: 1.0}, gate=(5,))
    Store(spark, str(tmp_path), "old").save("momentum", rows(spark, "a"))
    Store(spark, str(tmp_path), "new").save("returns", spark.createDataFrame([("b", 3.0), ("c", -1.0)], "ticker string, ret_5 double"))
    found = Store(spark, str(tmp_path))
    assert [r.ticker for r in recovery.recover(found, config)["final"].collect()] == ["b"] and found.run_of("momentum") == "new"


def test_exact_decimals(spark):
    rng = random.Random(5)
    values = [0.125, 2.675, 1.005, 0.375, -0.125, -2.675, 0.005, 0.0, -0.0, -0.001, 9999.0, 1e9 + 0.125, 123456789.995, 2.0**40 + 0.5, 1e15, None]
    values += [rng.choice([1, -1]) * rng.randrange(10**6) / rng.choice([8, 1000, 64, 3]) for _ in range(3000)] + [10.0 ** rng.uniform(-8, 12) for _ in range(1000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[fixed_text(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 2, 3)]).collect()
    for v, r in zip(values, got):
        assert tuple(r) == ((None,) * 4 if v is None else tuple(f"{v:.{p}f}" for p in range(4)))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tests.test_sources import GOLDEN, provider

    (tmp_path / "t.csv").write_text("Ticker,Name\na,Alpha\ncc,Gamma\nzz,None\n")
    spark.createDataFrame([x for s in ("A.NS", "CC.NS", "^NSEI") for x in provider([s], "6y")], "ticker string, date date, close double").write.parquet(str(tmp_path / "px"))
    spark.createDataFrame([(s, "u", GOLDEN) for s in ("A", "CC")], "ticker string, page_url string, html string").write.parquet(str(tmp_path / "pages"))
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    base = ["--csv", str(tmp_path / "t.csv"), "--prices", str(tmp_path / "px"), "--quotes", str(tmp_path / "px"), "--backtest-months", "2"]
    cli.main([*base, "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "out"), "--parts", "2"])
    said = dict(line.split()[:2] for line in capsys.readouterr().out.splitlines() if line and not line.startswith("written"))
    assert said["momentum"] == "2" and said["final"] == "2" and said["performance"] == "2"
    assert (tmp_path / "out" / "final.csv").read_text().startswith("Ticker,Name,YFinance Ticker")
    cli.main([*base, "--out", str(tmp_path / "bare"), "--no-fundamentals", "--top", "1", "--final", "1"])
    said = dict(line.split()[:2] for line in capsys.readouterr().out.splitlines() if line and not line.startswith("written"))
    assert said["fundamentals"] == "0" and said["final"] == "1"


def test_progress_tells_observed_counts(spark, tmp_path):
    from tests.test_sources import fake_pages

    told, store = [], Store(spark, str(tmp_path))
    everyone = spark.createDataFrame([(x, "u") for x in ("A", "BBBB", "CC")], "ticker string, page_url string")
    screen.scan(everyone, fake_pages(spark), "fii", store, lambda *x: told.append(x), parts=2)
    assert told[-1] == (2, 2, "FII scan: 3 done, 2 rising")
    assert screen.saved_counts(store, "fii_partial") == {"n_tickers": 3, "n_rising": 2, "n_failed": 1, "max_change": 2.5}
