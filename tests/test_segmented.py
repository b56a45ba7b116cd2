"""Segmented scans, as-of and interval joins, and the last observations of a key, against plain loops."""

import random
import re
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom import registry
from rankloom.operators.asof import asof_both, asof_join
from rankloom.operators.interval import interval_join
from rankloom.operators.returns import DEALT, trailing_returns
from rankloom.operators.segmented import first_known, last_known, next_known, running_count, running_max, running_sum, segmented_scan


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


SCANS = {"last": last_known("v"), "next": next_known("v"), "base": first_known("v"), "top": running_max("v"), "total": running_sum("v"), "n": running_count("v")}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scans_equal_a_loop(spark, width):
    rng = random.Random(width)
    rows = [(k, at, rng.choice([None, None, float(rng.randrange(50))])) for k in ("a", None, "b") for at in range(40 if k == "a" else 9)]
    frame = spark.createDataFrame(rows, "k string, at int, v double").repartition(5)
    got = {(r.k, r.at): tuple(r)[3:] for r in segmented_scan(frame, ["k"], ["at"], F.floor(F.col("at") / width), SCANS).collect()}
    assert len(got) == len(rows)
    for k, at, _ in rows:
        before = [v for j, a, v in rows if j == k and a <= at and v is not None]
        after = [v for j, a, v in rows if j == k and a >= at and v is not None]
        assert got[k, at] == (before[-1] if before else None, after[0] if after else None, before[0] if before else None, max(before, default=None), sum(before) if before else None, len(before))


def test_no_task_has_more_than_a_chunk_in_order(spark):
    """90 % of the rows are of one key: its windows are by chunk, and only summaries are scanned by key."""
    frame = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", (F.col("id") % 7).alias("v"))
    made = segmented_scan(frame, ["k"], ["id"], F.floor(F.col("id") / 100), {"top": running_max("v")})
    lines = [line for line in plan_of(made).splitlines() if " Window " in line]
    assert len(lines) == 2 and sum("_chunk" in line.split("], [")[1] for line in lines) == 1  # partition keys
    assert made.where("k = 'hot' AND top = 6").count() == 4500 - 6  # all but the ids 0 to 5
    assert segmented_scan(frame.limit(0), ["k"], ["id"], F.col("id"), {"top": running_max("v")}).count() == 0


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_a_loop(spark, ahead, strict):
    rng = random.Random(3)
    day = lambda: rng.choice([None, *[date(2023, 12, 1) + timedelta(days=k) for k in range(60)]])
    left = [(i, rng.choice(["x", "y", None]), day(), "l") for i in range(60)]
    right = [(rng.choice(["x", "y", None, "z"]), day(), rng.randrange(5), "r") for _ in range(50)]
    found = asof_join(
        spark.createDataFrame(left, "i int, k string, d date, note string"), spark.createDataFrame(right, "k string, d date, v int, note string"), ["k"], "d", "d", ahead, strict, chunk=F.trunc("at", "month"), ties=["v"]
    )
    assert found.columns == ["i", "k", "d", "note", "d_right", "v"]
    got = {r.i: (r.d_right, r.v) for r in found.collect()}
    for i, k, d, _ in left:
        fits = lambda e: (e > d if strict else e >= d) if ahead else (e < d if strict else e <= d)
        met = sorted((e, v) for j, e, v, _ in right if j == k and e is not None and d is not None and fits(e))
        assert got[i] == ((met[0] if ahead else met[-1]) if met else (None, None))


def test_asof_has_no_pairs(spark):
    left = spark.range(100).select((F.col("id") % 3).alias("k"), F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("d"))
    text = plan_of(asof_join(left, left.withColumnRenamed("d", "e").withColumn("v", F.lit(1)), ["k"], "d", "e"))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("few", [False, True])
def test_asof_both_ways_equals_a_loop(spark, few):
    rng = random.Random(4)
    day = lambda: rng.choice([None, *[date(2023, 12, 1) + timedelta(days=k) for k in range(60)]])
    left = [(i, rng.choice(["x", "y", None, "w"]), day()) for i in range(90)]
    right = [(rng.choice(["x", "y", None, "z"]), day(), rng.randrange(5)) for _ in range(50)]
    found = asof_both(spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, e date, v int"), ["k"], "d", "e", {"e": "e2", "v": "v2"}, F.trunc("at", "month"), ["v"], few)
    assert found.columns == ["i", "k", "d", "e", "v", "e2", "v2"]
    got = {r.i: tuple(r)[3:] for r in found.collect()}
    assert len(got) == len(left)
    for i, k, d in left:
        met = sorted((e, v) for j, e, v in right if None not in (k, d, e) and j == k)
        assert got[i] == (*max((m for m in met if m[0] <= d), default=(None, None)), *min((m for m in met if m[0] > d), default=(None, None)))


def test_prices_of_a_nation_and_day_are_matched_once(spark, tmp_path):
    """Orders of one nation and day are one row of the scan, however many, and a null nation meets nothing, as in SQL."""
    at = lambda d: datetime(2024, 1, d)
    tables = {
        "customer": ([(1, 7), (2, None), (3, 8)], "c_custkey long, c_nationkey int"), "supplier": ([(1, 7), (2, None)], "s_suppkey long, s_nationkey int"),
        "orders": ([(k, 1 + k % 3, at(1 + k % 2)) for k in range(600)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(s, 2.0, 10.0 * d, at(d)) for s in (1, 2) for d in (1, 3)], "l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = registry.QUERIES["asof_nation_prices"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == set(db.execute(registry.ORACLES["asof_nation_prices"]).fetchall())
    text = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.search(r"Window .*o_orderkey|Sort .*o_orderkey|named_struct\(o_orderkey", text)


@pytest.mark.parametrize("width", [1, 5, 64])
def test_interval_join_equals_a_loop(spark, width):
    rng = random.Random(width)
    spans = [(i, rng.choice("ab"), a, a + rng.randrange(-1, 30)) for i in range(40) for a in [rng.randrange(-40, 40)]] + [(99, "a", None, 3)]
    points = [(p, rng.choice("ab"), rng.choice([None, *range(-50, 80)])) for p in range(60)]
    found = interval_join(spark.createDataFrame(spans, "i int, k string, lo int, hi int"), spark.createDataFrame(points, "p int, k string, at int"), "lo", "hi", "at", width, ["k"])
    assert sorted((r.i, r.p) for r in found.collect()) == sorted((i, p) for i, k, lo, hi in spans for p, j, at in points if None not in (lo, at) and j == k and lo <= at <= hi)
    assert "NestedLoop" not in plan_of(found)


def test_last_observations_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("H", date(2000, 1, 1) + timedelta(days=k), rng.choice([None, 1.0 + rng.random()])) for k in range(3000)] + [("E", date(2020, 1, 1), None)]
    known = [c for t, _, c in rows if t == "H" and c is not None]
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    found = trailing_returns(spark.createDataFrame(rows, "ticker string, date date, close double").repartition(6), (1, 700))
    got = {r.ticker: (r.data_points, r.cmp, r.ret_700) for r in found.collect()}
    assert got == {"H": (len(known), round(known[-1], 2), pytest.approx(round((known[-1] / known[-701] - 1) * 100, 2))), "E": (0, None, None)}
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before and DEALT > 1
    text = plan_of(trailing_returns(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("cast(l_suppkey as string) AS ticker", "to_date(l_shipdate) AS date", "l_tax AS close")))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2  # of rows, and of what each share keeps
