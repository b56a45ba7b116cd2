"""Every registered screening query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rankloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.isoformat()[:10] if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_every_customer_in_order(spark, duck):
    got = [tuple(r) for r in registry.QUERIES["nulls_last_marketcap_all"](spark, SF).collect()]
    assert got == duck.execute(registry.ORACLES["nulls_last_marketcap_all"]).fetchall()
    assert len(got) == duck.execute("SELECT count(*) FROM customer").fetchone()[0] and got[-1][1] is None


def test_every_series_is_melted(spark):
    assert {r.series for r in registry.QUERIES["unpivot_curve_all"](spark, SF).select("series").distinct().collect()} == {f"N{k}" for k in range(25)}


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "ticker" and set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
