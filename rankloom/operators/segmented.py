"""Running values within a key, for keys that may hold most of all rows.

A window by key puts a key's rows in one task. Here the key's rows are cut by a chunk of its order (a year, an hour, a
block of numbers: any expression that never falls along the order). Each chunk gives one row of a summary, and the
summaries are scanned by key. What is carried into a chunk joins its rows as one row more, before or after all others,
so that a window inside the chunk gives the running value of the key. No task holds more than the rows of one (key,
chunk) in order, and the scan by key meets one row a chunk.

There is no join. Summaries are made inside tasks before their shuffle; the rows are shuffled once, by key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """A running value: ``running`` of a column over rows in order. It must be the same if rows that were met before (or
    that come after, with ``ahead``) are put in one row with what ``summary`` and then ``running`` make of them.

    ``summary`` is given the column and the order as one value; ``value`` is what of a column counts.
    """

    column: str
    running: Callable[[Column], Column]
    summary: Callable[[Column, Column], Column]
    ahead: bool = False
    value: Callable[[Column], Column] = lambda c: c


def _first(c: Column) -> Column:
    return F.first(c, ignorenulls=True)


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def _known(value: Column, order: Column) -> Column:
    return F.when(value.isNotNull(), order)


def last_known(column: str) -> Scan:
    """The last value that isn't null, up to the row."""
    return Scan(column, _last, lambda c, o: F.max_by(c, _known(c, o)))


def next_known(column: str) -> Scan:
    """The first value that isn't null, from the row on."""
    return Scan(column, _first, lambda c, o: F.min_by(c, _known(c, o)), ahead=True)


def first_known(column: str) -> Scan:
    """The key's first value that isn't null, null before it."""
    return Scan(column, _first, lambda c, o: F.min_by(c, _known(c, o)))


def running_max(column: str) -> Scan:
    return Scan(column, F.max, lambda c, o: F.max(c))


def running_sum(column: str) -> Scan:
    """The sum up to the row; null while all values are."""
    return Scan(column, F.sum, lambda c, o: F.sum(c))


def running_count(column: str) -> Scan:
    """How many values up to the row aren't null."""
    return Scan(column, F.sum, lambda c, o: F.sum(c), value=lambda c: c.isNotNull().cast("long"))


def segmented_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, scans: Mapping[str, Scan]) -> DataFrame:
    """``rows`` with a column for each of ``scans``. ``order`` tells the rows of a key apart; ``chunk`` never falls along it.

    A null key is a key; rows whose chunk is null stand before all others, as nulls do in the order.
    """
    cut = rows.withColumns({"_chunk": chunk, **{f"_v_{name}": s.value(F.col(s.column)) for name, s in scans.items()}})
    if not keys:
        cut, keys = cut.withColumn("_one", F.lit(1)), ["_one"]
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summed = cut.groupBy(*keys, "_chunk").agg(*[s.summary(F.col(f"_v_{name}"), at).alias(f"_v_{name}") for name, s in scans.items()])
    chunks = Window.partitionBy(*keys).orderBy("_chunk")  # one row a chunk
    others = {False: chunks.rowsBetween(Window.unboundedPreceding, -1), True: chunks.rowsBetween(1, Window.unboundedFollowing)}
    met = cut.withColumn("_edge", F.lit(0))
    for ahead in {s.ahead for s in scans.values()}:
        carried = [s.running(F.col(f"_v_{name}")).over(others[ahead]).alias(f"_v_{name}") for name, s in scans.items() if s.ahead == ahead]
        met = met.unionByName(summed.select(*keys, "_chunk", F.lit(1 if ahead else -1).alias("_edge"), *carried), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_edge", *order)
    frames = {False: inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), True: inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)}
    made = [s.running(F.col(f"_v_{name}")).over(frames[s.ahead]).alias(name) for name, s in scans.items()]
    return met.select("_edge", *[F.col(c) for c in rows.columns if c not in scans], *made).where("_edge = 0").drop("_edge")
