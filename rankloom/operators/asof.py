"""As-of matches: by key over tables of any size, and of dates against a trading calendar.

Both sides are put into one table, and each left row takes the last right row before it (or the next one after it) by
a segmented scan. No pairs are made, there is no join on inequality, and a key with most of all rows is spread over
its chunks of time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.segmented import last_known, next_known, segmented_scan


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, ahead: bool = False, strict: bool = False, chunk: Column | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Each left row with the columns of the last right row of its keys at or before it; null where there is none.

    ``ahead`` takes the first one at or after it instead, ``strict`` leaves out the same moment. Of right rows of one
    moment the last by ``ties`` counts (the first, ahead). ``chunk`` is an expression over the column ``at``, by year
    unless given. Null keys meet each other; a left row without a time meets nothing, and right rows without one are
    left out. Right columns that clash with left ones are not taken, but for the time.
    """
    taken = [c for c in right.columns if c not in keys and (c == right_at or c not in left.columns)]
    named = {right_at: right_at if right_at not in left.columns else f"{right_at}_right"}
    left_first = strict != ahead
    first, second = (F.lit(0), F.lit(1)) if left_first else (F.lit(1), F.lit(0))
    keys_of = [F.col(k).alias(f"_key_{k}") for k in keys]
    lefts = left.select(*keys_of, F.col(left_at).alias("at"), first.alias("_side"), F.struct(*left.columns).alias("_left"))
    found = F.struct(*[F.col(c).alias(named.get(c, c)) for c in taken])
    rights = right.where(F.col(right_at).isNotNull()).select(*keys_of, F.col(right_at).alias("at"), second.alias("_side"), found.alias("_right"), *[F.col(t).alias(f"_tie_{t}") for t in ties])
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = ["at", "_side", *[f"_tie_{t}" for t in ties]]
    scan = (next_known if ahead else last_known)("_right")
    by_key = [f"_key_{k}" for k in keys]
    met = segmented_scan(both, by_key, order, F.year("at") if chunk is None else chunk, {"_met": scan}).where("_left IS NOT NULL")
    met = met.withColumn("_met", F.when(F.col("at").isNotNull(), F.col("_met")))
    return met.select("_left.*", *[F.col(f"_met.`{named.get(c, c)}`") for c in taken])


def asof_both(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, after: Mapping[str, str], chunk: Column | None = None, ties: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Each left row with the columns of the last right row of its keys at or before it, and of the first one after it
    (named by ``after``, for each column of ``right`` but the keys); null where there is none.

    For left rows that share their moments, as orders share days: every moment of a key is matched once, both ways by
    one scan, and left rows fetch what it met by a join on equality. No left row is sorted. ``few`` tells that the
    moments are few however many rows there are, so that they are broadcast. ``chunk`` and ``ties`` are those of
    ``asof_join``. As in SQL, null keys and left rows without a time meet nothing.
    """
    taken = [c for c in right.columns if c not in keys]
    by_key = [f"_key_{k}" for k in keys]
    keys_of = [F.col(k).alias(named) for k, named in zip(keys, by_key, strict=True)]
    moments = left.select(*keys_of, F.col(left_at).alias("at")).dropna().distinct().withColumn("_side", F.lit(1))
    rights = right.dropna(subset=[*keys, right_at]).select(*keys_of, F.col(right_at).alias("at"), F.lit(0).alias("_side"), F.struct(*taken).alias("_right"), *[F.col(t).alias(f"_tie_{t}") for t in ties])
    scans = {"_before": last_known("_right"), "_after": next_known("_right")}
    met = segmented_scan(moments.unionByName(rights, allowMissingColumns=True), by_key, ["at", "_side", *[f"_tie_{t}" for t in ties]], F.year("at") if chunk is None else chunk, scans).where("_side = 1")
    met = met.select(*[F.col(named).alias(k) for k, named in zip(keys, by_key, strict=True)], F.col("at").alias(left_at), "_before", "_after")
    found = left.join(F.broadcast(met) if few else met, [*keys, left_at], "left")
    return found.select(*left.columns, *[F.col(f"_before.`{c}`") for c in taken], *[F.col(f"_after.`{c}`").alias(after[c]) for c in taken])


def first_on_or_after(anchors: DataFrame, calendar: DataFrame, anchor: str = "anchor", name: str = "entry") -> DataFrame:
    """``anchors`` with the first calendar date on or after each; null where there is none."""
    return asof_join(anchors, calendar.select(F.col("date").alias(name)), [], anchor, name, ahead=True)


def last_before(rows: DataFrame, calendar: DataFrame, column: str = "entry", name: str = "signal") -> DataFrame:
    """``rows`` with the last calendar date strictly before each; null where there is none."""
    return asof_join(rows, calendar.select(F.col("date").alias(name)), [], column, name, strict=True)
