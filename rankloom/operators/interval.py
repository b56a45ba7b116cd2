"""Points in spans, by bins: an equality join that any engine hashes or sorts, with an exact test after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(spans: DataFrame, points: DataFrame, start: str, end: str, at: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of a span (whole numbers ``start`` to ``end``, inclusive) and a point ``at`` inside it, with the columns
    of both; ``keys`` must be equal too.

    A span is put in each bin of ``width`` that it covers and a point in its one bin, so a pair meets just once. Choose
    a width of some typical spans: a span makes (end - start) / width + 1 rows. Spans or points with nulls, and spans
    that end before they start, meet nothing. Columns of the points that clash with those of the spans must be keys.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    binned = spans.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    dealt = points.withColumn("_bin", bin_of(at))
    return binned.join(dealt, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")
