"""The ticker file: a CSV with a header and a Ticker column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.universe import PAGE_TEMPLATE, normalize_universe


def read_universe(spark: SparkSession, path: str, template: tuple[str, str] = PAGE_TEMPLATE) -> DataFrame:
    """The normalised universe. Headers are matched exactly, then in lower case with underscores: ``Ticker`` is ticker.

    Raises FileNotFoundError without the file and ValueError without the column. All columns are read as text. The first
    of equal tickers is the first by file position.
    """
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no file of securities at {path}") from error
        raise
    if "Ticker" not in raw.columns:
        raise ValueError(f"{path} has no column named Ticker among {raw.columns}")
    names = [c.strip().lower().replace(" ", "_").replace(".", "") for c in raw.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash: {raw.columns}")
    rows = raw.toDF(*names).withColumn("_place", F.monotonically_increasing_id())
    return normalize_universe(rows, F.col("_place"), template).drop("_place")
