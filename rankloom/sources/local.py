"""Small tables made on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """``rows`` as a table that is part of the plan: no job is run to read it, and the optimiser knows its size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [[] for _ in arrow]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow), StructType.fromDDL(schema))
