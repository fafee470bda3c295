"""Small tables written in code or configuration, and the size check that goes with broadcasting them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def literal_table(spark: SparkSession, schema: pa.Schema, rows: Sequence[tuple]) -> DataFrame:
    """DataFrame of driver-side rows; marked for broadcast only while its known length allows it."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
    df = spark.createDataFrame(table)
    return F.broadcast(df) if len(rows) <= MAX_BROADCAST_ROWS else df
