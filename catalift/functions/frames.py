"""Rows that the driver gathers, and plans that are evaluated once, as frames in the scratch folder."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

from catalift.functions.names import quoted_parts, scratch_dir

# Rows that travel inside a plan; more are appended to the shared scratch folder piece by piece.
ROWS_IN_PLAN = 50_000


def frame_of(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A frame of rows as they come: the driver holds one piece of them at a time."""
    rows = iter(rows)
    chunk = list(islice(rows, ROWS_IN_PLAN))
    first = spark.createDataFrame(chunk, schema)
    if len(chunk) < ROWS_IN_PLAN:
        return first
    path = scratch_dir(spark)
    while chunk:
        spark.createDataFrame(chunk, schema).write.mode("append").parquet(path)
        chunk = list(islice(rows, ROWS_IN_PLAN))
    return spark.read.schema(first.schema).parquet(path)


def stored(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows of a frame, written to the scratch folder and read from there: its plan is
    evaluated here, once, and what is read later survives lost executors. Columns to partition
    by come last. Columns without a type are not written; they hold nothing but NULL."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    empty = {f.name for f in df.schema if isinstance(f.dataType, NullType)}
    kept = [f for f in df.schema if f.name not in empty]
    written = df.select(*(F.col(quoted_parts(f.name)) for f in kept)) if empty else df
    written.write.partitionBy(*partition_by).parquet(path)
    files = spark.read.schema(StructType(kept)).parquet(path)
    if not empty:
        return files
    return files.select(
        *(F.lit(None).alias(f.name) if f.name in empty else F.col(quoted_parts(f.name)) for f in df.schema)
    )
