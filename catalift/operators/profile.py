"""Profile of an inventory, and previews of any frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalift.functions.names import quoted_parts
from catalift.functions.predicates import complexity


def inventory_profile(inventory: DataFrame) -> DataFrame:
    """Tables per type and format with their complexity, most frequent first.

    Counts are combined before the shuffle, so a group that holds most of the inventory
    still sends one row per input partition.
    """
    counted = inventory.groupBy("type", "format").agg(F.count("*").alias("count"))
    return complexity(counted).orderBy(F.col("count").desc(), "type", "format")


def sample_head(df: DataFrame, n: int, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first n rows: any n without an order, else the smallest by the given order."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def top_n(df: DataFrame, order_by: str, n: int = 1, ties: Sequence[str | Column] | None = None) -> DataFrame:
    """The n largest rows by one column; ties go by `ties`, by default all other columns that
    can be sorted, in their order, so that the same rows come out in every run."""
    if ties is None:
        ties = [
            F.col(quoted_parts(f.name))
            for f in df.schema
            if f.name != order_by and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))
        ]
    return df.orderBy(F.col(order_by).desc(), *ties).limit(n)
