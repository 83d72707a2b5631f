"""Helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row tables with different columns into one row.

    The rows are stacked and aggregated, so no join is needed. A column takes
    the value of the part that has it.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, numbered in ``rank``.

    Spark keeps only ``k`` rows per group in each task before the shuffle, so a
    group holding much of the data stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def count_where(condition: Column) -> Column:
    """Number of rows meeting the condition, as BIGINT."""
    return F.count_if(condition).cast("bigint")
