"""Scan, join, grouping, distinct and paging.

All of them only declare a plan. Catalyst prunes columns, pushes filters into the
Parquet scan, chooses broadcast or sort-merge joins by size, and aggregates
partially before each shuffle; adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expressions import first_of_group


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Inner, left, right or full join on a condition: its equalities become keys, the rest a residual."""
    return left.join(right, on, how)


def residual_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], residual: Column, how: str) -> DataFrame:
    """A join on equal key columns and a further condition that decides about matches, not about rows."""
    condition = residual
    for a, b in keys:
        condition = condition & (left[a] == right[b])
    return left.join(right, condition, how)


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``left`` without a match; null keys match nothing."""
    return left.join(right, on, "left_anti")


def group(df: DataFrame, keys: Sequence[Column], *aggregates: Column) -> DataFrame:
    """Grouped (null keys are a group) or, without keys, global aggregation (one row, even of nothing)."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def distinct_ordered(df: DataFrame, columns: Sequence[str], key: Column, *first: Column) -> DataFrame:
    """Distinct ``columns`` sorted by a key that need not be among them: that of each one's first row."""
    return df.groupBy(*columns).agg(first_of_group(key, *first).alias("__key")).orderBy(F.col("__key").asc_nulls_first()).select(*columns)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``; with a sort below, only the head of each partition is shuffled."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
