"""Sorting, limits and page slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def limit_or_all(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; all of them if n is negative."""
    return df if n < 0 else df.limit(n)


def rank_of(column: str, order: list[str], other: int = 9) -> Column:
    """The place of a value in a list, other for values that it lacks."""
    out = F.when(F.lit(False), other)
    for i, value in enumerate(order):
        out = out.when(F.col(column) == value, i)
    return out.otherwise(other)


def top_n(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return limit_or_all(df.orderBy(F.desc_nulls_last(score), F.desc_nulls_last(tie)), n)


def page_slice(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Page number (from 0) of size rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their place."""
    ranked = df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("place") <= k)


def first_and_more(df: DataFrame, group: str, order: list[Column], name: str, k: int) -> DataFrame:
    """group, shown (its first k names, joined by commas) and more (how many rows it has beyond them)."""
    counts = df.groupBy(group).agg(F.count("*").alias("all"))
    shown = top_k_per_group(df, group, order, k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", name))), lambda x: x[name]), ",").alias("shown"))
    return counts.join(shown, group).select(group, "shown", F.greatest(F.lit(0), F.col("all") - k).alias("more"))
