"""Rows for a model in batches, and its answers: batch numbers, schema checks, and label sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators.windows import latest_per_key


def batch_ids(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """batch_id: rows of a group in runs of size."""
    from pyspark.sql import Window as W

    return df.withColumn("batch_id", F.floor((F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1) / size))


def map_batches(df: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, size: int) -> DataFrame:
    """What a pluggable function answers to size rows at a time of a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), size):
                yield answer(frame.iloc[i : i + size])

    return df.mapInPandas(run, schema)


def parsed(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Answers as structs; malformed ones are null."""
    return df.withColumn(column, F.from_json(column, schema))


def valid_label(column: str, allowed: list[str], other: str = "unknown"):
    return F.when(F.col(column).isin(allowed), F.col(column)).otherwise(other)


def to_reclassify(labels: DataFrame, current_hash: str) -> DataFrame:
    """Labels that are not pinned and have no verdict, or one of another profile."""
    return labels.filter(~F.coalesce("pinned", F.lit(False)) & (F.col("verdict").isNull() | ~F.col("skills_hash").eqNullSafe(F.lit(current_hash))))


def direct_verdicts(labels: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Verdicts that the profile itself gives: has before partial."""
    best = latest_per_key(profile, [key], [F.when(F.col("verdict") == "has", 0).otherwise(1).asc()])
    return labels.join(best.select(key, F.col("verdict").alias("direct")), key, "left")
