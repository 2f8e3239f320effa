"""Streams of landed runs and postings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed(spark: SparkSession, folder: str, schema: T.StructType | str, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, *, time: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each key and window; rows later than late are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, *, time: str, key: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def failure_streaks(runs: DataFrame, *, key: str, ordinal: str, failed: str) -> DataFrame:
    """key, streak, status after each trigger: failures on end, kept as state."""

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("ordinal")
        for bad in rows["failed"]:
            streak = streak + 1 if bad else 0
        state.update((streak,))
        yield pd.DataFrame({"key": [name[0]], "streak": [streak], "status": ["dead" if streak >= 7 else "paused" if streak >= 3 else "active"]})

    rows = runs.select(F.col(key).cast("string").alias("key"), F.col(ordinal).alias("ordinal"), F.col(failed).alias("failed"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, streak int, status string", "streak int", "update", GroupStateTimeout.NoTimeout)
