"""Aggregates: counts with totals, canonical forms, exploded frequencies, cross-filters, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_with_total(df: DataFrame, key: str) -> DataFrame:
    """key, n, and a row of null key with the grand total, in one pass."""
    return df.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("is_total"))


def default_counts(df: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """Counts for every key of the dimension, 0 where there are none."""
    return dimension.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def canonical_form(df: DataFrame, key: Column, form: str, ordinal: str) -> DataFrame:
    """key, form, n: the most frequent spelling of each key; of equally frequent ones that seen first."""
    counted = df.groupBy(key.alias("key"), F.col(form).alias("form")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    best = W.partitionBy("key").orderBy(F.desc("n"), "first", "form")
    return counted.withColumn("k", F.row_number().over(best)).filter("k = 1").select("key", "form", "n")


def distinct_frequency(df: DataFrame, owner: str, item: Column, owners: DataFrame) -> DataFrame:
    """item, n owners that have it (once each), ratio to all owners."""
    total = owners.agg(F.count_distinct(owner).alias("total"))
    counts = df.select(owner, item.alias("item")).distinct().groupBy("item").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("item", "n", (F.col("n") / F.col("total")).alias("ratio"))


def solo_items(df: DataFrame, owner: str, item: str) -> DataFrame:
    """How many owners have the item and no other."""
    alone = df.groupBy(owner).agg(F.min(item).alias("item"), F.max(item).alias("other")).filter("item = other")
    return alone.groupBy("item").agg(F.count("*").alias("n"))


def cross_filter(df: DataFrame, filters: dict[str, Column], dimensions: list[str]) -> DataFrame:
    """dimension, value, n: every chart is filtered by all filters but its own, in one pass over the rows."""
    passes = [F.coalesce(f, F.lit(False)) for f in filters.values()]
    misses = sum((F.when(p, 0).otherwise(1) for p in passes), F.lit(0))
    own = {name: F.when(p, 0).otherwise(1) for name, p in zip(filters, passes, strict=True)}
    charts = F.array(*[F.when(misses - own.get(d, F.lit(0)) == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for d in dimensions])
    return df.select(F.explode(F.array_compact(charts)).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, owner: str, item: str, credits: DataFrame, least: int = 3) -> DataFrame:
    """owner, items, score: mean credit of the owner's items (repeats count, unknown ones are 0) times 100, half to even; null
    under least distinct items. credits has item, credit; a null credit leaves the item out."""
    joined = df.select(owner, item).join(credits.withColumn("__known", F.lit(True)), item, "left")
    used = joined.filter("__known IS NULL OR credit IS NOT NULL").withColumn("credit", F.coalesce("credit", F.lit(0.0)))
    out = used.groupBy(owner).agg(F.count_distinct(item).alias("items"), F.avg("credit").alias("mean"))
    return out.select(owner, "items", F.when(F.col("items") >= least, F.bround(F.col("mean") * 100).cast("int")).alias("score"))


def gap_list(df: DataFrame, owner: str, item: str, ordinal: list[str], credits: DataFrame) -> DataFrame:
    """owner, gaps: items of credit under 1 in order, once each, joined by commas."""
    first = df.groupBy(owner, item).agg(F.min(F.struct(*ordinal)).alias("at"))
    short = first.join(credits, item, "left").filter("coalesce(credit, 0) < 1")
    return short.groupBy(owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(item).alias("item")))), lambda x: x["item"]), ",").alias("gaps"))


def fingerprint(parts: list[tuple[DataFrame, Column]]) -> DataFrame:
    """One row: each table's aggregate as text, joined by |; null prints as None. Every aggregate is a row of its own table."""
    rows = None
    for i, (df, agg) in enumerate(parts):
        one = df.agg(F.coalesce(agg.cast("string"), F.lit("None")).alias(f"p{i}"))
        rows = one if rows is None else rows.join(F.broadcast(one))
    return rows.select(F.concat_ws("|", *rows.columns).alias("version"))


def list_quality(rows: DataFrame, page: str, *, is_link: Column, is_hit: Column, is_event: Column, to_parent: Column, is_external: Column, path_pattern: Column) -> DataFrame:
    """Row counts and ratios of a page's list rows; no rows give 0.0, and 1.0 for unique paths."""
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return rows.groupBy(page).agg(
        F.count("*").alias("list_rows"), share(is_link).alias("link_ratio"), share(is_hit).alias("title_ratio"), F.count_if(is_hit).alias("title_hits"),
        share(is_event).alias("event_ratio"), F.coalesce(F.count_distinct(path_pattern) / F.count("*"), F.lit(1.0)).alias("path_ratio"),
        share(to_parent).alias("parent_ratio"), share(is_external).alias("external_ratio"),
    )


def list_verdict(metrics: DataFrame) -> DataFrame:
    """The first threshold that a page misses, or ok."""
    reason = (
        F.when(F.col("list_rows") < 2, "list_rows").when(F.col("link_ratio") < 0.5, "link_ratio").when(F.col("title_ratio") < 0.10, "title_floor")
        .when((F.col("title_ratio") < 0.3) & (F.col("title_hits") < 2), "title_ratio").when(F.col("path_ratio") > 0.5, "path_ratio")
        .when(F.col("event_ratio") > 0.5, "event_ratio").when(F.col("parent_ratio") > 0.7, "parent_ratio").when(F.col("external_ratio") > 0.5, "external_ratio").otherwise("ok")
    )
    return metrics.withColumn("reason", reason)


def shares_of_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys with their share of the total and of the largest."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(k)
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return top.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("most")).alias("bar"), (F.col("n") / F.col("total")).alias("share"))
