"""Where an incremental crawl stops, as window functions over landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page_facts(rows: DataFrame, known: DataFrame, *, source: str, page: str, key: str) -> DataFrame:
    """source, page, ids, fresh (not in known), unseen (not on an earlier page of the source)."""
    ids = rows.select(source, page, key).distinct()
    first = ids.groupBy(source, key).agg(F.min(page).alias("__first"))
    marked = ids.join(first, [source, key]).join(known.select(source, key).distinct().withColumn("__known", F.lit(True)), [source, key], "left")
    return marked.groupBy(source, page).agg(F.count("*").alias("ids"), F.count_if(F.col("__known").isNull()).alias("fresh"), F.count_if(F.col(page) == F.col("__first")).alias("unseen"))


def stop_page(facts: DataFrame, known: DataFrame, *, source: str, page: str, streak: int = 2) -> DataFrame:
    """source, last_page that is read.

    Page 1 stops the crawl if something is known and it shows nothing fresh. A later page stops it beforehand if all its ids were seen on earlier pages,
    and afterwards if it is the streak-th page on end, from the second on, without fresh ids.
    """
    order = W.partitionBy(source).orderBy(page)
    any_known = known.groupBy(source).agg(F.lit(True).alias("__any"))
    rows = facts.join(any_known, source, "left").withColumn("__n", F.row_number().over(order))
    barren = (F.col("fresh") == 0) & (F.col("__n") > 1)
    rows = rows.withColumn("__island", F.sum(F.when(barren, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__streak", F.sum(F.when(barren, 1).otherwise(0)).over(W.partitionBy(source, "__island").orderBy(page).rowsBetween(W.unboundedPreceding, 0)))
    before = F.when((F.col("__n") > 1) & (F.col("unseen") == 0), F.col("__n") - 1)
    after = F.when((F.col("__n") == 1) & F.coalesce("__any", F.lit(False)) & (F.col("fresh") == 0), F.lit(1)).when(F.col("__streak") >= streak, F.col("__n"))
    return rows.groupBy(source).agg(F.least(F.coalesce(F.min(F.least(before, after)), F.max("__n")), F.max("__n")).cast("int").alias("last_page"))


def stop_after_barren(facts: DataFrame, *, source: str, page: str, short: int) -> DataFrame:
    """source, last_page: reading ends after the first page without unseen ids, or with fewer than short ids."""
    order = W.partitionBy(source).orderBy(page)
    rows = facts.withColumn("__n", F.row_number().over(order))
    end = F.when((F.col("unseen") == 0) | (F.col("ids") < short), F.col("__n"))
    return rows.groupBy(source).agg(F.coalesce(F.min(end), F.max("__n")).cast("int").alias("last_page"))
