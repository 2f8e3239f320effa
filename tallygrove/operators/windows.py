"""Latest and first rows, streaks, running totals, and greedy deduplication across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.operators.chains import cut


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__k = 1").drop("__k")


def keep_first(df: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """The row of smallest ordinal of each key."""
    return latest_per_key(df, key, [F.col(c).asc() for c in ordinal])


def cumulative(df: DataFrame, key: str, order: list[str], value: str, name: str = "running") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def failure_streak(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """key, streak: failures after the last success."""
    ranked = df.select(key, *order, failed.alias("__failed")).withColumn("__at", F.struct(*order))
    last = ranked.groupBy(key).agg(F.max(F.when(~F.col("__failed"), F.col("__at"))).alias("__last"))
    return ranked.join(last, key).groupBy(key).agg(F.count_if(F.col("__failed") & (F.col("__last").isNull() | (F.col("__at") > F.col("__last")))).alias("streak"))


def site_state(streaks: DataFrame, paused: int = 3, dead: int = 7) -> DataFrame:
    return streaks.withColumn("status", F.when(F.col("streak") >= dead, "dead").when(F.col("streak") >= paused, "paused").otherwise("active"))


def _links(keys: DataFrame, similar, parts) -> DataFrame:
    """a, b: the ids of like keys of one company, each with itself too, in both directions."""
    named = lambda x, *more: keys.select(F.col("key").alias(x), "company", F.col("title").alias(f"{x}_title"), *more)
    if parts is None:
        return named("a").join(named("b"), "company").filter(similar(F.col("a_title"), F.col("b_title"))).select("a", "b")
    of_all = named("b", F.explode(F.array_distinct(parts(F.col("title")))).alias("part"))
    counts = of_all.groupBy("company", "part").agg(F.count("*").alias("n"))
    rarest = of_all.join(counts, ["company", "part"]).groupBy(F.col("b").alias("a"), "company", F.col("b_title").alias("a_title")).agg(F.min(F.struct("n", "part"))["part"].alias("part"))
    met = rarest.join(of_all, ["company", "part"]).filter((F.col("a") != F.col("b")) & similar(F.col("a_title"), F.col("b_title"))).select("a", "b")
    itself = keys.filter(similar(F.col("title"), F.col("title"))).select(F.col("key").alias("a"), F.col("key").alias("b"))
    return met.union(met.select("b", "a")).union(itself)


def greedy_dedupe(df: DataFrame, *, id_col: str, company: str, title: str, priority: str, similar, priorities: list[int], parts=None) -> DataFrame:
    """id, dup_of: in the order of (priority, id) a row is a duplicate of the first primary of its company from another source with a like title.

    Duplicates never become primaries. Rows of a priority that is not listed, null too, come last, as one source. All rows of a company, title and source share one answer, so
    only distinct companies and titles are compared, with the first id of each source: once for their links, then in one round for each source, which hands its first primaries on.
    similar is symmetric. parts gives an array of a title's parts: of unequal similar titles one has every part of the other, and that one has some; titles then meet
    only by the part of theirs that is rarest in the company. Without parts all titles of a company meet.
    """
    ranks = [*sorted(priorities), max(priorities) + 1]
    rank = F.when(F.col(priority).isin(priorities), F.col(priority)).otherwise(F.lit(ranks[-1]))
    rows = df.select(F.col(id_col).alias("id"), F.col(company).alias("company"), F.col(title).alias("title"), rank.alias("priority"))
    firsts = [F.min(F.when(F.col("priority") == p, F.col("id"))).alias(f"first_{k}") for k, p in enumerate(ranks[:-1])]
    keys = cut(rows.dropna(subset=["company", "title"]).groupBy("company", "title").agg(*firsts).withColumn("key", F.monotonically_increasing_id()))
    links = cut(_links(keys, similar, parts))
    state = keys.withColumns({"dup_of": F.lit(None).cast(rows.schema["id"].dataType), "since": F.lit(None).cast(rows.schema["priority"].dataType)})
    for k, p in enumerate(ranks[:-1]):
        primary = state.filter(F.col("dup_of").isNull() & F.col(f"first_{k}").isNotNull()).select(F.col("key").alias("b"), f"first_{k}")
        met = links.join(primary, "b").groupBy(F.col("a").alias("key")).agg(F.min(f"first_{k}").alias("met"))
        since = F.when(F.col("dup_of").isNotNull(), F.col("since")).when(F.col("met").isNotNull(), F.lit(p))
        state = cut(state.join(met, "key", "left").withColumns({"since": since, "dup_of": F.coalesce("dup_of", "met")}).drop("met"))
    told = state.filter("dup_of IS NOT NULL").select("company", "title", "dup_of", "since")
    return rows.join(told, ["company", "title"], "left").select("id", F.when(F.col("since") < F.col("priority"), F.col("dup_of")).alias("dup_of"))


def recheck_average(df: DataFrame, first: str, second: str, low: int = 60, high: int = 85) -> Column:
    """The mean of both judgments, half to even, where the first lies between low and high and there is a second."""
    a, b = F.col(first), F.col(second)
    return F.when(a.between(low, high) & b.isNotNull(), F.bround((a + b) / 2).cast("int")).otherwise(a)
