"""Pages that name their next page: positions along the chain, by pointer doubling."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in spark.checkpoint.dir; only on a local master without that setting in a folder of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def chain(pages: DataFrame, starts: DataFrame, *, site: str = "site", url: str = "url", following: str = "next") -> DataFrame:
    """site, url, step of the landed pages that a site's first page reaches by its next links; step 0 is the first page.

    pages: site, url (unique in a site), next; starts: site, url. A chain ends at a page without a next link, at a link to a page that has not landed, and
    where it comes back to a page that it has (which keeps its first step). Each round knows twice as many steps, so a chain of n pages takes log2(n)
    rounds of two joins, whatever the number of sites.
    """
    landed = pages.select(F.col(site).alias("site"), F.col(url).alias("url"))
    links = pages.select(F.col(site).alias("site"), F.col(url).alias("url"), F.col(following).alias("to")).filter("to IS NOT NULL")
    jump = cut(links.join(landed.withColumnRenamed("url", "to"), ["site", "to"], "left_semi").select("site", "url", "to"))
    seen = cut(starts.select(F.col(site).alias("site"), F.col(url).alias("url")).join(landed, ["site", "url"], "left_semi").distinct().withColumn("step", F.lit(0).cast("long")))
    known, length = seen.count(), 1
    while True:
        reached = seen.join(jump, ["site", "url"]).select("site", F.col("to").alias("url"), (F.col("step") + length).alias("step"))
        seen = cut(seen.unionByName(reached).groupBy("site", "url").agg(F.min("step").alias("step")))
        before, known = known, seen.count()
        if known == before:
            return seen
        onward = jump.select("site", F.col("url").alias("to"), F.col("to").alias("end"))
        jump, length = cut(jump.join(onward, ["site", "to"]).select("site", "url", F.col("end").alias("to"))), 2 * length
