"""Which of a row's links leads to its subject: the one whose kind of address differs from row to row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import urls


def subjects(anchors: DataFrame, *, prefix: str | None = None, shortest: int = 2) -> DataFrame:
    """page, block, row, url, title (200 characters), score of each row's subject; rows without a link that can be resolved are left out.

    anchors: page, block, row, pos, base, href, text. Every kind of address (anchor_fingerprint) has a score in its block: different URLs by rows that have
    it, so a company's pop-up that many rows share scores below a posting's own address. The best kind in a row wins, then the longer text, then
    the first. With prefix the first link that begins with it is taken, and rows without one have a null url. Texts under shortest characters do not count. Kinds are counted by
    partial aggregates and joined back by block and kind; no row's links are gathered.
    """
    links = anchors.withColumns({"url": urls.resolve("base", "href"), "kind": urls.anchor_fingerprint("href")}).filter(F.col("url").isNotNull() & (F.length("text") >= shortest))
    keys, title = ["page", "block", "row"], F.substring("text", 1, 200)
    if prefix is not None:
        fits = F.startswith("url", F.lit(prefix))
        first = F.min(F.when(fits, F.struct("pos", "url", title.alias("title"))))
        return links.groupBy(*keys).agg(first.alias("s")).select(*keys, "s.url", "s.title", F.lit(None).cast("double").alias("score"))
    by = ["page", "block", "kind"]
    distinct = links.groupBy(*by).agg(F.count_distinct("url").alias("n_urls"), F.count_distinct("row").alias("n_rows"))
    scored = links.join(distinct.select(*by, (F.col("n_urls") / F.col("n_rows")).alias("score")), by)
    best = F.min_by(F.struct("url", title.alias("title"), "score"), F.struct((-F.col("score")).alias("s"), (-F.length("text")).alias("l"), "pos"))
    return scored.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")
