"""Menus of a site: link scores, site names, page parameters, and deduplication of list pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import urls
from tallygrove.functions.text import col
from tallygrove.operators.paging import PAGE_PARAMS

# Words that lead to job pages.
KEYWORDS = [
    "채용", "공고", "모집", "입사", "지원", "인재", "커리어", "채용공고", "리크루팅", "리쿠르팅", "인재영입", "구인", "구직", "구인구직", "잡", "취업", "일자리", "채용정보",
    "career", "careers", "recruit", "recruiting", "recruitment", "job", "jobs", "hiring", "employment", "vacancy", "vacancies", "join-us", "joinus", "work-with-us", "apply",
    "position", "positions", "opening", "openings", "opportunity", "opportunities",
]
SEPARATORS = r"\s*\|\s*|\s+[-–]{1,2}\s+|\s+::\s+|\s*,\s*"


def link_score(text: str, url: str, keywords: list[str] = KEYWORDS) -> Column:
    """2 for each keyword in the text, else 1 for one in the URL; 3 more if the path ends in a keyword."""
    t, u = F.lower(F.coalesce(col(text), F.lit(""))), F.lower(col(url))
    blob = F.concat(t, F.lit(" "), u)
    words = F.array(*map(F.lit, keywords))
    hits = F.aggregate(words, F.lit(0), lambda a, k: a + F.when(F.contains(t, k), 2).when(F.contains(blob, k), 1).otherwise(0))
    last = F.coalesce(F.try_element_at(urls.segments(u), F.lit(-1)), F.lit(""))
    return hits + F.when(last.isin(keywords), 3).otherwise(0)


def best_links(links: DataFrame, url: str, score: str, ordinal: str, floor: int = 2, limit: int = 300) -> DataFrame:
    """The best-scored mention of each URL (the first of equals) from floor on, best first, at most limit of them."""
    best = links.filter(F.col(score) >= floor).withColumn("__k", F.row_number().over(W.partitionBy(url).orderBy(F.desc(score), ordinal)))
    return best.filter("__k = 1").drop("__k").orderBy(F.desc(score), ordinal).limit(limit)


def best_segment(title) -> Column:
    """The shortest part of a title of two characters or more, the first of equals, cut to 80."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(col(title), r"\s+", " "), SEPARATORS), lambda p: F.trim(p)), lambda p: F.length(p) >= 2)
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p"))))
    return F.substring(F.try_element_at(ranked, F.lit(1))["p"], 1, 80)


def page_parameter(anchors: DataFrame, page: str, href: str) -> DataFrame:
    """page, param: the page parameter that most of a page's links use with a number; of equals the first of the list."""
    rows = anchors.select(page, F.explode(urls.params(href)).alias("q")).filter(F.col("q.name").isin(PAGE_PARAMS) & F.regexp_like("q.value", F.lit(r"^\d+$")))
    counts = rows.groupBy(page, F.col("q.name").alias("param")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, PAGE_PARAMS)), F.col("param"))
    ranked = counts.withColumn("__k", F.row_number().over(W.partitionBy(page).orderBy(F.desc("n"), place)))
    return ranked.filter("__k = 1").select(page, "param")


def dedupe_menus(menus: DataFrame, overlap: float = 0.7) -> DataFrame:
    """site, url, covered_by: list pages in the order of fewest parameters, most rows, most links; one goes if it is a kept page with more
    parameters, or overlap of its ids are on a kept page.

    Each decision rests on those before it, so a site's pages (some hundreds at most, best_links() sees to that) are taken together.
    menus: site, url, list_rows, link_ratio, ids.
    """
    keyed = menus.select("site", "url", "list_rows", "link_ratio", "ids", F.concat(urls.host("url"), urls.path("url")).alias("place"), F.sort_array(F.filter(F.split(urls.query("url"), "&"), lambda p: p != "")).alias("params"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out = []
        order = frame.assign(n=frame["params"].map(len)).sort_values(["n", "list_rows", "link_ratio", "url"], ascending=[True, False, False, True])
        for r in order.itertuples():
            own, ids = set(r.params), set(r.ids)
            narrower = next((k.url for k, p, _ in kept if k.place == r.place and p < own), None)
            covered = next((k.url for k, _, s in kept if ids and s and len(ids & s) / len(ids) >= overlap), None)
            by = narrower or covered
            if by is None:
                kept.append((r, own, ids))
            out.append((r.site, r.url, by))
        return pd.DataFrame(out, columns=["site", "url", "covered_by"])

    return keyed.groupBy("site").applyInPandas(run, "site string, url string, covered_by string")
