"""How a list page numbers its pages: by a query parameter, or by a part of the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import urls
from tallygrove.functions.text import col

# Names of page parameters, the first of equals wins.
PAGE_PARAMS = ["pageIndex", "currentPage", "page", "pageNum", "pageNo", "pagenumber", "page_no", "page_num", "pageno", "pagenum", "cpage", "startPage", "p", "p_page"]


def existing_parameter(url) -> Column:
    """The first of PAGE_PARAMS that the URL has, with or without a value."""
    names = F.transform(F.filter(F.split(urls.query(url), "&"), lambda p: F.contains(p, F.lit("="))), lambda p: F.substring_index(p, "=", 1))
    return F.try_element_at(F.filter(F.array(*map(F.lit, PAGE_PARAMS)), lambda n: F.array_contains(names, n)), F.lit(1))


def linked_parameter(anchors: DataFrame) -> DataFrame:
    """page, param, links: the page parameter that most links of a page to its own path have with a number; of equals the one that is linked first.

    anchors: page, base (the page's URL), pos, href.
    """
    rows = anchors.withColumn("url", urls.absolute("base", "href")).filter(urls.path("url") == urls.path("base"))
    named = rows.withColumn("all", urls.params("url")).select("page", "pos", "all", F.explode(F.array_distinct(F.transform("all", lambda p: p["name"]))).alias("param"))
    last = F.try_element_at(F.filter("all", lambda p: p["name"] == F.col("param")), F.lit(-1))["value"]
    numbered = named.filter(F.col("param").isin(PAGE_PARAMS) & F.regexp_like(last, F.lit("^[0-9]+$")))
    counts = numbered.groupBy("page", "param").agg(F.count("*").alias("links"), F.min("pos").alias("first"))
    rank = F.array_position(F.array(*map(F.lit, PAGE_PARAMS)), F.col("param"))
    return counts.groupBy("page").agg(F.min_by(F.struct("param", "links"), F.struct((-F.col("links")).alias("n"), "first", rank.alias("rank"))).alias("b")).select("page", "b.*")


def path_template(anchors: DataFrame) -> DataFrame:
    """page, template, first, step, n: the URL of numbered pages with {N} for the number, learned from links whose text is a number of 1 to 999.

    anchors: page, base, pos, href, text. Links to other hosts are left out. The first numbered link is held against each later one of another number: their
    paths must differ in one part alone, and the first digits in it must be the numbers. The earliest link that fits gives the template. first:
    the number of the first link; step: the least difference between the numbers of links that the template gives; n: how many numbers there are. A
    page's first link is found by a grouped minimum and joined to its links; no pairs of links are made.
    """
    numbered = anchors.filter(F.regexp_like(F.trim("text"), F.lit(r"^[0-9]{1,4}$"))).select("page", "pos", F.trim("text").try_cast("int").alias("number"), urls.absolute("base", "href").alias("url"), "base")
    own = numbered.filter(F.col("number").between(1, 999) & (urls.host("url") == urls.host("base"))).withColumn("parts", F.split(urls.path("url"), "/"))
    first = own.groupBy("page").agg(F.min(F.struct("pos", "number", "url", "parts")).alias("a"))
    both = own.join(first, "page").withColumn("differ", F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("parts", i) != F.coalesce(F.get("a.parts", i), F.lit("/"))))
    digits = lambda parts: F.regexp_extract(F.get(parts, F.get("differ", F.lit(0))), "[0-9]+", 0)
    fits = (F.col("number") != F.col("a.number")) & (F.size("parts") == F.size("a.parts")) & (F.size("differ") == 1)
    fits = fits & (F.length(digits("parts")) < 10) & (F.try_to_number(digits("parts"), F.lit("999999999")) == F.col("number")) & (F.length(digits("a.parts")) < 10) & (F.try_to_number(digits("a.parts"), F.lit("999999999")) == F.col("a.number"))
    place = F.get("differ", F.lit(0))
    whole = F.array_join(F.transform("a.parts", lambda s, i: F.when(i == place, F.regexp_replace(s, "^([^0-9]*)[0-9]+", "$1{N}")).otherwise(s)), "/")
    template = F.concat(F.regexp_extract("a.url", r"^[A-Za-z][\w+.\-]*://[^/?#]*", 0), whole, F.regexp_extract("a.url", "[?#].*$", 0))
    found = both.filter(fits).select("page", "pos", "number", F.col("a.number").alias("first"), template.alias("template"))
    taken = found.groupBy("page").agg(F.min_by(F.struct("template", "first"), "pos").alias("t")).select("page", "t.*")
    same = found.join(taken, ["page", "template", "first"]).select("page", "template", "first", "number").unionByName(taken.select("page", "template", "first", F.col("first").alias("number"))).distinct()
    stepped = same.withColumn("gap", F.col("number") - F.lag("number").over(W.partitionBy("page").orderBy("number")))
    return stepped.groupBy("page", "template", "first").agg(F.min("gap").alias("step"), F.count("*").alias("n")).select("page", "template", "first", "step", "n")


def page_url(template, number) -> Column:
    """The URL of a page of this number."""
    return F.replace(col(template), F.lit("{N}"), col(number).cast("string"))
