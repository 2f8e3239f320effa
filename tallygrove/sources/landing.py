"""Landed files as tables: JSON list pages, fetched pages, URL lists, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions import embedded, postings, urls

PAGE = "url string, status int, text string, final_url string, error string"


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Parquet tables of a folder."""
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over the session's shuffle partitions: for work that is far heavier than a row's bytes show, which few files would leave to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def json_items(spark: SparkSession, path: str, schema: T.StructType | str, items: str) -> DataFrame:
    """One row for each element of a list inside every landed JSON page."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(F.col(items)))


def fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages with ok: no error and a status of 200 to 399."""
    rows = spark.read.schema(PAGE).json(path)
    return rows.withColumn("ok", F.col("error").isNull() & F.col("status").between(200, 399))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file without blank lines and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def sitemap_urls(xml: str | Column) -> Column:
    """Locations in a sitemap, in order."""
    return F.regexp_extract_all(F.col(xml) if isinstance(xml, str) else xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def site_urls(robots: DataFrame, files: DataFrame, *, roots: int = 3, depth: int = 2, most: int = 50) -> DataFrame:
    """site, url of list pages in sitemaps, one for each URL pattern in the order the sitemaps name them, the first most of a site.

    robots: site, base, text (null if there is none); files: url, text of landed sitemaps. Sitemaps that a sitemap names are followed to the given depth.
    Single posts and paths with escapes are left out. Each level is one join with files; a file that has not landed names nothing.
    """
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), F.lit(1))
    start = F.when(F.size(named) > 0, F.slice(named, 1, roots)).otherwise(F.array(F.concat("base", F.lit("/sitemap.xml"))))
    level = robots.select("site", F.posexplode(start).alias("pos", "url")).select("site", F.array("pos").alias("place"), "url")
    landed, pages = files.select("url", sitemap_urls("text").alias("found")), None
    for _ in range(depth + 1):
        inner = level.join(landed, "url").select("site", "place", F.posexplode("found").alias("pos", "url")).select("site", F.concat("place", F.array("pos")).alias("place"), "url")
        nested = F.endswith("url", F.lit(".xml")) & F.contains(F.lower("url"), F.lit("sitemap"))
        here, level = inner.filter(~nested), inner.filter(nested)
        pages = here if pages is None else pages.unionByName(here)
    lists = pages.filter(~postings.is_detail_url("url") & ~F.contains(urls.path("url"), F.lit("%")))
    first = lists.groupBy("site", urls.url_pattern("url").alias("pattern")).agg(F.min(F.struct("place", "url")).alias("at")).select("site", "at.*")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("place"))).filter(F.col("rank") <= most).select("site", "url")


def script_chunks(html: str | Column) -> Column:
    """Strings pushed by script blocks, joined: where a page's embedded JSON lies."""
    found = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r'\.push\(\[1,\s*"((?:[^"\\]|\\.)*)"\]\)'), F.lit(1))
    return F.replace(F.replace(F.array_join(found, ""), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def looks_empty(html: str | Column, markers: tuple[str, ...] = ('id="root"', 'id="app"', "__NEXT_DATA__")) -> Column:
    """A page that scripts fill: nothing there, few links, or a shell's mark and not many."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    links = F.regexp_count(h, F.lit(r"(?i)<a\s"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(h, F.lit(m))
    return (F.trim(h) == "") | (links < 5) | (marked & (links < 30))


def json_path(column: str, path: str, kind: str = "string") -> Column:
    """A value inside a JSON text; null where the text is malformed or has none."""
    return F.try_variant_get(F.try_parse_json(column), f"$.{path}", kind)


def safe_object(column: str) -> Column:
    """JSON text that is one object and nothing else, else {}."""
    whole = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    one = F.startswith(whole, F.lit("{")) & (embedded.balanced(whole) == whole) & F.try_parse_json(whole).isNotNull()
    return F.when(F.coalesce(one, F.lit(False)), F.col(column)).otherwise("{}")
