"""Menus on literal rows."""

from pyspark.sql import functions as F

from tallygrove.operators import menus


def test_scores_and_names(spark):
    rows = spark.createDataFrame([("Careers", "https://a.b/jobs", 0), (None, "https://a.b/x", 1), ("Careers", "https://a.b/jobs", 2)], "t string, u string, o int").withColumn("s", menus.link_score("t", "u"))
    assert [r["s"] for r in rows.orderBy("o").collect()] == [2 + 2 + 1 + 1 + 3, 0, 2 + 2 + 1 + 1 + 3]
    assert [(r["u"], r["o"]) for r in menus.best_links(rows, "u", "s", "o").collect()] == [("https://a.b/jobs", 0)]
    names = ["CamHR - Find jobs here", "a, 슈퍼루키, b long", "X|Y|Z -- SiteName", "x"]
    found = spark.createDataFrame([(n,) for n in names], "t string").select(menus.best_segment(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in found] == ["CamHR", "슈퍼루키", "SiteName", None]


def test_page_parameter(spark):
    rows = spark.createDataFrame([(1, "https://a.b/l?page=2"), (1, "https://a.b/l?currentPage=2"), (1, "https://a.b/l?currentPage=3"), (2, "https://a.b/l?page=x")], "p int, h string")
    assert [tuple(r) for r in menus.page_parameter(rows, "p", "h").collect()] == [(1, "currentPage")]


def test_dedupe(spark):
    rows = [
        ("s", "https://a.b/l?c=1&d=2", 9, 0.9, ["7", "8"]), ("s", "https://a.b/l?c=1", 5, 0.9, ["1", "2", "3"]), ("s", "https://a.b/m", 3, 0.5, ["1", "2", "9"]),
        ("s", "https://a.b/n", 8, 0.5, ["1", "2", "3", "4"]), ("s", "https://a.b/e", 1, 0.1, []), ("z", "https://z.b/n", 8, 0.5, ["1"]),
    ]
    found = {r["url"]: r["covered_by"] for r in menus.dedupe_menus(spark.createDataFrame(rows, "site string, url string, list_rows int, link_ratio double, ids array<string>")).collect()}
    assert found == {"https://a.b/n": None, "https://a.b/m": None, "https://a.b/e": None, "https://a.b/l?c=1": "https://a.b/n", "https://a.b/l?c=1&d=2": None, "https://z.b/n": None}
