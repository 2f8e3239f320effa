"""Operators on small frames: null keys, ties, empty inputs, and loops as the other way round."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import cutoff, joins, updates, windows
from tallygrove.sources import html, landing, sinks
from tallygrove.streaming import runs


def test_not_in_with_null(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with_null, without, nothing = (spark.createDataFrame(x, "k int") for x in ([(1,), (None,)], [(1,)], []))
    assert joins.null_aware_not_in(left, "k", with_null, "k").count() == 0
    assert [r["k"] for r in joins.null_aware_not_in(left, "k", without, "k").collect()] == [2]
    assert joins.null_aware_not_in(left, "k", nothing, "k").count() == 3


def test_upsert_by_presence(spark):
    old = spark.createDataFrame([(1, "a", "x", "u"), (2, "b", "y", "v")], "k int, o string, c string, i string")
    new = spark.createDataFrame([(1, None, None, "w"), (3, "d", "z", "q")], "k int, o string, c string, i string")
    found = {tuple(r) for r in updates.upsert(old, new, ["k"], overwrite=["o"], coalesced=["c"], insert_only=["i"]).collect()}
    assert found == {(1, None, "x", "u"), (2, "b", "y", "v"), (3, "d", "z", "q")}


def test_changed_only_null_safe(spark):
    old, new = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "k int, v int"), spark.createDataFrame([(1, None), (2, None), (3, 6)], "k int, v int")
    assert sorted(r["k"] for r in updates.changed_only(old, new, "k", ["v"]).collect()) == [2, 3]


def stop_by_loop(pages, known):
    seen, streak, last = set(), 0, 0
    for n, ids in enumerate(pages, 1):
        fresh = ids - known
        if n > 1 and ids <= seen:
            return last
        last = n
        seen |= ids
        if n == 1:
            if known and not fresh:
                return 1
            continue
        streak = streak + 1 if not fresh else 0
        if streak == 2:
            return last
    return last


def test_stop_page_against_loop(spark):
    rnd = random.Random(5)
    rows, known, want = [], [], {}
    for s in range(120):
        pages = [{rnd.randrange(12) for _ in range(3)} for _ in range(rnd.randint(1, 7))]
        own = {i for i in range(12) if rnd.random() < rnd.choice([0, 0.5, 0.9])}
        want[s] = stop_by_loop(pages, own)
        rows += [(s, n, i) for n, ids in enumerate(pages) for i in ids]
        known += [(s, i) for i in own]
    r, k = spark.createDataFrame(rows, "source int, page int, id int"), spark.createDataFrame(known, "source int, id int")
    found = cutoff.stop_page(cutoff.page_facts(r, k, source="source", page="page", key="id"), k, source="source", page="page")
    assert {x["source"]: x["last_page"] for x in found.collect()} == want


def test_greedy_dedupe_against_loop(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("ab"), rnd.choice(["abcdef", "xabcdefy", "zz", "", "abcdefg"]), rnd.randrange(3)) for i in range(80)]
    primaries, want = [], {}
    like = lambda a, b: bool(a and b) and (a == b or len(min(a, b, key=len)) >= 6 and min(a, b, key=len) in max(a, b, key=len))
    for i, company, title, p in sorted(rows, key=lambda x: (x[3], x[0])):
        want[i] = next((j for j, c, t, q in primaries if c == company and q != p and like(title, t)), None)
        if want[i] is None:
            primaries.append((i, company, title, p))
    from tallygrove.functions.text import same_title

    df = spark.createDataFrame(rows, "id int, company string, title string, priority int")
    found = windows.greedy_dedupe(df, id_col="id", company="company", title="title", priority="priority", similar=same_title, priorities=[0, 1, 2])
    assert {r["id"]: r["dup_of"] for r in found.collect()} == want


def test_greedy_dedupe_by_parts(spark, monkeypatch):
    """Equal titles are compared once, however many rows have them, and the parts of titles lose no link."""
    from tallygrove.functions.text import same_title, title_parts

    rnd, sizes = random.Random(11), []
    stems = ["engineer", "senior engineer x", "engine", "lead", "lead dev", "가나다라마바", "x가나다라마바사", None, ""]
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(stems), rnd.choice([0, 1, 2, 5, None])) for i in range(2000)]
    whole = windows.cut
    monkeypatch.setattr(windows, "cut", lambda df: (sizes.append(df.count()), whole(df))[1])
    df = spark.createDataFrame(rows, "id int, company string, title string, priority int")
    found = windows.greedy_dedupe(df, id_col="id", company="company", title="title", priority="priority", similar=same_title, parts=title_parts, priorities=[0, 1, 2])
    primaries, want = {}, {}
    like = lambda a, b: a == b or min(len(a), len(b)) >= 6 and (a in b or b in a)
    for p, i, company, title in sorted((3 if p not in (0, 1, 2) else p, i, c or "", t) for i, c, t, p in rows if c and t):
        own = primaries.setdefault(company, [])
        want[i] = next((j for q, j, t in own if q < p and like(title, t)), None)
        if want[i] is None:
            own.append((p, i, title))
    assert {r["id"]: r["dup_of"] for r in found.collect()} == {i: want.get(i) for i in range(2000)}
    assert max(sizes) < 100


def test_entity_match_against_loop(spark):
    """Ties, values a rounding apart, edges of the range, nulls, repeated keys; and no more rows than both sides have, where pairs would be a million."""
    rnd = random.Random(3)
    values = [0.0, -0.0, 0.3, 0.1 + 0.2, 100.0, 600.0, 600.3, 600.30000001, -400.0, -1e-20, 500.0, 1000.0, 1e17, 1e17 + 496, float("nan"), float("inf"), -7.5, 7.5, None]
    left = [(i % 90, rnd.choice([1, 2, None]), rnd.choice(values)) for i in range(120)]
    right = [(i, rnd.choice([1, 2, 3, None]), rnd.choice(values)) for i in rnd.sample(range(60), 60)]
    want = {}
    for k, g, x in left:
        for s, h, y in right:
            if g is not None and g == h and x is not None and y is not None and abs(x - y) <= 500:
                want[k] = min(want.get(k, (1e9, 0)), (abs(x - y), s))
    named = {"left_key": "a", "right_key": "b", "left_group": "g", "right_group": "h", "left_value": "x", "right_value": "y"}
    match = lambda l, r: joins.entity_match(spark.createDataFrame(l, "a int, g int, x double"), spark.createDataFrame(r, "b int, h int, y double"), **named, within=500)
    assert {r["a"]: r["b"] for r in match(left, right).collect()} == {k: s for k, (_, s) in want.items()}
    many = match([(i, 1, i / 4) for i in range(1000)], [(i, 1, i / 4) for i in range(1000)])
    assert {r["a"]: r["b"] for r in many.collect()} == {i: i for i in range(1000)}
    assert "BroadcastNestedLoop" not in (plan := many._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan


def test_html(spark):
    page = '<html><head><title> T </title></head><body><nav><ul><li><a href="/n1">n</a></li><li><a href="/n2">n</a></li></ul></nav><article><ul><li><a href="/a1">first row</a></li><li><a href="/a2">second</a></li></ul>' + "text " * 10 + "</article></body></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert [(r["pos"], r["href"]) for r in html.anchors(df, "id", "html").orderBy("pos").collect()] == [(1, "/n1"), (2, "/n2"), (3, "/a1"), (4, "/a2")]
    assert [(r["href"], r["text"]) for r in html.repeating_blocks(df, "id", "html").orderBy("pos").collect()] == [("/a1", "first row"), ("/a2", "second")]
    found = {r["page"]: (r["title"], r["links"]) for r in html.details(df, "id", "html").collect()}
    assert found == {1: ("T", 4), 2: (None, 0)}


def test_landing(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a.b\n\n# note\n https://c.d \n")
    assert sorted(r["url"] for r in landing.url_list(spark, str(tmp_path / "urls.txt")).collect()) == ["https://a.b", "https://c.d"]
    one = spark.createDataFrame([('{"k": {"n": 3}}', "<loc>https://a.b/1</loc><loc> https://a.b/2 </loc>", "[1]")], "j string, x string, l string")
    row = one.select(landing.json_path("j", "k.n", "int").alias("n"), landing.sitemap_urls("x").alias("u"), landing.safe_object("l").alias("o"), landing.looks_empty("x").alias("e")).first()
    assert (row["n"], row["u"], row["o"], row["e"]) == (3, ["https://a.b/1", "https://a.b/2"], "{}", True)


def test_sinks(spark):
    files = spark.createDataFrame([("s", b"abc", "png"), ("s", b"abc", "png"), ("s", b"x" * 30, "png")], "site string, content binary, ext string")
    found = sinks.media_keys(files, "site", "content", "ext", limit=20).collect()
    assert len(found) == 1 and found[0]["path"].startswith("s/ba/ba7816bf")
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, line string")
    assert sinks.message(lines, F.col("line"), ["k"], lines=2).first()["text"] == "a\nb"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    frame = pd.DataFrame({"site": ["a"] * 4 + ["b"], "n": [1, 2, 3, 4, 1], "failed": [False, True, True, True, False], "ts": pd.to_datetime(["2024-01-01"] * 5)})
    spark.createDataFrame(frame).coalesce(1).write.parquet(folder)
    schema = "site string, n long, failed boolean, ts timestamp"
    for name, df, mode in (("streaks", runs.failure_streaks(runs.landed(spark, folder, schema), key="site", ordinal="n", failed="failed"), "update"), ("counts", runs.windowed_counts(runs.landed(spark, folder, schema), time="ts", key="site"), "complete"), ("firsts", runs.first_seen(runs.landed(spark, folder, schema), time="ts", key=["site"]), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["key"], r["streak"], r["status"]) for r in spark.table("streaks").collect()} == {("a", 3, "paused"), ("b", 0, "active")}
    assert {(r["site"], r["n"]) for r in spark.table("counts").collect()} == {("a", 4), ("b", 1)}
    assert spark.table("firsts").count() == 2


@pytest.mark.parametrize("module", ["operators.ordering", "operators.batches"])
def test_imports(module):
    __import__(f"tallygrove.{module}")


def test_stops_see_every_event(spark):
    """The first page without anything new stands after page 60."""
    from tallygrove.plans import queries

    ids = [*range(1, 1001, 2)] + [1, 3, 5, 7, 9] * 3 + [2001, 2003, 2005, 2007, 2009]
    events = spark.createDataFrame([(i, "view", u) for i, u in enumerate(ids)], "event_id long, event_type string, user_id long")
    rows, _ = queries._sightings(events)
    assert rows.count() == len(ids) and rows.agg({"page": "max"}).first()[0] == 103
    facts = queries.cutoff.page_facts(rows, rows.filter("false").select("source", "id"), source="source", page="page", key="id")
    assert [r["last_page"] for r in queries.cutoff.stop_after_barren(facts, source="source", page="page", short=3).collect()] == [101]


def test_text_keys_take_whole_texts(spark, tmp_path):
    from tallygrove.plans import queries

    rows = [(1, "Same start " * 10 + "one"), (2, "Same start " * 10 + "two"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.text_keys(spark, str(tmp_path)).collect()}
    assert found == {1: ("samestart" * 10 + "one",) * 3, 2: ("samestart" * 10 + "two",) * 3, 3: (None, "", "")}
