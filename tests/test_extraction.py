"""Schemas, chains, templates, calls, profiles, companies, places and page details on literals."""

import json

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import embedded, templates, text
from tallygrove.operators import chains, companies, handlers, paging, profile, schema, subjects
from tallygrove.sources import pages


def calls(spark, bodies):
    rows = [("s", f"https://a.b/v?page=1&size=9&n={i}", i, "https://a.b/view/77/x", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "site string, url string, ordinal int, detail_url string, body string")


@pytest.mark.parametrize(
    ("bodies", "want"),
    [
        ([{"data": {"list": [{"seq": 77, "name": "x"}, {"seq": 2, "name": "y"}]}}], ("data.list", "seq", "name", "77", "https://a.b/view/{id}/x")),
        ([[{"no": 5, "title": "x"}, {"no": 6, "title": ""}]], ("", "no", "title", "5", None)),
        ([{"a": [{"id": 1, "title": "t"}] * 2, "b": [{"id": 3, "title": "t"}] * 3}], ("b", "id", "title", "3", None)),
        ([{"a": [{"id": 1, "title": "t"}]}, "no json", {"x": [{"id": 8, "role": "r"}, {"id": 9, "role": "r"}]}], ("x", "id", "role", "8", None)),
        ([{"a": [{"id": 0, "key": "k", "title": "t"}, {"id": None, "key": "k", "title": "t"}, {"id": 5, "title": "t"}, {"id": "", "title": "t"}]}], ("a", "key", "title", "k", None)),
        ([{"a": {"b": {"c": [{"id": 1, "title": "t"}] * 4}}}], None),
        ([{"a": [{"id": 1, "title": "t"}, 5]}, None, {"a": [{"key": 1}] * 5}], None),
    ],
)
def test_list_schemas(spark, bodies, want):
    rows = schema.list_schemas(calls(spark, bodies)).collect()
    assert [(r["list_path"], r["id_field"], r["title_field"], r["first_id"], r["detail_template"]) for r in rows] == ([want] if want else [])


def test_chain_ends_at_gaps_and_cycles(spark):
    links = [("a", "1", "2"), ("a", "2", "3"), ("a", "3", "2"), ("a", "9", "1"), ("b", "1", "5"), ("c", "1", None)] + [("d", str(i), str(i + 1)) for i in range(100)]
    df = spark.createDataFrame(links, "site string, url string, next string")
    starts = spark.createDataFrame([(s, u) for s, u in [("a", "1"), ("b", "1"), ("c", "1"), ("d", "0"), ("e", "1")]], "site string, url string")
    found = {(r["site"], r["url"]): r["step"] for r in chains.chain(df, starts).collect()}
    assert found == {("a", "1"): 0, ("a", "2"): 1, ("a", "3"): 2, ("b", "1"): 0, ("c", "1"): 0} | {("d", str(i)): i for i in range(100)}
    assert chains.chain(df.limit(0), starts).count() == 0


def anchors(spark, rows, base="https://a.b/jobs/list?x=1"):
    return spark.createDataFrame([(1, base, i, t, h) for i, (t, h) in enumerate(rows)], "page int, base string, pos int, text string, href string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("1", "page/1.htm"), ("2", "page/2.htm"), ("5", "page/5.htm")], ("https://a.b/jobs/page/{N}.htm", 1, 1, 3)),
        ([("2", "/l/p-02/x?k=2"), ("more", "/y"), ("4", "/l/p-04/x?k=2")], ("https://a.b/l/p-{N}/x?k=2", 2, 2, 2)),
        ([("1", "/a/1"), ("2", "/b/3"), ("3", "/c/4/d"), ("4", "/a/4")], ("https://a.b/a/{N}", 1, 3, 2)),
        ([("1", "/a/1"), ("2", "https://x.y/a/2")], None),
        ([("1", "/a/1"), ("2", "/a/3"), ("0", "/a/0"), ("12345", "/a/12345")], None),
        ([("1", "?page=1"), ("2", "?page=2")], None),
    ],
)
def test_path_templates(spark, rows, want):
    assert [tuple(r)[1:] for r in paging.path_template(anchors(spark, rows)).collect()] == ([want] if want else [])


def test_parameters(spark):
    rows = [("1", "?p=1&page_no=2"), ("2", "list?page_no=3"), ("x", "/other?cpage=1"), ("y", "?p=a"), ("z", "/jobs/list?p=7#t")]
    assert [tuple(r) for r in paging.linked_parameter(anchors(spark, rows)).collect()] == [(1, "page_no", 2)]
    url = lambda u: spark.range(1).select(paging.existing_parameter(F.lit(u))).first()[0]
    assert [url("https://a/b?p=1&pageNo="), url("https://a/b?x=1"), url("https://a/b?startPage=2#page=1")] == ["pageNo", None, "startPage"]


def test_calls(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    call = one(handlers.called(F.lit("javascript: goView('16', \"a b\", 7 ); return")))
    assert (call["fn"], call["args"]) == ("goView", ["16", "a b", "7"]) and one(handlers.called(F.lit("/view"))) is None
    assert one(handlers.abstracted(F.lit("https://a.b/7/x?no=16&y=167"), F.array(F.lit("16"), F.lit("7")))) == "https://a.b/{1}/x?no={0}&y=167"
    assert [one(handlers.filled(F.lit(t), F.array(F.lit("u")))) for t in ("/{0}/{", "/{1}")] == ["/u/{", None]
    script = "function A(i){f.action='/v.do';f.no.value=i} function bPopup(i){f.action='/p'} function c(i){g(i)}"
    where = lambda fn: one(handlers.resolved(F.lit("https://h/x/l.do?q=1"), F.lit(script), F.lit(fn), F.lit("9")))
    assert [where(f) for f in ("a", "bPopup", "c", "d")] == ["https://h/v.do?no=9", None, None, None]


def test_templates_are_kept_only_if_they_hold(spark):
    rows = [("s", "f", [str(i)], f"/v/{i}", i > 7) for i in range(10)] + [("s", "g", [str(i)], f"/v/{i}" if i < 8 else "/gone", i > 7) for i in range(10)] + [("s", "h", ["1"], "/x", False), ("s", "h", ["1"], "/x", True)]
    df = spark.createDataFrame(rows, "site string, fn string, args array<string>, landed string, held_out boolean")
    assert [tuple(r) for r in handlers.learned_templates(df).collect()] == [("s", "f", "/v/{0}", 8, 2, 2)]


def test_profile(spark):
    lines = ["# me", "intro", "## 보유 기술 (code)", "- 보유: Java, Spark (3 years, daily), ", " - 일부 : Go", "note", "## 연봉", "- 현재: 4,200만원", "## goal", "work", ""]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "## 연봉")], "doc_id int, pos int, line string")
    rows = {r["doc"]: r for r in profile.profiles(df).collect()}
    assert (rows[1]["text"], rows[1]["has"], rows[1]["partial"], rows[1]["salary"]) == ("# me\nintro\n## goal\nwork\n", ["Java", "Spark"], ["Go"], 4200)
    assert (rows[2]["text"], rows[2]["has"], rows[2]["salary"]) == ("\n", [], None)


def test_companies(spark):
    left = spark.createDataFrame([(1, "(주)에이 (A Corp)", 2000, None, None), (2, "비누", None, 50, 300), (3, "씨앗", 1990, None, None), (4, "없음", 1990, None, None)], "id int, name string, founded int, least_employees int, most_employees int")
    right = spark.createDataFrame(
        [(10, "에이", 2010, 5, 1), (11, "A-Corp (old)", 2001, 5, 2), (20, "비누", 1999, 1000, 1), (21, "비누", 1999, 60, 2), (30, "씨앗㈜", None, None, 1), (31, None, 1990, 1, 1)], "match int, label string, founded int, employees int, rank int"
    )
    assert {r["id"]: r["match"] for r in companies.same_companies(left, right).collect()} == {1: 11, 3: 30}


def test_companies_of_one_name_are_looked_up_once(spark):
    """Rows past the look-up are one a company, however many labels and variants its name has."""
    left = spark.createDataFrame([(i, "Grp (GG) (G.R.P) (HH)", 1990 + i % 3, None, None) for i in range(500)], "id int, name string, founded int, least_employees int, most_employees int")
    right = spark.createDataFrame([(m, ["GRP", "gg", "h-h"][m % 3], 1980 + m, 1, m) for m in range(18)], "match int, label string, founded int, employees int, rank int")
    found = companies.same_companies(left, right)
    # looked at: labels of GRP, 0, 3, 6 and 9, which fill the list; founded in 1980, 1983, 1986 and 1989
    assert {r["id"]: r["match"] for r in found.collect()} == {i: 9 for i in range(500) if i % 3 == 0}
    assert "Window [row_number() windowspecdefinition(id" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Window [count" not in plan


def test_places_are_filled_once(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    contents = F.create_map(F.lit("0"), F.lit("[[[CONTENT-ELEMENT-1]]]$1"), F.lit("1"), F.lit("B"))
    assert one(templates.filled(F.lit("[[[CONTENT-ELEMENT-0]]]a[[[CONTENT-ELEMENT-1]]][[[CONTENT-ELEMENT-5]]]"), contents)) == "[[[CONTENT-ELEMENT-1]]]$1aB"
    assert one(templates.local_media(F.lit('<img src="/a"><img src="/ab">'), 'src="([^"]+)"', "m/")).count("m/") == 2


@pytest.mark.parametrize(("x", "want"), [('x = {"a": "}{\\" [", "b": [{}]}; {', '{"a": "}{\\" [", "b": [{}]}'), ('x = {"a": [}', None), ("x = none", None), ('{"before": 1} x = [1] {"b": 2}{', '{"b": 2}'), (None, None)])
def test_embedded_json(spark, x, want):
    assert spark.range(1).select(embedded.embedded_json(F.lit(x).cast("string"), "x = ")).first()[0] == want


@pytest.mark.parametrize(("x", "want"), [("2024 3,000만원", (3000, 3000)), ("1억 2천만 ~ 1억5,000만", (12000, 15000)), ("월 급여 300만 이상", (3600, None)), ("1억, 500만, 5천", (10000, 10000)), ("월급 100만원 연 2,000만", (2000, 2000)), ("천만 만 억", (None, None)), ("1.5억", (15000, 15000))])
def test_salary(spark, x, want):
    assert tuple(spark.range(1).select(text.salary_range(F.lit(x)).alias("s")).first()["s"]) == want


HTML = """<html><head><title> T &amp; t</title><meta name="d" content="c"><script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/n">nav</a></nav><div class="pager">1 2</div><div id="comments">c</div><div class="board_view">Intro text long enough to be a body of its own.
<h2>Duties</h2><p>Do <b>this</b></p><h3>Wanted <i>x</i></h3>that
<table><tr><th rowspan="2">R</th><td colspan="2">a</td></tr><tr><td>b</td><td>c<br>d</td></tr><tr><td>e</td></tr></table>
<img src="/i-300x200.png?v=1" data-src="j.jpg" srcset="k.png 1x, /i.png?v=1 2x"><a href="f.PDF">file</a><a href="f.PDF">again</a><a href="/download.do?x=1">Download</a><a href="javascript:x()">js</a><a href="#t">t</a>
<iframe src="//v.w/e"></iframe><video><source src="v.mp4"></video><textarea>&lt;p&gt;hidden &lt;a href="/h"&gt;link&lt;/a&gt;&lt;/p&gt;</textarea> mail a@b.co 목록 다음글</div>
<div class="bo_v_file"><a href="/g.zip">g</a></div><footer>foot</footer></body></html>"""


def test_page_details(spark):
    rows = spark.createDataFrame([(1, "https://a.b/x/y", HTML), (2, "https://a.b/", "<title>only</title><p>short"), (3, None, None), (4, "https://a.b/", "<p>" * 5000 + "deep " * 20)], "id int, url string, html string")
    r = {x["page"]: x for x in pages.page_details(rows, "id", "url", "html").collect()}
    one = r[1]
    assert one["title"] == "T & t" and one["error"] is None and one["meta"] == {"d": "c"} and one["emails"] == ["a@b.co"]
    assert one["body"].startswith("Intro text") and one["body"].endswith("mail a@b.co") and "nav" not in one["body"] and "hidden link" in one["body"]
    assert [(s["heading"], s["text"][:7]) for s in one["sections"]] == [(None, "Intro t"), ("Duties", "Do this"), ("Wanted x", "that R ")]
    assert one["tables"] == [[["R", "a", "a"], ["R", "b", "c d"], ["e"]]]
    assert [(j["valid"], j["text"]) for j in one["jsonld"]] == [(True, '{"a": 1}'), (False, "{bad")]
    assert one["images"] == ["https://a.b/i.png?v=1", "https://a.b/x/j.jpg", "https://a.b/x/k.png"]
    assert [(a["url"], a["ext"]) for a in one["attachments"]] == [("https://a.b/x/f.PDF", "pdf"), ("https://a.b/download.do?x=1", "bin"), ("https://a.b/g.zip", "zip")]
    assert [x["url"] for x in one["links"]] == ["https://a.b/x/f.PDF", "https://a.b/download.do?x=1", "https://a.b/h"] and one["iframes"] == ["https://v.w/e"] and one["videos"] == ["https://a.b/x/v.mp4"]
    assert [r[i]["error"] for i in (2, 3, 4)] == ["empty detail (body=10c, no media/jsonld)", "empty detail (body=0c, no media/jsonld)", None]
    details = pages.page_details(rows, "id", "url", "html")
    assert sorted(x["id"] for x in pages.stored(rows.select("id"), details, key="id").collect()) == [1, 4]
    assert pages.stored(rows.select("id"), details, key="id", list_only=True).count() == 4


def test_block_anchors_and_subjects(spark):
    row = lambda i: f"<li class='r x'><a href=\"javascript:co('{i // 3}')\">Company number {i // 3}</a><a href='/job/{i}'>J{i}</a><a href='/job/{i}?v=2'>Job {i}</a></li>"
    html = "<nav><ul><li><a href='/a'>a</a></li><li></li></ul></nav><ul>" + "".join(map(row, range(6))) + "<li class='other'>no</li></ul>"
    df = spark.createDataFrame([(7, html), (8, None)], "page_id int, html string")
    found = pages.block_anchors(df, "page_id", "html")
    assert found.count() == 18 and {r["signature"] for r in found.collect()} == {"ul>li.r"}
    best = subjects.subjects(found.withColumn("base", F.lit("https://a.b/l"))).orderBy("row").collect()
    assert [(r["row"], r["url"], r["title"], r["score"]) for r in best] == [(i + 1, f"https://a.b/job/{i}?v=2", f"Job {i}", 2.0) for i in range(6)]
    hinted = subjects.subjects(found.withColumn("base", F.lit("https://a.b/l")), prefix="https://a.b/job/3").orderBy("row").collect()
    assert [r["url"] for r in hinted] == [None] * 3 + ["https://a.b/job/3"] + [None] * 2
