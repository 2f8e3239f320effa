"""Queries that learn from pages and answers: list schemas, page chains, page templates, script calls, profiles, company tables, details. Each has its DuckDB SQL.
Answers and links are made from events, orders, lineitem and suppliers, page texts are those of pages and documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import templates
from tallygrove.operators import chains, companies, handlers, paging, profile, schema, subjects
from tallygrove.sources import html, pages as read
from tallygrove.sources.landing import json_path, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


# -- list schemas: a site is a user, a call is an event type, whose answers have their list in different places -------------------------------
_ANSWERS = """
e AS (
    SELECT user_id AS site, event_type AS ordinal, event_id, CASE WHEN value >= 40 THEN event_type END AS subject,
        CASE WHEN json_extract(props, '$.k')::INT >= 50 THEN event_id ELSE 0 END AS id FROM events
), rows AS (
    SELECT site, ordinal, min(event_id) AS least, to_json(list({'seq': event_id, 'id': id, 'subject': subject} ORDER BY event_id))::VARCHAR AS r FROM e GROUP BY ALL
), calls AS (
    SELECT site, ordinal, 'https://api.example.com/v1/' || site || '/' || ordinal || CASE WHEN ordinal < 'e' THEN '?page=3&size=20' ELSE '?q=a' END AS url,
        'https://www.example.com/view/' || least || '?from=list' AS detail_url,
        CASE ordinal WHEN 'view' THEN '{"total": 7, "ads": [1, 2], "data": {"result": ' || r || ', "empty": []}}' WHEN 'click' THEN '{"jobs": ' || r || '}' WHEN 'error' THEN r
            WHEN 'purchase' THEN '{"mixed": ' || regexp_replace(r, '\\]$', ', 1]') || '}' ELSE '{"a": {"b": {"c": ' || r || '}}' END AS body
    FROM rows
)"""


def _answers(spark, d):
    (events,) = tables(spark, d, "events")
    e = events.select(F.col("user_id").alias("site"), F.col("event_type").alias("ordinal"), F.struct(F.col("event_id").alias("seq"), F.when(json_path("props", "k", "int") >= 50, F.col("event_id")).otherwise(0).alias("id"), F.when(F.col("value") >= 40, F.col("event_type")).alias("subject")).alias("o"))
    rows = e.groupBy("site", "ordinal").agg(F.to_json(F.array_sort(F.collect_list("o")), {"ignoreNullFields": "false"}).alias("r"), F.min("o.seq").alias("least"))
    wrapped = F.when(F.col("ordinal") == "view", F.concat(F.lit('{"total": 7, "ads": [1, 2], "data": {"result": '), "r", F.lit(', "empty": []}}'))).when(F.col("ordinal") == "click", F.concat(F.lit('{"jobs": '), "r", F.lit("}"))).when(F.col("ordinal") == "error", F.col("r"))
    body = wrapped.when(F.col("ordinal") == "purchase", F.concat(F.lit('{"mixed": '), F.regexp_replace("r", r"\]$", ", 1]"), F.lit("}"))).otherwise(F.concat(F.lit('{"a": {"b": {"c": '), "r", F.lit("}}")))
    tail = F.when(F.col("ordinal") < "e", "?page=3&size=20").otherwise("?q=a")
    return rows.select("site", "ordinal", F.concat(F.lit("https://api.example.com/v1/"), "site", F.lit("/"), "ordinal", tail).alias("url"), F.concat(F.lit("https://www.example.com/view/"), "least", F.lit("?from=list")).alias("detail_url"), body.alias("body"))


@query(f"""
WITH {_ANSWERS},
j AS (SELECT site, ordinal, url, detail_url, body::JSON AS v FROM calls WHERE json_valid(body)),
one AS (SELECT site, ordinal, k.key AS path, k.value AS v FROM (SELECT * FROM j WHERE json_type(v) = 'OBJECT') AS o, json_each(o.v) AS k),
two AS (SELECT site, ordinal, o.path || '.' || k.key AS path, k.value AS v FROM (SELECT * FROM one WHERE json_type(v) = 'OBJECT') AS o, json_each(o.v) AS k),
lists AS (
    SELECT *, json_array_length(v)::BIGINT AS n FROM (SELECT site, ordinal, '' AS path, v FROM j UNION ALL FROM one UNION ALL FROM two)
    WHERE json_type(v) = 'ARRAY' AND json_array_length(v) >= 2 AND list_bool_and(list_transform(json_extract(v, '$[*]'), lambda x: json_type(x) = 'OBJECT'))
),
best AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, ordinal, path) = 1),
fields AS (
    SELECT site, f.key, n, e.key::INT AS row, f.value ->> '$' AS v FROM best, json_each(best.v) AS e, json_each(e.value) AS f
),
known AS (SELECT site, key, count(*) FILTER (coalesce(v, '') NOT IN ('', '0', '0.0', 'false')) AS filled, max(n) AS n, any_value(v) FILTER (row = 0) AS first FROM fields GROUP BY ALL),
named AS (
    SELECT site, min_by(key, list_position({schema.ID_FIELDS}, key)) FILTER (list_contains({schema.ID_FIELDS}, key)) AS id_field, min_by(first, list_position({schema.ID_FIELDS}, key)) FILTER (list_contains({schema.ID_FIELDS}, key)) AS first_id,
        min_by(key, list_position({schema.TITLE_FIELDS}, key)) FILTER (list_contains({schema.TITLE_FIELDS}, key)) AS title_field
    FROM known WHERE filled >= n // 2 GROUP BY site
)
SELECT site, url, path AS list_path, n, id_field, title_field, first_id, regexp_replace(url, '\\?.*$', '') AS base_url,
    CASE WHEN contains(url, 'page=') THEN replace(replace(url, 'page=3', 'page={{page}}'), 'size=20', 'size={{size}}') ELSE url || '&page={{page}}' END AS api_template,
    CASE WHEN contains(url, 'size=') THEN 'size' END AS size_param, CASE WHEN contains(detail_url, first_id) THEN replace(detail_url, first_id, '{{id}}') END AS detail_template
FROM best JOIN j USING (site, ordinal) JOIN named USING (site) WHERE id_field IS NOT NULL AND title_field IS NOT NULL
""")
def learned_schemas(spark, d):
    return schema.list_schemas(_answers(spark, d))


@query(f"""
WITH {_ANSWERS}
SELECT user_id AS site, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, event_id::VARCHAR AS id, CASE WHEN value >= 40 THEN event_type END AS title
FROM events WHERE event_type IN ('view', 'click', 'error')
""")
def schema_items(spark, d):
    place = F.when(F.col("ordinal") == "view", "data.result").when(F.col("ordinal") == "click", "jobs").when(F.col("ordinal") == "error", "")
    answers = _answers(spark, d).withColumn("path", place).filter("path IS NOT NULL").withColumns({"i": F.lit("seq"), "t": F.lit("subject")})
    return schema.list_items(answers, body="body", path="path", id_field="i", title_field="t", keep=["site"]).withColumn("pos", F.col("pos").cast("long"))


# -- page chains: a customer's orders by date; the last one of a finished order leads back to the first, an urgent one to a page that has not landed ------
_NEXT = "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 20000 THEN 'gone' WHEN after IS NULL AND o_orderstatus = 'F' THEN first ELSE after END"


@query(f"""
WITH RECURSIVE p AS (
    SELECT o_custkey AS site, o_orderkey::VARCHAR AS url, {_NEXT} AS next, url = first AS starts FROM (
        SELECT *, o_orderkey::VARCHAR AS url, lead(o_orderkey::VARCHAR) OVER w AS after, first_value(o_orderkey::VARCHAR) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
), c AS (
    SELECT site, url, next, 0::BIGINT AS step, [url] AS seen FROM p WHERE starts
    UNION ALL SELECT p.site, p.url, p.next, step + 1, list_append(seen, p.url) FROM c JOIN p ON p.site = c.site AND p.url = c.next WHERE NOT list_contains(seen, p.url)
)
SELECT site, url, step FROM c
""")
def next_link_chains(spark, d):
    (orders,) = tables(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    rows = orders.withColumns({"after": F.lead(key).over(w), "first": F.first(key).over(w)})
    following = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 20000), "gone").when(F.col("after").isNull() & (F.col("o_orderstatus") == "F"), F.col("first")).otherwise(F.col("after"))
    landed = rows.select(F.col("o_custkey").alias("site"), key.alias("url"), "first", F.to_json(F.struct(F.struct(following.alias("next")).alias("links"))).alias("body"))
    pages = landed.select("site", "url", "first", json_path("body", "links.next").alias("next"))
    return chains.chain(pages, pages.select("site", F.col("first").alias("url")).distinct())


# -- page templates: a customer's page links its orders by number -------------------------------------------------------------------------------
_LINKS = """
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
links AS (
    SELECT o_custkey AS page, k AS pos, 'https://www.example.com/jobs/' || o_custkey || '/list?sort=new' AS base, c_nationkey AS nation,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'next' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' ' || (k * 3) || ' ' ELSE k::VARCHAR END AS text,
        CASE WHEN o_orderstatus = 'P' THEN 'https://other.example.com/x/' || k WHEN c_nationkey < 8 THEN 'page/' || k || '.htm' WHEN c_nationkey < 16 THEN '/jobs/list-' || k || '/all#top'
            ELSE '?sort=new&' || CASE WHEN o_orderpriority < '3' THEN 'pageNo' ELSE 'p' END || '=' || k END AS href
    FROM r JOIN customer ON c_custkey = o_custkey
)"""


def _links(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    rows = orders.withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).join(customer, F.col("c_custkey") == F.col("o_custkey"))
    k, nation, kind = F.col("k").cast("string"), F.col("c_nationkey"), F.col("o_orderpriority")
    text = F.when(kind == "5-LOW", "next").when(kind == "4-NOT SPECIFIED", F.concat(F.lit(" "), (F.col("k") * 3).cast("string"), F.lit(" "))).otherwise(k)
    named = F.concat(F.lit("?sort=new&"), F.when(kind < "3", "pageNo").otherwise("p"), F.lit("="), k)
    href = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("https://other.example.com/x/"), k)).when(nation < 8, F.concat(F.lit("page/"), k, F.lit(".htm"))).when(nation < 16, F.concat(F.lit("/jobs/list-"), k, F.lit("/all#top"))).otherwise(named)
    return rows.select(F.col("o_custkey").alias("page"), F.col("k").alias("pos"), F.concat(F.lit("https://www.example.com/jobs/"), "o_custkey", F.lit("/list?sort=new")).alias("base"), text.alias("text"), href.alias("href"))


@query(f"""
WITH {_LINKS},
own AS (SELECT *, trim(text)::INT AS number FROM links WHERE regexp_full_match(trim(text), '[0-9]{{1,4}}') AND trim(text)::INT BETWEEN 1 AND 999 AND NOT starts_with(href, 'https://other')),
u AS (
    SELECT page, pos, number, nation, CASE WHEN nation < 8 THEN 'https://www.example.com/jobs/' || page || '/' || href WHEN nation < 16 THEN 'https://www.example.com' || href END AS url, pos::INT AS inside FROM own
),
f AS (SELECT *, first_value(number) OVER w AS first, first_value(url) OVER w AS first_url, first_value(inside) OVER w AS first_inside FROM u WINDOW w AS (PARTITION BY page ORDER BY pos)),
ok AS (SELECT page, first, number, CASE WHEN nation < 8 THEN 'https://www.example.com/jobs/' || page || '/page/{{N}}.htm' ELSE 'https://www.example.com/jobs/list-{{N}}/all#top' END AS template
    FROM f WHERE nation < 16 AND number <> first AND inside = number AND first_inside = first),
n AS (SELECT DISTINCT * FROM (FROM ok UNION ALL SELECT page, first, first, template FROM ok)),
g AS (SELECT *, number - lag(number) OVER (PARTITION BY page ORDER BY number) AS gap FROM n)
SELECT page, template, first, min(gap) AS step, count(*) AS n FROM g GROUP BY page, template, first
""")
def path_templates(spark, d):
    return paging.path_template(_links(spark, d))


@query(f"""
WITH {_LINKS},
q AS (SELECT page, pos, CASE WHEN contains(href, 'pageNo=') THEN 'pageNo' ELSE 'p' END AS param FROM links WHERE starts_with(href, '?')),
c AS (SELECT page, param, count(*) AS links, min(pos) AS first FROM q GROUP BY ALL)
SELECT page, param, links FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY links DESC, first) = 1
""")
def linked_parameters(spark, d):
    return paging.linked_parameter(_links(spark, d))


# -- script calls -----------------------------------------------------------------------------------------------------------------------------------
_CALLS = """
calls AS (
    SELECT o_custkey AS site, CASE o_orderstatus WHEN 'F' THEN 'goView' WHEN 'O' THEN 'open_job' ELSE 'popup' END AS fn, [o_orderkey::VARCHAR, o_orderstatus, year(o_orderdate)::VARCHAR] AS args, month(o_orderdate) > 8 AS held_out,
        CASE WHEN o_totalprice > 300000 THEN 'https://www.example.com/error' WHEN o_orderstatus = 'F' THEN 'https://www.example.com/' || o_custkey || '/view.do?no=' || o_orderkey || '&y=' || year(o_orderdate)
            WHEN o_orderstatus = 'O' THEN 'https://www.example.com/O/' || o_orderkey ELSE 'https://www.example.com/pop' END AS landed
    FROM orders
)"""


@query(f"""
WITH {_CALLS},
t AS (
    SELECT site, fn, array_to_string(list_transform(regexp_extract_all(landed, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+'), lambda x: coalesce('{{' || (list_position(args, x) - 1) || '}}', x)), '') AS template FROM calls WHERE NOT held_out
),
counts AS (SELECT site, fn, template, count(*) AS support FROM t WHERE regexp_matches(template, '\\{{[0-9]+\\}}') GROUP BY ALL),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY site, fn ORDER BY support DESC, template) = 1)
SELECT site, fn, template, support, count(*) AS tried, count(*) FILTER (landed = replace(replace(replace(template, '{{0}}', args[1]), '{{1}}', args[2]), '{{2}}', args[3])) AS "right"
FROM best JOIN calls USING (site, fn) WHERE held_out GROUP BY ALL HAVING "right" >= 0.9 * tried
""")
def call_templates(spark, d):
    (orders,) = tables(spark, d, "orders")
    key, status, year = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.year("o_orderdate").cast("string")
    fn = F.when(status == "F", "goView").when(status == "O", "open_job").otherwise("popup")
    href = F.concat(F.lit("javascript: "), fn, F.lit("('"), key, F.lit("', \""), status, F.lit('", '), year, F.lit("); return false"))
    view = F.concat(F.lit("https://www.example.com/"), "o_custkey", F.lit("/view.do?no="), key, F.lit("&y="), year)
    landed = F.when(F.col("o_totalprice") > 300000, "https://www.example.com/error").when(status == "F", view).when(status == "O", F.concat(F.lit("https://www.example.com/O/"), key)).otherwise("https://www.example.com/pop")
    calls = orders.select(F.col("o_custkey").alias("site"), handlers.called(href).alias("c"), (F.month("o_orderdate") > 8).alias("held_out"), landed.alias("landed"))
    return handlers.learned_templates(calls.select("site", "c.fn", "c.args", "held_out", "landed"))


@query("""
SELECT s_suppkey, fn, CASE fn WHEN 'goView' THEN 'https://www.example.com/a' || s_nationkey || '/view.do?seq=' || s_suppkey WHEN 'GOLIST' THEN 'https://www.example.com/s' || s_suppkey || '/l.do?x=1&idx=' || s_suppkey END AS url
FROM supplier, (SELECT unnest(['goView', 'GOLIST', 'openPopup', 'none']) AS fn)
""")
def script_resolved(spark, d):
    (supplier,) = tables(spark, d, "supplier")
    script = F.concat(
        F.lit("<script>function goView(id) { var f = document.f; f.action = '/a"), "s_nationkey", F.lit("/view.do'; f.seq.value = id; f.submit(); }\nfunction goList(n){f.action=\"l.do?x=1\";}\nfunction goView(b) {f.action='/late';}"),
        F.lit("function none(a) { alert(a); } function openPopup(a) { f.action='/p'; }</script>"),
    )
    pages = supplier.select("s_suppkey", script.alias("html"), F.concat(F.lit("https://www.example.com/s"), "s_suppkey", F.lit("/list.do?q=1")).alias("page"), F.explode(F.array(*map(F.lit, ("goView", "GOLIST", "openPopup", "none")))).alias("fn"))
    return pages.select("s_suppkey", "fn", handlers.resolved("page", "html", "fn", F.col("s_suppkey").cast("string")).alias("url"))


# -- pages: what regular expressions can say of them; these pages have no head but a title, and an article ----------------------------------------
def _said(x: str) -> str:
    """SQL: HTML as text."""
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{c}', 'g')"  # browsers take them without the semicolon too
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"""
WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
b AS (
    SELECT page_id, html, article, CASE WHEN length({_said("regexp_replace(article, '\\s*<[^>]+>\\s*', '', 'g')")}) >= 30 THEN article
        ELSE regexp_replace(html, '(?s)<!--.*?-->|<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>', '', 'g') END AS body FROM a
)
SELECT page_id, {_said("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, sha1(rtrim({_said("body")}[:20000])) AS body, {_said("regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
    length({_said("regexp_replace(article, '(?s)<h1>.*?</h1>', '')")})::INTEGER AS chars, 0 AS links, 'utf-8' AS charset
FROM b WHERE length({_said("body")}) >= 50
""")
def page_details(spark, d):
    (pages,) = tables(spark, d, "pages")
    found = read.page_details(pages, "page_id", "url", "html")
    section = F.element_at("sections", -1)  # an article's only heading is its first
    charset = F.when(F.map_contains_key("meta", "charset"), F.element_at("meta", "charset")).otherwise("utf-8")
    return found.filter("error IS NULL").select(F.col("page").alias("page_id"), "title", F.sha1("body").alias("body"), section["heading"].alias("heading"), F.length(section["text"]).alias("chars"), F.size("links").alias("links"), charset.alias("charset"))


@query(f"""
WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS hrefs, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS texts FROM pages),
x AS (SELECT page_id, unnest(range(1, len(hrefs) + 1)) AS row, hrefs, texts FROM l WHERE len(hrefs) >= 2)
SELECT page_id AS page, 1 AS block, 'ul>li.' AS signature, row::INTEGER AS row, 1 AS pos, replace(replace(hrefs[row], '&quot;', '"'), '&amp;', '&') AS href, {_said("texts[row]")} AS text FROM x
""")
def block_anchors(spark, d):
    (pages,) = tables(spark, d, "pages")
    return read.block_anchors(pages, "page_id", "html", skipped=()).select("page", "block", "signature", "row", "pos", "href", "text")


# -- subjects: a language's pages are the rows of a block; their links are those of the page, and a call with the page's number ---------------------------
_ROWS = """
links AS (
    SELECT lang, page_id, unnest(range(1, len(hrefs) + 1)) AS pos, hrefs, texts, origin
    FROM (SELECT regexp_extract(url, '^https?://[^/]*/([^/]*)', 1) AS lang, page_id, regexp_extract(url, '^https?://[^/?#]*') AS origin,
        regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS texts FROM pages)
), a AS (
    SELECT lang, page_id, pos, texts[pos] AS text, 'https://www.example.com' || hrefs[pos] AS url, hrefs[pos] AS kind FROM links WHERE starts_with(hrefs[pos], '/') AND NOT regexp_matches(hrefs[pos], '[?#&;]|//|/\\.')
    UNION ALL SELECT lang, page_id, 100, 'no ' || page_id, 'https://www.example.com/' || lang || '/?_jsfn=goView&_jsid=' || (page_id // 2), 'js:goView' FROM links WHERE pos = 1
)"""


@query(f"""
WITH {_ROWS},
ok AS (SELECT * FROM a WHERE length(text) >= 2),
k AS (SELECT lang, kind, count(DISTINCT url) / count(DISTINCT page_id) AS score FROM ok GROUP BY ALL)
SELECT lang AS page, page_id AS row, url, substr(text, 1, 200) AS title, score FROM ok JOIN k USING (lang, kind) QUALIFY row_number() OVER (PARTITION BY lang, page_id ORDER BY score DESC, length(text) DESC, pos) = 1
""")
def list_subjects(spark, d):
    (pages,) = tables(spark, d, "pages")
    lang = F.regexp_extract("url", "^https?://[^/]*/([^/]*)", 1)
    links = html.anchors(pages, "page_id", "html").filter(F.startswith("href", F.lit("/")) & ~F.col("href").rlike(r"[?#&;]|//|/\."))
    call = pages.filter(F.contains("html", F.lit("<a href="))).select("page_id", F.lit(100).alias("pos"), F.concat(F.lit("javascript:goView('"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("')")).alias("href"), F.concat(F.lit("no "), "page_id").alias("text"))
    rows = links.unionByName(call).join(pages.select("page_id", lang.alias("page")), "page_id")
    anchors = rows.select("page", F.lit(1).alias("block"), F.col("page_id").alias("row"), "pos", F.concat(F.lit("https://www.example.com/"), "page", F.lit("/")).alias("base"), "href", "text")
    return subjects.subjects(anchors).drop("block")


# -- profiles: a document's lines as Markdown by their first letters ---------------------------------------------------------------------------------
_MARKED = """CASE left(line, 1) WHEN 'A' THEN '## 보유 기술 ' || line WHEN 'E' THEN '## 연봉' WHEN 'O' THEN '## ' || line WHEN 'I' THEN ' - 보유 : ' || replace(line, ' ', ', ')
    WHEN 'T' THEN '- 일부:' || replace(line, ' ', ',') || '(memo, x), z ' WHEN 'S' THEN '- 현재: 4,' || length(line) || ' 만원' ELSE line END"""


@query(f"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
m AS (SELECT doc_id, pos, {_MARKED} AS line FROM l),
h AS (SELECT *, CASE WHEN starts_with(line, '## 보유 기술') THEN 's' WHEN starts_with(line, '## 연봉') THEN 'p' WHEN starts_with(line, '## ') THEN '-' END AS heading FROM m),
s AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '-') AS section FROM h),
t AS (
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (section = '-'), '') AS plain, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (section = 's' AND heading IS NULL), '') AS skills,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (section = 'p' AND heading IS NULL), '') AS pay FROM s GROUP BY doc_id
),
i AS (
    SELECT doc_id, name, string_agg(trim(item), '|' ORDER BY pos, place) AS items FROM (
        SELECT *, unnest(string_split(rest, ',')) AS item, generate_subscripts(string_split(rest, ','), 1) AS place FROM (
            SELECT doc_id, pos, regexp_extract(line, '^\\s*-\\s*(보유|일부)\\s*:', 1) AS name, regexp_replace(regexp_extract(line, '^\\s*-\\s*(?:보유|일부)\\s*:\\s*(.+)', 1), '\\([^)]*\\)', '', 'g') AS rest
            FROM s WHERE section = 's' AND heading IS NULL)) WHERE name <> '' AND trim(item) <> '' GROUP BY ALL
)
SELECT doc_id AS doc, substr(sha1(regexp_replace(plain, '^\\s+|\\s+$', '', 'g') || chr(10)), 1, 12) AS text_hash, substr(sha1(regexp_replace(skills, '^\\s+|\\s+$', '', 'g')), 1, 12) AS skills_hash,
    coalesce(a.items, '') AS has, coalesce(b.items, '') AS partial, TRY_CAST(replace(regexp_extract(pay, '현재\\s*:\\s*([\\d,]+)\\s*만', 1), ',', '') AS INTEGER) AS salary
FROM t LEFT JOIN (FROM i WHERE name = '보유') AS a USING (doc_id) LEFT JOIN (FROM i WHERE name = '일부') AS b USING (doc_id)
""")
def profiles(spark, d):
    (docs,) = tables(spark, d, "documents")
    x, first = F.col("line"), F.substring("line", 1, 1)
    marked = F.when(first == "A", F.concat(F.lit("## 보유 기술 "), x)).when(first == "E", F.lit("## 연봉")).when(first == "O", F.concat(F.lit("## "), x)).when(first == "I", F.concat(F.lit(" - 보유 : "), F.replace(x, F.lit(" "), F.lit(", "))))
    marked = marked.when(first == "T", F.concat(F.lit("- 일부:"), F.replace(x, F.lit(" "), F.lit(",")), F.lit("(memo, x), z "))).when(first == "S", F.concat(F.lit("- 현재: 4,"), F.length(x), F.lit(" 만원"))).otherwise(x)
    found = profile.profiles(profile.lines_of(docs, "doc_id", "text").withColumn("line", marked))
    return found.select("doc", "text_hash", "skills_hash", F.array_join("has", "|").alias("has"), F.array_join("partial", "|").alias("partial"), "salary")


# -- companies ------------------------------------------------------------------------------------------------------------------------------------------
@query("""
SELECT s_suppkey AS company, CASE WHEN s_nationkey < 20 THEN 1900 + s_nationkey END AS founded_year, CASE WHEN s_nationkey >= 5 THEN 1000 + s_suppkey END::INTEGER AS employees,
    CASE WHEN s_nationkey >= 10 THEN s_suppkey + 0.5 END::DOUBLE AS revenue_eok, CASE WHEN s_nationkey < 12 THEN 'large' ELSE 'small' END AS company_type
FROM supplier
""")
def company_pages(spark, d):
    (supplier,) = tables(spark, d, "supplier")
    nation, said = F.col("s_nationkey"), lambda *parts: F.concat(*(F.lit(p) if p[0] != "@" else F.col(p[1:]).cast("string") for p in parts))
    cell = lambda label, *value: said(f'<tr><th scope="row" class="a field-label">{label}</th>\n<td class="c"><div class="value big">', *value, "</div></td></tr>")
    card = lambda label, *value: said(f'<li>\n<span class="icnCorp01">{label}</span><p>', *value, "</p></li>")
    thousand = F.concat(F.lit('<tr><th class="field-label">사원수</th><td><b class="value"> '), F.format_number(F.col("s_suppkey") + 1000, 0), F.lit("명</b></td></tr>"))
    page = F.concat(
        F.lit("<h1>x</h1><table>"), F.when(nation < 20, F.concat(F.lit('<tr><th class="field-label">설립일</th><td><span class="value">19'), F.lpad(nation.cast("string"), 2, "0"), F.lit("년 <b>1월</b></span></td></tr>"))).otherwise(""),
        F.when(nation >= 5, thousand).otherwise(""), cell("기업구분", "small"), F.lit("</table><ul>"), F.when(nation >= 10, card("매출액", "@s_suppkey", "억 5,000만원</p><p>2020")).otherwise(""), card("기업구분", "middle"),
        F.when(nation < 12, card("기업형태", "large")).otherwise(""), F.when(nation >= 5, card("사원수", "7명")).otherwise(""), F.lit("</ul>"),
    )
    return companies.company_fields(companies.label_values(supplier.select("s_suppkey", page.alias("html")), "s_suppkey", "html"))


@query("""
WITH l AS (
    SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 1950 + c_nationkey END AS founded, CASE WHEN c_mktsegment < 'F' THEN 100 END AS lo, unnest(['(주)Group ' || right(c_name, 3), 'G-' || right(c_name, 2)]) AS said, unnest([0, 1]) AS variant
    FROM customer
), r AS (SELECT s_suppkey AS match, CASE WHEN s_acctbal >= 0 THEN 1950 + s_nationkey END AS founded, s_suppkey % 900 AS employees, lower(CASE WHEN s_nationkey < 12 THEN 'g' || right(s_name, 2) ELSE 'group' || right(s_name, 3) END) AS key FROM supplier),
t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY match) AS k FROM r QUALIFY k <= 4),
p AS (SELECT id, match, l.founded, t.founded AS its, lo, employees, min((variant, k)) AS place FROM l JOIN t ON lower(regexp_replace(replace(said, '(주)', ''), '[ -]', '', 'g')) = key GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY place, match) AS r FROM p QUALIFY r <= 4)
SELECT id, arg_min(match, r) AS match FROM n WHERE (employees = 0 OR lo IS NULL OR employees BETWEEN 100 / 3 AND 600) AND (coalesce(abs(its - founded) <= 1, false) OR n = 1 AND (its IS NULL OR founded IS NULL)) GROUP BY id
""")
def same_companies(spark, d):
    customer, supplier = tables(spark, d, "customer", "supplier")
    lo = F.when(F.col("c_mktsegment") < "F", 100)
    name = F.concat(F.lit("(주)Group "), F.right("c_name", F.lit(3)), F.lit(" (G-"), F.right("c_name", F.lit(2)), F.lit(")"))
    left = customer.select(F.col("c_custkey").alias("id"), name.alias("name"), F.when(F.col("c_acctbal") >= 0, 1950 + F.col("c_nationkey")).alias("founded"), lo.alias("least_employees"), (lo * 2).alias("most_employees"))
    label = F.when(F.col("s_nationkey") < 12, F.concat(F.lit("G."), F.right("s_name", F.lit(2)), F.lit(" (old)"))).otherwise(F.concat(F.lit("GROUP "), F.right("s_name", F.lit(3)), F.lit("(주)")))
    right = supplier.select(F.col("s_suppkey").alias("match"), label.alias("label"), F.when(F.col("s_acctbal") >= 0, 1950 + F.col("s_nationkey")).alias("founded"), (F.col("s_suppkey") % 900).alias("employees"), F.col("s_suppkey").alias("rank"))
    return companies.same_companies(left, right)


# -- places to fill: a line's words in the order that its length gives, some of which look like places themselves --------------------------------------------
@query("""
SELECT o_orderkey, '<p>[[[CONTENT-ELEMENT-1]]]' || o_orderstatus || '</p>' || o_orderpriority || '|' || o_custkey || '[[[CONTENT-ELEMENT-x]]]' AS body FROM orders
""")
def filled_places(spark, d):
    (orders,) = tables(spark, d, "orders")
    body = F.lit("<p>[[[CONTENT-ELEMENT-0]]]</p>[[[CONTENT-ELEMENT-1]]]|[[[CONTENT-ELEMENT-7]]][[[CONTENT-ELEMENT-12]]][[[CONTENT-ELEMENT-x]]]")
    contents = F.create_map(F.lit("0"), F.concat(F.lit("[[[CONTENT-ELEMENT-1]]]"), "o_orderstatus"), F.lit("1"), F.col("o_orderpriority"), F.lit("12"), F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", templates.filled(body, contents).alias("body"))
