"""Queries of posting states, labels, links and table maintenance on the driver's tables, each with its DuckDB SQL. orders stand for postings, customer for companies,
part for labels, events for run logs, pages for crawled pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import postings as P
from tallygrove.functions import templates, text, urls
from tallygrove.operators import ordering, updates, windows
from tallygrove.sources import html
from tallygrove.sources.landing import site_urls, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _like(column: str, words: list[str]) -> str:
    return f"coalesce(regexp_matches({column}, '(?i){'|'.join(words)}'), false)"


_DUE = "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END"


@query(f"""SELECT o_orderkey, coalesce(due < TIMESTAMP '1997-06-01', due IS NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate < TIMESTAMP '1997-05-02 12:00:00') AS expired
FROM (SELECT *, {_DUE} AS due FROM orders)""")
def expired_postings(spark, d):
    (orders,) = tables(spark, d, "orders")
    rows = orders.withColumn("due", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return rows.select("o_orderkey", P.is_expired("due", "o_orderpriority", F.col("o_orderdate"), "1997-06-01 12:00:00", ["1-URGENT", "2-HIGH"]).alias("expired"))


@query(f"""SELECT o_orderkey, o_totalprice >= 250000 AND coalesce(nullif(o_orderpriority, '5-LOW'), '') <> '1-URGENT' AND (due IS NULL OR due::DATE > DATE '1997-06-01') AS refit
FROM (SELECT *, {_DUE} AS due FROM orders)""")
def refit_targets(spark, d):
    (orders,) = tables(spark, d, "orders")
    rows = orders.withColumn("due", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).withColumn("hash", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return rows.select("o_orderkey", P.needs_refit("o_totalprice", "hash", "1-URGENT", "due", "1997-06-01", 250000).alias("refit"))


@query(f"SELECT doc_id, {_like('text', P.JOB_WORDS)} AS job, {_like('text', P.EVENT_WORDS)} AS event FROM documents")
def title_words(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.select("doc_id", P.is_job_title("text").alias("job"), P.is_event("text").alias("event"))


@query(f"SELECT page_id, coalesce(regexp_matches(u, '{'|'.join(P.DETAIL_URLS)}'), false) AS detail FROM (SELECT page_id, replace(url, '/en/', '/view/') AS u FROM pages)")
def detail_urls(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", P.is_detail_url(F.replace("url", F.lit("/en/"), F.lit("/view/"))).alias("detail"))


@query(f"""SELECT turn_id, CASE WHEN label = 'unknown' AND length(trim(text)) BETWEEN 1 AND 20 AND regexp_matches(text, '(?i){'|'.join(P.MENU_WORDS)}') THEN 'filtered' ELSE label END AS label
FROM (SELECT c_custkey AS turn_id, CASE WHEN c_acctbal < 3000 THEN 'unknown' ELSE 'full' END AS label, CASE c_mktsegment WHEN 'BUILDING' THEN ' Our Jobs ' WHEN 'MACHINERY' THEN '채용정보'
WHEN 'FURNITURE' THEN 'Careers and much more than that' WHEN 'HOUSEHOLD' THEN '' ELSE 'Jobsite' END AS text FROM customer)""")
def label_override(spark, d):
    (customer,) = tables(spark, d, "customer")
    names = {"BUILDING": " Our Jobs ", "MACHINERY": "채용정보", "FURNITURE": "Careers and much more than that", "HOUSEHOLD": ""}
    text = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in names.items()], F.lit("Jobsite"))
    label = F.when(F.col("c_acctbal") < 3000, "unknown").otherwise("full")
    return customer.select(F.col("c_custkey").alias("turn_id"), P.overridden_label(label, text).alias("label"))


@query("""SELECT p_partkey, coalesce(p_type = 'ECONOMY' AND trim(p_name) <> '' AND NOT regexp_matches(p_name, 'cold|old') AND regexp_matches(p_name, 'widget|gear'), false) AS wanted FROM part""")
def menu_filter(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select("p_partkey", P.menu_wanted("p_type", "p_name", "widget|gear", "cold|old", board="ECONOMY").alias("wanted"))


_STUCK = "CASE WHEN length(text) % 5 >= 3 THEN 'unreadable' WHEN length(text) % 7 = 0 THEN 'no_content' ELSE 'too_little_text' END"


@query(f"""SELECT doc_id, {_STUCK} AS reason FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND length(text) < 2000 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def stuck_postings(spark, d):
    docs, labels = tables(spark, d, "documents", "labels")
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") < 2000)).join(labels, "doc_id", "left_anti")
    return rows.select("doc_id", P.stuck_reason(F.length("text") % 5, F.length("text") % 7).alias("reason"))


@query("""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CASE WHEN ts::DATE <> DATE '2024-01-30' THEN 'not_today' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'done'
WHEN event_type = 'signup' OR floor(epoch(TIMESTAMP '2024-01-30 23:59:00')) - floor(epoch(ts)) > 3600 THEN 'stalled' ELSE 'running' END AS state FROM l""")
def run_states(spark, d):
    (events,) = tables(spark, d, "events")
    last = windows.latest_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    kind = F.col("event_type")
    return last.select("user_id", P.run_state("ts", "ts", kind == "purchase", kind == "error", kind != "signup", "2024-01-30 23:59:00", stall_minutes=60).alias("state"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'purchase') = 0 AS failed FROM events GROUP BY 1""")
def failed_steps(spark, d):
    (events,) = tables(spark, d, "events")
    counts = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("processed"))
    return counts.select("user_id", P.step_failed("errors", "processed").alias("failed"))


@query("""SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) < 1500 AND len(regexp_extract_all(html, '<img')) = 0 AS is_empty FROM pages""")
def empty_details(spark, d):
    (pages,) = tables(spark, d, "pages")
    images = F.size(F.regexp_extract_all("html", F.lit("(<img)"), F.lit(1)))
    return pages.select("page_id", P.is_empty_detail(F.regexp_replace("html", "<[^>]*>", ""), images, shortest=1500).alias("is_empty"))


@query("""SELECT c_custkey, CASE WHEN coalesce(t, '') <> '' OR coalesce(r, '') <> '' THEN concat_ws(chr(10), 'tasks: ' || nullif(t, ''), 'needs: ' || nullif(r, ''), 'more: ' || c_name) ELSE 'body ' || c_name END AS text
FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN nullif(c_mktsegment, 'BUILDING') END AS t, CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 9 THEN 'n' || c_nationkey END AS r FROM customer)""")
def assembled_text(spark, d):
    (customer,) = tables(spark, d, "customer")
    tasks = F.when(F.col("c_acctbal") > 0, F.nullif("c_mktsegment", F.lit("BUILDING")))
    needs = F.when(F.col("c_nationkey") < 5, "").when(F.col("c_nationkey") < 9, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return customer.select("c_custkey", P.assembled({"tasks": tasks, "needs": needs, "more": F.col("c_name")}, F.concat(F.lit("body "), F.col("c_name"))).alias("text"))


_NAVIGATION = "CASE length(text) % 3 WHEN 0 THEN ' 이전글 다음글  목록 ' WHEN 1 THEN chr(10) || 'Share ' || '댓글 12 ×' ELSE ' 목록 end' END"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text || {_NAVIGATION}, '(?i)(\s*({'|'.join(P.TRAILING_NAVIGATION)})\s*)+$', ''), '\s+$', '') AS text FROM documents""")
def trailing_navigation(spark, d):
    (docs,) = tables(spark, d, "documents")
    kind = F.length("text") % 3
    tail = F.when(kind == 0, " 이전글 다음글  목록 ").when(kind == 1, "\nShare 댓글 12 ×").otherwise(" 목록 end")
    return docs.select("doc_id", P.without_trailing_navigation(F.concat("text", tail)).alias("text"))


_CAREER = "CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '4' END"


@query(f"""SELECT c_custkey, CASE k WHEN '1' THEN 0 WHEN '2' THEN CASE WHEN y < 100 THEN y ELSE 1 END WHEN '3' THEN 0 WHEN '4' THEN 0 END AS lo, CASE WHEN k = '1' THEN 0 WHEN k IS NOT NULL THEN 100 END AS hi
FROM (SELECT c_custkey, {_CAREER} AS k, CASE WHEN c_nationkey <> 4 THEN c_nationkey * 9 END AS y FROM customer)""")
def career_years(spark, d):
    (customer,) = tables(spark, d, "customer")
    codes = {"BUILDING": "1", "MACHINERY": "2", "FURNITURE": "3", "HOUSEHOLD": "4"}
    kind = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in codes.items()])
    years = P.career_years(kind, F.when(F.col("c_nationkey") != 4, F.col("c_nationkey") * 9))
    return customer.select("c_custkey", years["lo"].alias("lo"), years["hi"].alias("hi"))


@query("""SELECT c_custkey, CASE WHEN lo IS NULL THEN '' WHEN hi = 100 THEN CASE WHEN lo = 0 THEN '경력무관' ELSE '경력 ' || lo || '년↑' END WHEN lo = 0 THEN CASE WHEN hi = 0 THEN '신입' ELSE '신입~' || hi || '년' END
ELSE '경력 ' || lo || '~' || hi || '년' END AS label FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey // 4 END AS lo, CASE WHEN c_mktsegment = 'BUILDING' THEN 100 WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE c_nationkey END AS hi FROM customer)""")
def years_labels(spark, d):
    (customer,) = tables(spark, d, "customer")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    rows = customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor(nation / 4)).alias("lo"), F.when(segment == "BUILDING", 100).when(segment == "MACHINERY", 0).otherwise(nation).alias("hi"))
    return rows.select("c_custkey", P.years_label("lo", "hi").alias("label"))


@query("""SELECT c_custkey, nullif(concat_ws(' ', CASE WHEN regexp_matches(code, '^\\p{L}') AND code[1] <> 'Q' THEN CASE code[1] WHEN 'I' THEN '서울' WHEN 'B' THEN '경기' WHEN 'K' THEN '인천' WHEN 'R' THEN '해외' ELSE '지방' END END,
nullif(array_to_string(string_split(places, ',')[1:2], ' '), '')), '') AS place FROM (SELECT c_custkey, CASE WHEN c_nationkey < 4 THEN c_nationkey || 'x' WHEN c_nationkey = 7 THEN 'Q1' WHEN c_nationkey = 8 THEN 'R9' ELSE c_mktsegment END AS code,
CASE WHEN c_acctbal > 5000 THEN 'a,b,c' WHEN c_acctbal > 0 THEN 'one' ELSE '' END AS places FROM customer)""")
def area_labels(spark, d):
    (customer,) = tables(spark, d, "customer")
    nation, money = F.col("c_nationkey"), F.col("c_acctbal")
    code = F.when(nation < 4, F.concat(nation.cast("string"), F.lit("x"))).when(nation == 7, "Q1").when(nation == 8, "R9").otherwise(F.col("c_mktsegment"))
    return customer.select("c_custkey", P.area_label(code, F.when(money > 5000, "a,b,c").when(money > 0, "one").otherwise("")).alias("place"))


@query("""SELECT o_orderkey, CASE WHEN t < '2060' THEN t END AS due, strftime(o_orderdate, '%m/%d') || ' (' || ['월', '화', '수', '목', '금', '토', '일'][isodow(o_orderdate)] || ')' AS day,
CASE WHEN m >= 60 THEN m // 60 || '시간 ' || m % 60 || '분' ELSE m || '분' END AS took FROM (SELECT *, strftime(o_orderdate + CASE WHEN o_totalprice > 200000 THEN INTERVAL 64 YEAR ELSE INTERVAL 0 YEAR END, '%Y-%m-%d') AS t,
floor(o_totalprice / 1000)::BIGINT AS m FROM orders)""")
def due_day_duration(spark, d):
    (orders,) = tables(spark, d, "orders")
    text = F.date_format(F.when(F.col("o_totalprice") > 200000, F.add_months("o_orderdate", 768)).otherwise(F.to_date("o_orderdate")), "yyyy-MM-dd 00:00")
    return orders.select("o_orderkey", P.clean_due(text).alias("due"), P.day_label("o_orderdate").alias("day"), P.duration_label(F.floor(F.col("o_totalprice") / 1000)).alias("took"))


@query("""SELECT c_nationkey, n, repeat('▓', b) || repeat('░', 10 - b) AS bar FROM (SELECT c_nationkey, count(*) AS n, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*) * 10, 0)::INTEGER AS b
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)""")
def progress_bars(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    counts = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return counts.select("c_nationkey", "n", P.progress_bar(F.col("done") / F.col("n")).alias("bar"))


@query("""SELECT user_id, CASE WHEN pages > 1 THEN array_to_string(list_sort(list_distinct(list_filter([0, pages - 1, cur - 2, cur - 1, cur, cur + 1, cur + 2], lambda p: p >= 0 AND p < pages))), ',') ELSE '' END AS numbers
FROM (SELECT user_id, ceil(count(*) / 5)::BIGINT AS pages, count(*) % 7 AS cur FROM events GROUP BY 1)""")
def page_number_lists(spark, d):
    (events,) = tables(spark, d, "events")
    rows = events.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.ceil(F.col("n") / 5).cast("int").alias("pages"), (F.col("n") % 7).cast("int").alias("cur"))
    return rows.select("user_id", F.array_join(P.page_numbers("cur", "pages").cast("array<string>"), ",").alias("numbers"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_rows(spark, d):
    (events,) = tables(spark, d, "events")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(seg, '') DESC, coalesce(rec, -1) DESC, c_custkey DESC)::INTEGER AS place
FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rec FROM customer)""")
def multi_key_sort(spark, d):
    (customer,) = tables(spark, d, "customer")
    segment, score = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("")), F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(-1.0))
    return customer.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(segment.desc(), score.desc(), F.desc("c_custkey"))).alias("place"))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal < 0) DESC, CASE WHEN c_acctbal < 0 THEN 0 ELSE floor(c_acctbal / 1000) END DESC, c_name)::INTEGER AS place FROM customer""")
def failed_first(spark, d):
    (customer,) = tables(spark, d, "customer")
    failed = F.col("c_acctbal") < 0
    return customer.select("c_custkey", F.row_number().over(W.partitionBy("c_nationkey").orderBy(failed.desc(), F.when(failed, 0).otherwise(F.floor(F.col("c_acctbal") / 1000)).desc(), "c_name")).alias("place"))


@query("""SELECT p_brand, array_to_string(list(p_name ORDER BY p_retailprice DESC, p_partkey)[1:3], ',') AS shown, greatest(0, count(*) - 3) AS more FROM part GROUP BY 1""")
def first_three_and_more(spark, d):
    (part,) = tables(spark, d, "part")
    return ordering.first_and_more(part, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], "p_name", 3)


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS best FROM lineitem WHERE l_discount < 0.08 GROUP BY 1""")
def best_container(spark, d):
    (lines,) = tables(spark, d, "lineitem")
    return lines.filter("l_discount < 0.08").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("best"))


@query("""SELECT user_id, count(*) FILTER (ts::DATE >= DATE '2024-01-30' - 7) AS recent, max(ts)::DATE::VARCHAR AS newest FROM events GROUP BY 1""")
def days_ago_cut(spark, d):
    (events,) = tables(spark, d, "events")
    return events.groupBy("user_id").agg(F.count_if(F.to_date("ts") >= F.date_sub(F.to_date(F.lit("2024-01-30")), 7)).alias("recent"), F.to_date(F.max("ts")).cast("string").alias("newest"))


@query("""SELECT c_custkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS tags
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN [c_mktsegment] ELSE [c_mktsegment, 'paid'] END AS a, CASE WHEN c_nationkey < 9 THEN ['BUILDING', 'near'] ELSE ['paid', 'far'] END AS b FROM customer)""")
def ordered_union(spark, d):
    (customer,) = tables(spark, d, "customer")
    old = F.when(F.col("c_acctbal") < 0, F.array("c_mktsegment")).otherwise(F.array(F.col("c_mktsegment"), F.lit("paid")))
    new = F.when(F.col("c_nationkey") < 9, F.array(F.lit("BUILDING"), F.lit("near"))).otherwise(F.array(F.lit("paid"), F.lit("far")))
    return customer.select("c_custkey", F.array_join(F.array_union(old, new), ",").alias("tags"))


_LABELS = "SELECT p_partkey, CASE WHEN p_size > 20 THEN 'have' ELSE 'lack' END AS verdict, p_size > 40 AS pinned, CASE WHEN p_size > 10 THEN 'h' END AS hash FROM part WHERE p_size > 5"
_PINS = "SELECT p_partkey AS k, CASE WHEN p_retailprice < 905 THEN 'auto' ELSE 'partial' END AS v FROM part WHERE p_retailprice < 910 OR p_size <= 7"


@query(f"""SELECT coalesce(p_partkey, k) AS p_partkey, CASE WHEN v <> 'auto' THEN v ELSE verdict END AS verdict, CASE WHEN v <> 'auto' THEN true WHEN v = 'auto' THEN false ELSE pinned END AS pinned, CASE WHEN v = 'auto' THEN NULL ELSE hash END AS hash
FROM ({_LABELS}) FULL JOIN ({_PINS}) ON p_partkey = k WHERE p_partkey IS NOT NULL OR v <> 'auto'""")
def pinned_labels(spark, d):
    (part,) = tables(spark, d, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    labels = part.filter(size > 5).select("p_partkey", F.when(size > 20, "have").otherwise("lack").alias("verdict"), (size > 40).alias("pinned"), F.when(size > 10, "h").alias("hash"))
    pins = part.filter((price < 910) | (size <= 7)).select("p_partkey", F.when(price < 905, "auto").otherwise("partial").alias("verdict"))
    return updates.pin_labels(labels, pins, "p_partkey")


@query("""SELECT o_orderkey, CASE WHEN f THEN coalesce(n, 0) + 1 ELSE n END AS fails, CASE WHEN f THEN CASE WHEN coalesce(n, 0) + 1 >= 3 THEN TIMESTAMP '1998-01-01' END ELSE o_orderdate END::VARCHAR AS tried
FROM (SELECT *, o_orderstatus = 'F' AS f, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS n FROM orders)""")
def counted_failures(spark, d):
    (orders,) = tables(spark, d, "orders")
    fails = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3))])
    rows = orders.select("o_orderkey", "o_orderstatus", fails.alias("fails"), F.col("o_orderdate").cast("timestamp_ntz").alias("tried"))
    return updates.count_failure(rows, F.col("o_orderstatus") == "F", "fails", "tried", "1998-01-01 00:00:00").select("o_orderkey", "fails", F.date_format("tried", "yyyy-MM-dd HH:mm:ss").alias("tried"))


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, NULL::INTEGER AS fails, 'active' AS status FROM nation""")
def migrated_schema(spark, d):
    (nation,) = tables(spark, d, "nation")
    return updates.migrated(nation, {"n_nationkey": "string", "n_name": "string", "fails": "int", "status": "string"}, {"status": "active"})


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN coalesce(t, TIMESTAMP '1998-08-01') ELSE t END::VARCHAR AS notified FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS t FROM orders)""")
def notified_marks(spark, d):
    (orders,) = tables(spark, d, "orders")
    rows = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate").cast("timestamp_ntz")).alias("notified"))
    marked = updates.mark_notified(rows, orders.filter("o_totalprice > 400000"), "o_orderkey", "notified", "1998-08-01 00:00:00")
    return marked.select("o_orderkey", F.date_format("notified", "yyyy-MM-dd HH:mm:ss").alias("notified"))


@query(r"""SELECT page_id, nullif(left(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g'), 80), '') AS title FROM pages""")
def page_titles(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", P.page_title("html").alias("title"))


@query("""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h, unnest(range(1, len(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) + 1)) AS p FROM pages),
y AS (SELECT page_id, h, min(p) AS p FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(p)) <= 20)
SELECT page_id, coalesce(string_agg(h, ' ' ORDER BY p), '') AS found FROM pages LEFT JOIN y USING (page_id) GROUP BY 1""")
def html_scan(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", F.array_join(P.scan_html("html", 'href="(/[^"]*)"'), " ").alias("found"))


@query("""WITH p AS (SELECT page_id, string_split_regex(html, 'href="(/[^"]+)"') AS between, regexp_extract_all(html, 'href="(/[^"]+)"', 1) AS found FROM pages)
SELECT page_id, sha1(array_to_string(list_transform(range(1, len(between) + 1), lambda i: between[i] || coalesce('href="/media/' || sha1(found[i]) || '"', '')), '')) AS digest FROM p""")
def local_media_html(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", F.sha1(templates.local_media("html", 'href="(/[^"]+)"', "/media/")).alias("digest"))


@query("SELECT event_id, coalesce((props::JSON ->> '$.total')::BIGINT, (props::JSON ->> '$.k')::BIGINT) AS total FROM events")
def json_total(spark, d):
    (events,) = tables(spark, d, "events")
    return events.select("event_id", P.first_number("props", ["$.total", "$.totalCount", "$.k"]).alias("total"))


_PAGE = "(CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&])page=[^&#]*', '\\1page={page}') WHEN contains(url, '?') THEN url || '&page={page}' ELSE url || '?page={page}' END)"


@query(f"""SELECT page_id, regexp_replace({_PAGE}, '([?&])utm_source=[^&#]*', '\\1utm_source={{size}}') AS page, CASE WHEN seg <> '' THEN replace(url, seg, '{{id}}') END AS detail
FROM (SELECT *, regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1) AS seg FROM pages)""")
def url_templates(spark, d):
    (pages,) = tables(spark, d, "pages")
    known = F.regexp_extract("url", r"/(\d+)(?:[?#]|$)", 1)
    return pages.select("page_id", urls.page_template("url", size="utm_source").alias("page"), urls.detail_template("url", known).alias("detail"))


@query("""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages), r AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_replace(url, '[?#].*$', '') AS page FROM h)
SELECT page_id, href, CASE WHEN href = '' OR href = '#' OR regexp_matches(href, '^(mailto|tel):') THEN NULL WHEN regexp_matches(href, '^https?:') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z+.-]*:') THEN NULL
WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href WHEN starts_with(href, '?') THEN page || href ELSE origin || regexp_replace(page[length(origin) + 1:], '[^/]*$', '') || href END AS resolved FROM r""")
def resolved_links(spark, d):
    (pages,) = tables(spark, d, "pages")
    rows = html.anchors(pages, "page_id", "html").join(pages.select("page_id", "url"), "page_id")
    return rows.select("page_id", "href", urls.resolve("url", "href").alias("resolved"))


@query("""SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?_jsfn=goView&_jsid=E' || page_id AS resolved FROM pages""")
def script_links(spark, d):
    (pages,) = tables(spark, d, "pages")
    call = F.concat(F.lit("javascript: javascript:goView('E"), F.col("page_id").cast("string"), F.lit("', '1')"))
    return pages.select("page_id", urls.resolve("url", call).alias("resolved"))


@query(rf"""WITH e AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{text.PHONE}'), lambda p: length(p) >= 9) AS found FROM documents), x AS (SELECT doc_id, unnest(found) AS phone, generate_subscripts(found, 1) AS p FROM e),
f AS (SELECT doc_id, phone, min(p) AS p FROM x GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INTEGER AS pos, phone FROM f QUALIFY pos <= 50""")
def phones(spark, d):
    (docs,) = tables(spark, d, "documents")
    found = docs.select("doc_id", F.posexplode(text.phones("text")).alias("p", "phone"))
    return found.select("doc_id", (F.col("p") + 1).alias("pos"), "phone")


@query("""SELECT c_custkey, lo::INTEGER AS lo, CASE WHEN k <> 4 THEN hi END::INTEGER AS hi FROM (SELECT *, CASE k WHEN 1 THEN n WHEN 2 THEN n * 12 WHEN 3 THEN least(n, 10000 + n) WHEN 4 THEN n END AS lo, CASE k WHEN 1 THEN n + 500 WHEN 2 THEN n * 12 WHEN 3 THEN 10000 + n END AS hi
FROM (SELECT c_custkey, 1000 + c_nationkey * 100 AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS k FROM customer))""")
def salary_ranges(spark, d):
    (customer,) = tables(spark, d, "customer")
    n = 1000 + F.col("c_nationkey") * 100
    shown, segment = F.format_number(n, 0), F.col("c_mktsegment")
    raw = (
        F.when(segment == "BUILDING", F.concat(shown, F.lit("만원 ~ "), (n + 500).cast("string"), F.lit("만 원"))).when(segment == "MACHINERY", F.concat(F.lit("월 급여 "), shown, F.lit("만원, 식대 20만")))
        .when(segment == "FURNITURE", F.concat(shown, F.lit("만원부터 1억 "), shown, F.lit("만원"))).when(segment == "HOUSEHOLD", F.concat(shown, F.lit("만원 이상"))).otherwise("회사 내규")
    )
    pay = text.salary_range(raw)
    return customer.select("c_custkey", pay["lo"].alias("lo"), pay["hi"].alias("hi"))


@query("SELECT printf('%-12s %6d', c_mktsegment, count(*)) AS line FROM customer GROUP BY c_mktsegment")
def report_lines(spark, d):
    (customer,) = tables(spark, d, "customer")
    return customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.format_string("%-12s %6d", "c_mktsegment", "n").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 AND p_type IN ('ECONOMY', 'STANDARD') THEN p_type ELSE 'unknown' END AS label, CASE WHEN p_partkey % 5 < 4 THEN p_name ELSE '' END AS reason FROM part")
def answer_shapes(spark, d):
    """Every part is answered in one of four shapes, or by malformed text."""
    (part,) = tables(spark, d, "part")
    url, k = F.concat(F.lit("u"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 5
    body = [F.col("p_type").alias("label"), F.col("p_name").alias("reason")]
    entry = F.struct(url.alias("url"), *body)
    raw = (
        F.when(k == 0, F.to_json(F.array(entry))).when(k == 1, F.to_json(F.struct(F.lit(1).alias("n"), F.array(entry).alias("results")))).when(k == 2, F.to_json(entry))
        .when(k == 3, F.to_json(F.create_map(url, F.struct(*body)))).otherwise('{"url": ')
    )
    return part.withColumn("raw", raw).withColumn("url", url).withColumn("got", P.answered("raw", "url", ["ECONOMY", "STANDARD"])).select("p_partkey", "got.label", "got.reason")


@query("""SELECT n_regionkey::BIGINT AS site, arg_min('https://r' || n_regionkey || '/n' || n_nationkey || '/list-' || lower(c_mktsegment) || '-' || c_custkey, (n_nationkey, c_custkey)) AS url
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_mktsegment""")
def sitemap_lists(spark, d):
    """A site for each region: its sitemap names one for each nation, which names a list page, a single post and an escaped path for each customer."""
    customer, nation, region = tables(spark, d, "customer", "nation", "region")
    base = lambda c: F.concat(F.lit("https://r"), F.col(c).cast("string"))
    loc = lambda x: F.concat(F.lit("<loc> "), x, F.lit("</loc>"))
    root = F.when(F.col("r_regionkey") == 0, "/sitemap.xml").otherwise("/sitemap-main.xml")
    robots = region.select(F.col("r_regionkey").cast("long").alias("site"), base("r_regionkey").alias("base"), F.when(F.col("r_regionkey") > 0, F.concat(F.lit("User-agent: *\nsitemap: "), base("r_regionkey"), root)).alias("text"))
    inner = F.concat(base("n_regionkey"), F.lit("/sitemap-"), F.col("n_nationkey").cast("string"), F.lit(".xml"))
    joined = lambda: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "loc"))), lambda x: x["loc"]))
    tops = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(base("r_regionkey"), root).alias("url"), F.col("n_nationkey").alias("at"), loc(inner).alias("loc"))
    key = F.col("c_custkey").cast("string")
    folder = F.concat(base("n_regionkey"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    three = F.concat(loc(F.concat(base("n_regionkey"), F.lit("/view/"), key)), loc(F.concat(base("n_regionkey"), F.lit("/%EC/"), key)), loc(F.concat(folder, F.lit("/list-"), F.lower("c_mktsegment"), F.lit("-"), key)))
    leaves = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(inner.alias("url"), F.col("c_custkey").alias("at"), three.alias("loc"))
    return site_urls(robots, tops.unionByName(leaves).groupBy("url").agg(joined().alias("text")))
