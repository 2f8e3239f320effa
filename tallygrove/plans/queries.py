"""Registered queries: each operator on the driver's tables. orders stand for postings, lineitem for skills, part for the skill dimension,
customer for companies, nation and region for places, events for run logs, pages for crawled pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import postings, scores, text, urls
from tallygrove.operators import aggregates, batches, cutoff, joins, ordering, updates, windows
from tallygrove.sources import html
from tallygrove.sources.landing import json_path, tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Open postings by place: count, mean value, and share of the shown places' largest."""
    orders, customer, nation, region = tables(spark, d, "orders", "customer", "nation", "region")
    rows = orders.filter("o_orderstatus = 'O'").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query
def match_reason(spark, d):
    (docs,) = tables(spark, d, "documents")
    words = F.size(F.split("text", " "))
    passed, reason = text.matched_reason("text", F.col("lang") == "de", (words / 100).cast("int"), words, exclude="License", include="the|les|und", min_to=60)
    return docs.select("doc_id", passed.alias("passed"), reason.alias("reason"))


@query
def top_reasons(spark, d):
    return match_reason(spark, d).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query
def analyzable_filter(spark, d):
    docs, labels = tables(spark, d, "documents", "labels")
    return docs.join(labels, "doc_id", "left").filter(F.col("quality").isNotNull() | (F.length(F.coalesce("text", F.lit(""))) >= 2000)).select("doc_id", "quality")


@query
def open_status_counts(spark, d):
    (orders,) = tables(spark, d, "orders")
    return orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).alias("n_high"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("n_urgent"), F.count("*").alias("n_all"))


@query
def count_with_total(spark, d):
    (orders,) = tables(spark, d, "orders")
    return aggregates.count_with_total(orders, "o_orderpriority")


@query
def default_counts(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    high = orders.filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return aggregates.default_counts(high, "c_custkey", customer)


@query
def semi_in_subquery(spark, d):
    orders, lines = tables(spark, d, "orders", "lineitem")
    return orders.join(lines.filter("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query
def anti_left_join(spark, d):
    orders, lines = tables(spark, d, "orders", "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query
def null_aware_not_in(spark, d):
    orders, lines = tables(spark, d, "orders", "lineitem")
    keys = lines.select(F.nullif("l_orderkey", F.lit(-1)).alias("k"))
    return joins.null_aware_not_in(orders, "o_orderkey", keys, "k").select("o_orderkey")


@query
def four_way_left_join(spark, d):
    orders, customer, nation, region = tables(spark, d, "orders", "customer", "nation", "region")
    known = customer.filter("c_acctbal > 0")
    rows = orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query
def stale_or_missing(spark, d):
    events, customer = tables(spark, d, "events", "customer")
    return joins.missing_or_stale(customer.withColumnRenamed("c_custkey", "user_id"), "user_id", events, "ts", "2024-02-15 00:00:00", 17)


@query
def latest_per_key(spark, d):
    (events,) = tables(spark, d, "events")
    return windows.latest_per_key(events.filter("event_type <> 'view'"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query
def keep_first_ordinal(spark, d):
    (talk,) = tables(spark, d, "conversations")
    return windows.keep_first(talk, ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn")


@query
def canonical_form(spark, d):
    (part,) = tables(spark, d, "part")
    return aggregates.canonical_form(part, text.label_key("p_brand"), "p_name", "p_partkey")


@query
def exploded_frequency(spark, d):
    lines, part, orders = tables(spark, d, "lineitem", "part", "orders")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.distinct_frequency(rows, "l_orderkey", text.label_key("p_type"), orders.withColumnRenamed("o_orderkey", "l_orderkey"))


@query
def solo_element(spark, d):
    lines, part = tables(spark, d, "lineitem", "part")
    return aggregates.solo_items(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_type")


@query
def histogram10(spark, d):
    (events,) = tables(spark, d, "events")
    return events.groupBy(scores.histogram_bin("value").alias("bin")).agg(F.count("*").alias("n"))


@query
def fingerprint(spark, d):
    orders, lines, customer, part, events = tables(spark, d, "orders", "lineitem", "customer", "part", "events")
    return aggregates.fingerprint([(orders, F.max("o_orderkey")), (lines, F.count("*")), (customer, F.sum("c_custkey")), (part, F.max("p_size")), (events.filter("value < 0"), F.max("event_id"))])


@query
def crossfilter_counts(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    picks = {"o_orderstatus": F.col("o_orderstatus") == "O", "c_mktsegment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "o_orderpriority": F.col("o_orderpriority") != "5-LOW", "price": F.col("o_totalprice") > 100000}
    return aggregates.cross_filter(rows, picks, ["o_orderstatus", "c_mktsegment", "o_orderpriority"])


@query
def weighted_recommendation(spark, d):
    (customer,) = tables(spark, d, "customer")
    parts = {"depth": scores.from_five(F.col("c_custkey") % 5 + 1), "pay": F.when(F.col("c_acctbal") > 0, F.least(F.lit(100.0), F.col("c_acctbal") / 100)), "size": F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey") * 4)}
    return customer.select("c_custkey", scores.weighted_mean(parts, scores.WEIGHTS).alias("rec"))


def _credits(part):
    kind = F.col("p_size") % 4
    return part.select(F.col("p_partkey").alias("l_partkey"), F.when(kind == 0, 1.0).when(kind == 1, 0.5).when(kind == 2, 0.0).alias("credit"))


@query
def coverage_score(spark, d):
    lines, part = tables(spark, d, "lineitem", "part")
    return aggregates.coverage(lines, "l_orderkey", "l_partkey", _credits(part))


@query
def gap_list(spark, d):
    lines, part = tables(spark, d, "lineitem", "part")
    return aggregates.gap_list(lines, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"], _credits(part))


@query
def combined_fit(spark, d):
    scope = F.col("o_orderkey") % 101
    return coverage_score(spark, d).withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", scores.combined_fit(scope, "score").alias("fit"))


@query
def rescore_changed(spark, d):
    (lines,) = tables(spark, d, "lineitem")
    totals = lambda tax: lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_tax") > tax).alias("hits"), F.nullif(F.count_if(F.col("l_discount") > tax), F.lit(0)).alias("cuts"))
    return updates.changed_only(totals(0.02), totals(0.05), "l_orderkey", ["hits", "cuts"])


@query
def greedy_dedupe(spark, d):
    (part,) = tables(spark, d, "part")
    rows = part.select("p_partkey", text.company_key("p_brand").alias("company"), text.title_key("p_name").alias("title"), (F.length("p_type") % 3).alias("priority"))
    return windows.greedy_dedupe(rows, id_col="p_partkey", company="company", title="title", priority="priority", similar=text.same_title, parts=text.title_parts, priorities=[0, 1, 2])


@query
def containment_pairs(spark, d):
    """Customers half of whose bulk parts another customer buys in bulk too."""
    lines, orders, customer = tables(spark, d, "lineitem", "orders", "customer")
    bought = lines.filter("l_quantity >= 46").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joins.containment(bought.select(F.col("c_custkey").alias("owner"), F.col("l_partkey").alias("item")).distinct(), "owner", "item", 0.5)


def _sightings(events):
    """Sources list pages of five ids; even ids are known already."""
    order = W.partitionBy("event_type").orderBy("event_id")
    rows = events.select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.floor((F.row_number().over(order) - 1) / 5).cast("int").alias("page"))
    return rows, rows.filter("id % 2 = 0 OR page > 20").select("source", "id").distinct()


@query
def incremental_stop(spark, d):
    (events,) = tables(spark, d, "events")
    rows, known = _sightings(events)
    return cutoff.stop_page(cutoff.page_facts(rows, known, source="source", page="page", key="id"), known, source="source", page="page")


@query
def barren_stop(spark, d):
    (events,) = tables(spark, d, "events")
    rows, known = _sightings(events)
    return cutoff.stop_after_barren(cutoff.page_facts(rows, known, source="source", page="page", key="id"), source="source", page="page", short=3)


@query
def incremental_anti(spark, d):
    (orders,) = tables(spark, d, "orders")
    old, new = orders.filter("o_orderdate < TIMESTAMP_NTZ '1993-01-01'"), orders.filter("o_orderdate >= TIMESTAMP_NTZ '1993-01-01'")
    return updates.incremental(new, old, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query
def vanish_guard(spark, d):
    (customer,) = tables(spark, d, "customer")
    rows = customer.select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("id"))
    return updates.vanished(rows, rows.filter("id % (2 + source % 2) <> 0 AND source % 4 <> 3"), "id", "source")


@query
def upsert_snapshot(spark, d):
    (orders,) = tables(spark, d, "orders")
    old = orders.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = orders.filter("o_orderdate >= TIMESTAMP_NTZ '1994-01-01'").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("o_orderpriority"))
    return updates.upsert(old, new, ["o_orderkey"], overwrite=["o_orderstatus"], coalesced=["o_totalprice"], insert_only=["o_orderpriority"])


@query
def replace_and_insert(spark, d):
    (part,) = tables(spark, d, "part")
    old, new = part.filter("p_size > 10").select("p_partkey", "p_size"), part.filter("p_type = 'ECONOMY'").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return updates.insert_missing(updates.replace_rows(old, new, ["p_partkey"]), part.select("p_partkey", F.lit(-1).alias("p_size")), ["p_partkey"])


@query
def hash_upsert_class(spark, d):
    (orders,) = tables(spark, d, "orders")
    old = orders.filter("o_orderkey % 5 <> 0")
    new = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return updates.hash_classes(old, new, "o_orderkey", ["o_totalprice", "o_orderstatus"]).groupBy("class").agg(F.count("*").alias("n"))


@query
def orphan_close(spark, d):
    (events,) = tables(spark, d, "events")
    runs = events.select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("ts")).alias("ended"))
    return updates.close_orphans(runs, started="ts", ended="ended", as_of="2024-01-30 00:00:00", minutes=30).select("event_id", "age_minutes")


@query
def stale_lock(spark, d):
    (events,) = tables(spark, d, "events")
    age = F.timestamp_diff("MINUTE", F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-20 12:00:00")))
    running = events.filter((F.col("event_type") == "error") & age.between(0, 59)).groupBy("user_id").agg(F.max("event_id").alias("run"))
    return running


@query
def failure_streak(spark, d):
    (events,) = tables(spark, d, "events")
    return windows.failure_streak(events, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view", "click"))


@query
def site_state(spark, d):
    return windows.site_state(failure_streak(spark, d), 3, 7)


@query
def cumulative_total(spark, d):
    (orders,) = tables(spark, d, "orders")
    rows = orders.select("o_custkey", "o_orderkey", F.length("o_orderpriority").alias("added"))
    return windows.cumulative(rows, "o_custkey", ["o_orderkey"], "added")


@query
def page_slice(spark, d):
    (orders,) = tables(spark, d, "orders")
    return ordering.page_slice(orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 100)


@query
def case_insensitive_sort(spark, d):
    (part,) = tables(spark, d, "part")
    return part.select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey")).alias("place"))


@query
def status_rank_sort(spark, d):
    (orders,) = tables(spark, d, "orders")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(ordering.rank_of("o_orderstatus", ["O", "P"]), F.desc("o_totalprice"), "o_orderkey"))
    return orders.select("o_orderkey", place.alias("place"))


@query
def top_n_tiebreak(spark, d):
    (part,) = tables(spark, d, "part")
    return ordering.top_n(part.select("p_partkey", "p_size"), "p_size", "p_partkey", 25)


@query
def limit_or_all(spark, d):
    (nation,) = tables(spark, d, "nation")
    return ordering.limit_or_all(nation, -1).select("n_nationkey", "n_name")


@query
def top_k_per_group(spark, d):
    (part,) = tables(spark, d, "part")
    return ordering.top_k_per_group(part, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "place")


@query
def shares_of_top(spark, d):
    (part,) = tables(spark, d, "part")
    return aggregates.shares_of_top(part, "p_brand", 8)


@query
def union_keep_first(spark, d):
    customer, orders = tables(spark, d, "customer", "orders")
    a, b = customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit(0).alias("precedence")), orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.lit(1).alias("precedence"))
    return windows.keep_first(a.unionByName(b), ["id"], ["precedence"])


@query
def except_intersect(spark, d):
    customer, orders = tables(spark, d, "customer", "orders")
    a, b = customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id")), orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return a.exceptAll(b.distinct()).withColumn("side", F.lit("only_a")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query
def subset_test(spark, d):
    (events,) = tables(spark, d, "events")
    kinds = events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 80, F.col("event_type"))).alias("high"), F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("low"))
    return kinds.select("user_id", (F.size(F.array_except("low", "high")) == 0).alias("is_subset"), F.size(F.array_intersect("low", "high")).alias("shared"))


@query
def text_keys(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.select("doc_id", text.label_key("text").alias("label"), text.company_key("text").alias("company"), text.title_key("text").alias("title"))


@query
def contacts(spark, d):
    (docs,) = tables(spark, d, "documents")
    found = docs.select("doc_id", F.posexplode(text.emails("text")).alias("p", "email"))
    return found.select("doc_id", (F.col("p") + 1).alias("pos"), "email")


@query
def external_id(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", urls.external_id("url").alias("external_id"))


@query
def site_ids(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", urls.host("url").alias("host"), urls.site_id("url").alias("site_id"), urls.registrable("url").alias("registrable"), urls.detail_prefix("url").alias("prefix"))


@query
def url_params(spark, d):
    (pages,) = tables(spark, d, "pages")
    rows = pages.select("page_id", F.posexplode(urls.params("url")).alias("p", "pair"))
    return rows.select("page_id", (F.col("p") + 1).alias("pos"), "pair.name", "pair.value")


@query
def url_pattern(spark, d):
    (pages,) = tables(spark, d, "pages")
    return pages.select("page_id", urls.url_pattern("url").alias("pattern"), urls.sort_or_page_only("url").alias("sort_only"))


@query
def anchor_extract(spark, d):
    (pages,) = tables(spark, d, "pages")
    return html.anchors(pages, "page_id", "html").select("page_id", "pos", "href")


@query
def anchor_fingerprint_stats(spark, d):
    rows = anchor_extract(spark, d)
    return rows.groupBy(urls.anchor_fingerprint("href").alias("fingerprint")).agg(F.count("*").alias("n"), F.count_distinct("href").alias("n_urls"), F.count_distinct("page_id").alias("n_pages"))


@query
def list_quality(spark, d):
    (pages,) = tables(spark, d, "pages")
    rows = html.anchors(pages, "page_id", "html")
    metrics = aggregates.list_quality(rows, "page_id", is_link=F.length("href") > 1, is_hit=postings.is_job_title("text"), is_event=postings.is_event("text"), to_parent=F.col("href") == "/", is_external=F.startswith("href", F.lit("http")), path_pattern=F.regexp_replace("href", r"\d+", "{N}"))
    return aggregates.list_verdict(metrics).select("page_id", "list_rows", "title_hits", F.round("path_ratio", 6).alias("path_ratio"), "reason")


@query
def repeating_blocks(spark, d):
    (pages,) = tables(spark, d, "pages")
    return html.repeating_blocks(pages, "page_id", "html", skipped=frozenset())  # these pages have lists in their navigation only


@query
def html_detail(spark, d):
    (pages,) = tables(spark, d, "pages")
    return html.details(pages, "page_id", "html")


@query
def json_extract_props(spark, d):
    (events,) = tables(spark, d, "events")
    return events.select("event_id", json_path("props", "k", "bigint").alias("k"))


@query
def profile_hash(spark, d):
    (docs,) = tables(spark, d, "documents")
    return docs.select("doc_id", text.short_hash("text").alias("hash"))


@query
def company_scores(spark, d):
    (customer,) = tables(spark, d, "customer")
    k = F.col("c_custkey")
    tags = F.array(F.concat(F.lit("연봉 상위 "), (k % 30 + 1).cast("string"), F.lit("%")), F.when(k % 3 == 0, "설립 10년 이상").when(k % 3 == 1, "누적투자 100억").otherwise("인원 급성장"), F.when(k % 4 == 0, "51~300명").otherwise("자유복장"))
    score = scores.company_scores(tags, F.lit(None).cast("int"), F.when(k % 5 == 0, (k * 7 % 6000).cast("int")), F.col("c_acctbal") / 10, F.when(k % 2 == 0, F.col("c_acctbal")), F.when(k % 7 == 0, (k % 50 - 20).cast("double")), F.when(k % 11 == 0, "대기업"), 2026)
    return customer.select("c_custkey", score.alias("s")).select("c_custkey", "s.size", "s.pay", "s.stability", "s.revenue", F.size("s.welfare").alias("n_welfare"))


@query
def entity_match(spark, d):
    customer, supplier = tables(spark, d, "customer", "supplier")
    keys = {"left_key": "c_custkey", "right_key": "s_suppkey", "left_group": "c_nationkey", "right_group": "s_nationkey", "left_value": "c_acctbal", "right_value": "s_acctbal"}
    return joins.entity_match(customer, supplier, **keys, within=500)


@query
def recheck_average(spark, d):
    docs, labels = tables(spark, d, "documents", "labels")
    rows = docs.select("doc_id", (F.col("doc_id") % 101).cast("int").alias("a")).join(labels.select("doc_id", (60 + F.col("quality") * 15 + F.col("toxic")).alias("b")), "doc_id", "left")
    return rows.select("doc_id", windows.recheck_average(rows, "a", "b").alias("fit"))


@query
def batch_ids(spark, d):
    (docs,) = tables(spark, d, "documents")
    return batches.batch_ids(docs, "source", ["doc_id"], 6).select("doc_id", "batch_id")


@query
def coverage_deficit(spark, d):
    orders, lines = tables(spark, d, "orders", "lineitem")
    loaded = lines.groupBy("l_orderkey").agg(F.count("*").alias("loaded"))
    rows = orders.select("o_orderkey", (F.col("o_orderkey") % 7).alias("target")).join(loaded, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    short = F.greatest(F.lit(0), F.col("target") - F.coalesce("loaded", F.lit(0)))
    return rows.select("o_orderkey", short.alias("deficit"), F.when(F.col("loaded").isNull(), "nothing loaded").when(short > 0, "partial").otherwise("complete").alias("reason"))


@query
def duplicates_attached(spark, d):
    (part,) = tables(spark, d, "part")
    found = greedy_dedupe(spark, d).filter("dup_of IS NOT NULL").select(F.col("dup_of").alias("p_partkey"), F.col("id").alias("copy"))
    return joins.attach_many(part.select("p_partkey"), found, "p_partkey", ["copy"], "copies").select("p_partkey", F.array_join(F.transform("copies", lambda c: c["copy"].cast("string")), ",").alias("copies"))


@query
def rename_and_remove(spark, d):
    orders, customer = tables(spark, d, "orders", "customer")
    both = {"orders": (orders, "o_custkey"), "customer": (customer, "c_custkey")}
    gone = customer.filter("c_nationkey = 3")
    kept = updates.without_keys(updates_pairs(updates.renamed_key(both, "7", "999999"), both), gone, "c_custkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in kept.items()]
    return reduce(DataFrame.unionByName, counts)


def updates_pairs(renamed: dict[str, DataFrame], original: dict) -> dict:
    return {name: (df, original[name][1]) for name, df in renamed.items()}


@query
def rollup_report(spark, d):
    (events,) = tables(spark, d, "events")
    failed = F.col("event_type") == "error"
    return events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"), F.round(F.sum(F.when(~failed, F.col("value"))), 4).alias("total"), F.max("event_id").alias("last"))
