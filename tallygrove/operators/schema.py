"""What a JSON list API looks like, learned from its answers: where the list is, which fields are id and title, and the URLs of pages and details.

Answers are VARIANT values, so no schema is given: lists are found by exploding two levels of keys, and fields by exploding the objects of the list
that was taken. All counts are grouped sums over exploded rows; only names and counts meet, never whole answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import urls
from tallygrove.functions.text import col

# Field names that hold ids and titles, best first.
ID_FIELDS = ["id", "jobId", "job_id", "postId", "post_id", "seq", "no", "num", "key", "code", "uid", "pk", "wr_id", "articleId"]
TITLE_FIELDS = ["title", "jobTitle", "job_title", "name", "subject", "wr_subject", "headline", "position", "role"]


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _children(rows: DataFrame, value: str, *keep: str) -> DataFrame:
    """keep, pos, key, value: the fields or elements of a variant column."""
    inner = rows.sparkSession.tvf.variant_explode(F.col(value).outer()).toDF("child_pos", "child_key", "child")
    return rows.select(*keep, value).lateralJoin(inner).select(*keep, F.col("child_pos").alias("pos"), F.col("child_key").alias("key"), F.col("child").alias("value"))


def object_lists(answers: DataFrame) -> DataFrame:
    """call, path, value, n of the lists of nothing but objects, in the answer itself or one or two keys deep. answers: call, value (a variant)."""
    root = answers.select("call", F.lit("").alias("path"), "value")
    objects = lambda rows: rows.filter(_kind(F.col("value")) == "OBJECT")
    one = _children(objects(root), "value", "call").select("call", F.col("key").alias("path"), "value")
    two = _children(objects(one), "value", "call", "path").select("call", F.concat_ws(".", "path", "key").alias("path"), "value")
    lists = root.unionByName(one).unionByName(two).filter(_kind(F.col("value")) == "ARRAY")
    elements = F.try_variant_get("value", "$", "array<variant>")
    return lists.filter((F.size(elements) > 0) & F.forall(elements, lambda e: F.coalesce(_kind(e) == "OBJECT", F.lit(False)))).withColumn("n", F.size(elements))


def _field(support: str, names: list[str]) -> Column:
    """The first of names that is in a map of fields with enough values."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, names)), lambda c: F.array_contains(support, c)), F.lit(1))


def list_schemas(calls: DataFrame, *, site: str = "site", url: str = "url", body: str = "body", order: str = "ordinal", detail: str = "detail_url", least: int = 2) -> DataFrame:
    """site, url, list_path, n, id_field, title_field, first_id, base_url, api_template, size_param, detail_template of the sites whose lists can be read.

    The longest list of objects of a site is taken, least objects or more; of equal ones that of the earliest call, then the least path. A field
    counts if the list's first object has it and half of the objects (rounded down) have a value in it: not null, an empty text, zero or
    false. detail: a known URL of the first object, in which its id is replaced; may be null. Answers that are no JSON have no list.
    """
    keyed = calls.select(col(site).alias("site"), col(url).alias("url"), col(order).alias("call"), col(detail).alias("detail"), F.try_parse_json(body).alias("value")).filter("value IS NOT NULL")
    lists = object_lists(keyed.select(F.struct("site", "call").alias("call"), "value")).filter(F.col("n") >= least)
    best = lists.groupBy("call.site").agg(F.min_by(F.struct("call", "path", "n"), F.struct((-F.col("n")).alias("n"), "call.call", "path")).alias("b")).select("b.*")
    taken = lists.join(best.select("call", "path"), ["call", "path"])
    fields = _children(_children(taken, "value", "call", "n").withColumnRenamed("pos", "row"), "value", "call", "n", "row")
    filled = ~F.coalesce(F.try_variant_get("value", "$", "string"), F.lit("")).isin("", "0", "0.0", "false")
    known = fields.filter(F.col("key").isin(ID_FIELDS + TITLE_FIELDS)).groupBy("call", "n", "key").agg(F.count_if(filled).alias("filled"), F.max(F.when(F.col("row") == 0, F.struct(F.try_variant_get("value", "$", "string").alias("v")))).alias("first"))
    enough = known.filter(F.col("first").isNotNull() & (F.col("filled") >= F.floor(F.col("n") / 2)))
    read = enough.groupBy("call").agg(F.collect_list("key").alias("keys"), F.map_from_entries(F.collect_list(F.struct("key", F.col("first.v")))).alias("first"))
    named = read.select("call", "first", _field("keys", ID_FIELDS).alias("id_field"), _field("keys", TITLE_FIELDS).alias("title_field")).dropna(subset=["id_field", "title_field"])
    rows = keyed.select(F.struct("site", "call").alias("call"), "url", "detail").join(best.join(named, "call"), "call")
    first_id = F.try_element_at("first", F.col("id_field"))
    return rows.select(
        "call.site", "url", F.col("path").alias("list_path"), F.col("n").cast("long").alias("n"), "id_field", "title_field", first_id.alias("first_id"), F.regexp_replace("url", r"\?[^#]*", "").alias("base_url"),
        urls.page_template("url").alias("api_template"), F.when(F.contains("url", F.lit("size=")), "size").alias("size_param"), urls.detail_template("detail", first_id).alias("detail_template"),
    )


def list_items(answers: DataFrame, *, body: str, path: str, id_field: str, title_field: str, keep: list[str]) -> DataFrame:
    """keep, pos, id, title: the objects of each answer's list, read by the schema in its own row."""
    at = lambda value, p: F.try_variant_get(value, F.concat(F.lit("$"), p), "variant")
    place = F.when(F.col(path) == "", "").otherwise(F.concat(F.lit("."), F.col(path)))
    lists = answers.select(*keep, id_field, title_field, at(F.try_parse_json(body), place).alias("value"))
    rows = _children(lists, "value", *keep, id_field, title_field)
    text = lambda name: F.try_variant_get("value", F.concat(F.lit("$."), F.col(name)), "string")
    return rows.select(*keep, "pos", text(id_field).alias("id"), text(title_field).alias("title"))
