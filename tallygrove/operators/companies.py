"""Company pages: labelled values of two layouts, merged and typed; and the same company in two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions.text import company_key, krw_eok, name_variants

# Labels of the two layouts.
FOUNDED, EMPLOYEES, REVENUE, KIND = "설립일", "사원수", "매출액", "기업구분"
SYNONYMS = {"기업형태": KIND}
LABEL = r'(?is)<th[^>]*class="[^"]*\bfield-label\b[^"]*"[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>'
VALUE = r'(?is)<(\w+)[^>]*class="[^"]*\bvalue\b[^"]*"[^>]*>(.*?)</\1>'
CARD = r'(?is)<li[^>]*>\s*<span[^>]*class="icnCorp[^"]*"[^>]*>(.*?)</span>(.*?)</li>'
PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"


def plain(x):
    """HTML as text with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def label_values(pages: DataFrame, company: str, html: str) -> DataFrame:
    """company, layout (0 table, 1 cards), pos, label, parts (array: the value's paragraphs) of every labelled value that is not empty."""

    def pairs(pattern):
        return F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))

    table = pages.select(F.col(company).alias("company"), F.lit(0).alias("layout"), F.posexplode(pairs(LABEL)).alias("pos", "x"))
    cards = pages.select(F.col(company).alias("company"), F.lit(1).alias("layout"), F.posexplode(pairs(CARD)).alias("pos", "x"))
    value = F.when(F.regexp_like("x.inner", F.lit(VALUE)), F.array(plain(F.regexp_extract("x.inner", VALUE, 2))))
    paragraphs = F.transform(F.regexp_extract_all("x.inner", F.lit(PARAGRAPH), F.lit(1)), plain)
    rows = table.withColumn("parts", value).unionByName(cards.withColumn("parts", paragraphs))
    return rows.filter(F.size("parts") > 0).select("company", "layout", "pos", plain(F.col("x.label")).alias("label"), "parts")


def company_fields(cells: DataFrame) -> DataFrame:
    """company, founded_year, employees, revenue_eok, company_type.

    A table's values come before those of cards, of which the first counts; a label that is another one's synonym overrides that one. A value's first part counts,
    all of them for the date of founding. cells: those of label_values(). One grouped maximum a field, so the cells of a company never meet as rows.
    """
    renamed = F.col("label").isin(list(SYNONYMS))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in SYNONYMS.items() for v in pair]), F.col("label")), F.col("label"))
    value = F.when(F.col("label") == FOUNDED, F.array_join("parts", " ")).otherwise(F.get("parts", F.lit(0)))
    card = F.col("layout") == 1
    order = F.when(card & renamed, F.struct(F.lit(3).alias("a"), F.col("pos").alias("b"))).when(~card, F.struct(F.lit(2).alias("a"), F.col("pos").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), (-F.col("pos")).alias("b")))
    rows = cells.select("company", F.when(card, name).otherwise(F.col("label")).alias("field"), value.alias("value"), order.alias("o"))
    best = lambda label: F.max_by(F.when(F.col("field") == label, F.col("value")), F.when(F.col("field") == label, F.col("o")))
    fields = rows.groupBy("company").agg(best(FOUNDED).alias("founded"), best(EMPLOYEES).alias("employees"), best(REVENUE).alias("revenue"), best(KIND).alias("company_type"))
    number = lambda c, p: F.replace(F.regexp_extract(c, p, 1), F.lit(",")).try_cast("int")
    return fields.select("company", number("founded", r"(\d{4})").alias("founded_year"), number("employees", r"([\d,]+)").alias("employees"), krw_eok("revenue").alias("revenue_eok"), "company_type")


def same_companies(left: DataFrame, right: DataFrame, *, most: int = 4, years: int = 1) -> DataFrame:
    """id, match: for companies of one source the same company in another one, where that is sure.

    left: id, name, founded, least_employees, most_employees (null: any); right: match, label, founded, employees, rank (order of search results).
    A label answers a name if its key without parentheses is that of one of the name's variants; of a key the first most labels by rank are looked at, of a name the
    first most by variant and rank. One is taken if its employees fit and it was founded within years of the name's year, or if it is the only one and a year is
    missing. What a name finds depends on its keys alone, so each distinct list of keys is looked up once, and of it a company gets a list of most labels at most.
    """
    keyed = right.filter("label IS NOT NULL").withColumn("key", company_key(F.regexp_replace("label", r"\([^)]*\)", ""))).filter("key <> ''")
    w = W.partitionBy("key").orderBy("rank", "match")
    found = keyed.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("key", "k", "match", "founded", "employees")
    names = left.withColumn("keys", F.array_distinct(F.transform(name_variants("name"), company_key))).drop("name").filter(F.size("keys") > 0)
    asked = names.select("keys").distinct().select("keys", F.posexplode("keys").alias("variant", "key"))
    each = asked.join(found, "key").groupBy("keys", "match").agg(F.min(F.struct("variant", "k", "match", "founded", "employees")).alias("label"))
    lists = each.groupBy("keys").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("label")), 1, most).alias("labels"))
    met = names.join(lists, "keys")
    fits = lambda x: F.coalesce((F.coalesce(x["employees"], F.lit(0)) == 0) | F.col("least_employees").isNull() | x["employees"].between(F.col("least_employees") / 3, F.col("most_employees") * 3), F.lit(True))
    near = lambda x: F.coalesce(F.abs(x["founded"] - F.col("founded")) <= years, F.lit(False))
    alone = lambda x: (F.col("n") == 1) & (x["founded"].isNull() | F.col("founded").isNull())
    taken = met.select("id", F.get(F.filter("labels", lambda x: fits(x) & (near(x) | alone(x))), F.lit(0)).alias("label")).filter("label IS NOT NULL")
    return taken.groupBy("id").agg(F.min_by("label.match", F.struct("label.variant", "label.k")).alias("match"))
