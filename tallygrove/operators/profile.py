"""A profile in Markdown, read from its lines: text for a model, and sections that only code reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions.text import col

# Headings of the sections for code, and the names of their items.
SKILLS, SALARY = "## 보유 기술", "## 연봉"
HAS, PARTIAL, CURRENT = "보유", "일부", "현재"
EDGES = r"^\s+|\s+$"


def placed(lines: DataFrame, *, doc: str = "doc_id", pos: str = "pos", line: str = "line", headings: tuple[str, ...] = (SKILLS, SALARY)) -> DataFrame:
    """doc, pos, line, section: the heading of a section for code that a line is in (as given, the first that its heading line begins with), or null.

    Headings of such sections have a null line; other headings end them and are text. The state is carried over a document's ordered lines by a window, so a
    document's lines meet in one task, and documents are spread.
    """
    x = F.col(line)
    named = F.lit("")
    for h in reversed(headings):
        named = F.when(F.startswith(x, F.lit(h)), h).otherwise(named)
    heading = F.when(F.startswith(x, F.lit("## ")), named)
    state = F.last_value("heading", ignoreNulls=True).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), x.alias("line"), heading.alias("heading")).withColumn("section", F.nullif(F.coalesce(state, F.lit("")), F.lit("")))
    return rows.select("doc", "pos", F.when(F.coalesce(F.col("heading"), F.lit("")) == "", F.col("line")).alias("line"), "section")


def _item(line: Column, name: str) -> Column:
    """The parts of a line "- name: a, b (note)" without notes; an empty array for other lines."""
    rest = F.regexp_extract(line, rf"^\s*-\s*{name}\s*:\s*(.+)", 1)
    return F.filter(F.transform(F.split(F.regexp_replace(rest, r"\([^)]*\)", ""), ","), lambda p: F.regexp_replace(p, EDGES, "")), lambda p: p != "")


def profiles(lines: DataFrame, **columns: str) -> DataFrame:
    """doc, text, text_hash, skills_hash, has, partial, salary: the model's text (trimmed, one line end), 12 digits of SHA-1 of it and of the skills section,
    the skills held and held in part in order, and the current yearly pay in units of 10^4 (null if not given)."""
    rows = placed(lines, **columns)
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep & F.col("line").isNotNull(), F.struct("pos", "line")))), lambda r: r["line"]), "\n")
    skills = F.col("section") == SKILLS
    texts = rows.groupBy("doc").agg(joined(F.col("section").isNull()).alias("plain"), joined(skills).alias("skills"), joined(F.col("section") == SALARY).alias("pay"))
    parts = lambda name: F.flatten(F.transform(F.split("skills", "\n"), lambda x: _item(x, name)))
    text = F.concat(F.regexp_replace("plain", EDGES, ""), F.lit("\n"))
    amount = F.replace(F.regexp_extract("pay", rf"{CURRENT}\s*:\s*([\d,]+)\s*만", 1), F.lit(","))
    return texts.select("doc", text.alias("text"), F.substring(F.sha1(text), 1, 12).alias("text_hash"), F.substring(F.sha1(F.regexp_replace("skills", EDGES, "")), 1, 12).alias("skills_hash"), parts(HAS).alias("has"), parts(PARTIAL).alias("partial"), F.nullif(amount, F.lit("")).try_cast("int").alias("salary"))


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, pos (from 0), line of the lines of texts."""
    return docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(col(text), "\n", -1)).alias("pos", "line"))
