"""A training corpus from documents: quality rules, line dedup, near-duplicates, long repeats, and packing into sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), and what it returns is written and reread as the next one's docs. All but the last
return the columns of documents, with n_chars as it is after the stage. When a stage begins, the intermediate tables of the one before are removed.

Defined cases: rows of null or empty text fail the quality rules and go; null doc_ids, null languages and null in other columns are kept as they
are, and of rows that a stage takes for copies one stays; an empty table passes all stages as one; columns beyond those of documents are carried along, whatever
their names; a table whose rows all go gives no sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import linededup, packing, quality, runindex, simhash
from tallygrove.llm.common import discard, next_stage, own_folder, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    next_stage(spark, docs)
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    next_stage(spark, docs)
    return _counted(linededup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    next_stage(spark, docs)
    return simhash.keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    next_stage(spark, docs)
    return _counted(runindex.clean(docs, words=51, anchor=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    next_stage(spark, docs)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeat_dedup), ("packing", pack)]

ORACLE_SQL = None  # Kneser-Ney scores, XXH64 fingerprints and BPE ids are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs, before, folder = table(spark, sf_dir, "documents"), None, f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
