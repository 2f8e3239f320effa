"""The registered queries of the numbered operators: thin, over the whole of their tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import bpe_sql, doubling, langid, licenses, linededup, packing, quality, runindex, simhash, spelling, warc, webp, whitening
from tallygrove.llm.common import table


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_sql.encode_decode(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(table(spark, sf_dir, "documents"), passages=51, anchor=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.report(table(spark, sf_dir, "documents"))
