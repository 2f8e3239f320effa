"""Where results go: appended tables, text, JSON documents, messages, and content-addressed media."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def as_json(columns: list[str]) -> Column:
    """A row as JSON that may stand inside a script element."""
    return F.replace(F.to_json(F.struct(*columns)), F.lit("</"), F.lit("<\\/"))


def message(df: DataFrame, line: Column, order: list[str], lines: int = 60, chars: int = 3500) -> DataFrame:
    """One text of the first lines in order, cut to chars; only lines rows are gathered."""
    few = df.select(line.alias("line"), *order).orderBy(*order).limit(lines)
    return few.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n"), 1, chars).alias("text"))


def aligned(*parts: tuple[Column, int], between: str = " | ") -> Column:
    """A report line: every part (text, width) filled up with blanks to its width, longer ones as they are; width 0 fills nothing."""
    return F.concat_ws(between, *[F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c) if width else c for c, width in parts])


def replace_document(document: DataFrame, path: str) -> None:
    """The one text column of a document (few rows) as a file at path: written beside it, then put in its place by one rename, so a reader meets the old or the new one."""
    spark, beside = document.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    document.coalesce(1).write.text(beside)
    fs = spark._jvm.org.apache.hadoop.fs
    store = fs.Path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in store.listStatus(fs.Path(beside)) if f.getPath().getName().startswith("part-")]
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(fs.Path(beside).toUri(), spark._jsc.hadoopConfiguration()).rename(part, fs.Path(path), options)
    store.delete(fs.Path(beside), True)


def media_keys(files: DataFrame, site: str, content: str, ext: str, limit: int = 20 << 20) -> DataFrame:
    """site, sha256, path, size of distinct contents up to limit bytes; path is site, two digits of the hash, hash and extension."""
    rows = files.filter(F.octet_length(content) <= limit).withColumn("sha256", F.sha2(content, 256))
    first = rows.groupBy(site, "sha256").agg(F.min(ext).alias(ext), F.first(F.octet_length(content)).alias("size"))
    return first.select(site, "sha256", F.concat_ws("/", site, F.substring("sha256", 1, 2), F.concat("sha256", F.lit("."), ext)).alias("path"), "size")
