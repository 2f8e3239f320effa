"""Snapshots after upserts, closings and other table maintenance: a full outer join makes each new snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], *, overwrite: list[str], coalesced: list[str] = (), insert_only: list[str] = ()) -> DataFrame:
    """overwrite columns take the new value wherever the key came, null too; coalesced ones only if it is not null; insert_only ones never change."""
    a, b = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = a.join(b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    pick = {k: F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")) for k in key}
    pick |= {c: F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
    pick |= {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in coalesced}
    pick |= {c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in insert_only}
    return joined.select(*[v.alias(k) for k, v in pick.items()])


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def hash_classes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, class: inserted, updated or unchanged, for every new row."""
    a = new.select(key, row_hash(columns).alias("__new"))
    b = old.select(F.col(key).alias("__key"), row_hash(columns).alias("__old"))
    kind = F.when(F.col("__key").isNull(), "inserted").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("updated")
    return a.join(b, F.col(key) == F.col("__key"), "left").select(key, kind.alias("class"))


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Whole rows replaced by key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def vanished(open_rows: DataFrame, seen: DataFrame, key: str, source: str, share: float = 0.5) -> DataFrame:
    """Open rows of a source that its full listing did not show, if it showed share or more as many rows as are open."""
    before = open_rows.groupBy(source).agg(F.count("*").alias("__open"))
    shown = seen.groupBy(source).agg(F.count("*").alias("__shown"))
    trusted = before.join(shown, source).filter(F.col("__shown") >= share * F.col("__open")).select(source)
    return open_rows.join(trusted, source, "left_semi").join(seen.select(source, key), [source, key], "left_anti")


def _orphaned(started: str, ended: str, as_of: str, minutes: int) -> Column:
    age = F.to_timestamp(F.lit(as_of)).cast("double") - F.col(started).cast("timestamp").cast("double")
    return F.col(ended).isNull() & (age > 60 * minutes)


def close_orphans(runs: DataFrame, *, started: str, ended: str, as_of: str, minutes: int) -> DataFrame:
    """Runs without an end that began more than so many minutes ago, with their age in whole ones."""
    age = F.timestamp_diff("MINUTE", F.col(started).cast("timestamp"), F.to_timestamp(F.lit(as_of)))
    return runs.filter(_orphaned(started, ended, as_of, minutes)).withColumn("age_minutes", age)


def orphans_closed(runs: DataFrame, *, started: str, ended: str, result: str, error: str, as_of: str, minutes: int, note: str = " [orphan: process killed before finish]") -> DataFrame:
    """All runs, of which those that close_orphans() finds end now as failed, with a note after their error text."""
    dead = F.coalesce(_orphaned(started, ended, as_of, minutes), F.lit(False))
    return runs.withColumns({
        ended: F.when(dead, F.to_timestamp(F.lit(as_of)).cast(runs.schema[ended].dataType)).otherwise(F.col(ended)), result: F.when(dead, "failed").otherwise(F.col(result)),
        error: F.when(dead, F.concat(F.coalesce(error, F.lit("")), F.lit(note))).otherwise(F.col(error)),
    })


def changed_only(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that differ from the old ones in any of the columns, nulls compared as values."""
    a, b = new.alias("n"), old.alias("o")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns]
    differs = ~same[0]
    for s in same[1:]:
        differs = differs | ~s
    return a.join(b, F.col(f"n.{key}") == F.col(f"o.{key}")).filter(differs).select("n.*")


def renamed_key(tables: dict[str, tuple[DataFrame, str]], old: str, new: str) -> dict[str, DataFrame]:
    """The tables with one key renamed wherever it occurs."""
    return {name: df.withColumn(c, F.when(F.col(c) == old, new).otherwise(F.col(c))) for name, (df, c) in tables.items()}


def without_keys(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """A cascade: every table without the keys that go."""
    return {name: df.join(gone.select(F.col(key).alias(c)), c, "left_anti") for name, (df, c) in tables.items()}


def incremental(new: DataFrame, old: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """New rows whose key the table does not have, the first of each."""
    from tallygrove.operators.windows import keep_first

    return keep_first(new.join(old.select(*key), key, "left_anti"), key, ordinal)


def pin_labels(labels: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """Labels (key, verdict, pinned, hash) after pins (key, verdict): a verdict is set and pinned, new keys too; auto frees a known label for the next classification."""
    wanted = pins.select(F.col(key).alias("__k"), F.col("verdict").alias("__v"))
    both = labels.join(wanted, F.col(key) == F.col("__k"), "full").filter(F.col(key).isNotNull() | (F.col("__v") != "auto"))
    free, fixed = F.col("__v") == "auto", F.col("__v").isNotNull() & (F.col("__v") != "auto")
    return both.select(
        F.coalesce(key, "__k").alias(key), F.when(fixed, F.col("__v")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(fixed, True).when(free, False).otherwise(F.col("pinned")).alias("pinned"), F.when(free, None).otherwise(F.col("hash")).alias("hash"),
    )


def count_failure(df: DataFrame, failed: Column, count: str, given_up: str, as_of: str, most: int = 3) -> DataFrame:
    """One failure more where failed; given_up is the time from the most-th on, else null, and as it was in other rows."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    more = F.coalesce(F.col(count), F.lit(0)) + 1
    return df.withColumn(given_up, F.when(failed, F.when(more >= most, now)).otherwise(F.col(given_up))).withColumn(count, F.when(failed, more).otherwise(F.col(count)))


def migrated(df: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The rows under a newer schema: columns it lacks come with their default (else null), others are cast; columns beyond it go."""
    made = {c: F.col(c) if c in df.columns else F.lit((defaults or {}).get(c)) for c in columns}
    return df.select(*[made[c].cast(kind).alias(c) for c, kind in columns.items()])


def violations(df: DataFrame, checks: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that break a constraint, with the sorted names of those in column violated. As in SQL, a check of unknown value holds, and keys with a null are unique.
    Keys are counted by a partial aggregate, and only repeated ones meet the rows again."""
    broken = df.withColumn("violated", F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~c, F.lit(name)) for name, c in checks.items()])))
    for name, key in (unique or {}).items():
        twice = df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1").withColumn("__again", F.lit(name)).drop("__n")
        broken = broken.join(twice, key, "left").withColumn("violated", F.array_compact(F.array_append("violated", F.col("__again")))).drop("__again")
    return broken.withColumn("violated", F.array_sort("violated")).filter(F.size("violated") > 0).select(*df.columns, "violated")


def rebuilt(df: DataFrame, path: str, columns: dict[str, str], *, defaults: dict[str, object] | None = None, checks: dict[str, Column] | None = None, unique: dict[str, list[str]] | None = None) -> DataFrame:
    """The table at path made anew under other columns and constraints: written beside it, checked, and put in its place; if a row breaks a constraint, ValueError, and path is as it was."""
    spark = df.sparkSession
    beside, aside = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    migrated(df, columns, defaults).write.parquet(beside)
    made = spark.read.parquet(beside)
    bad = violations(made, checks or {}, unique).groupBy("violated").agg(F.count("*").alias("n")).select(F.to_json(F.struct("violated", "n"))).orderBy("to_json(struct(violated, n))").limit(10).collect()
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if bad:
        store.delete(at(beside), True)
        raise ValueError(f"constraints are broken: {', '.join(r[0] for r in bad)}")
    if store.exists(at(path)) and not store.rename(at(path), at(aside)):
        raise OSError(f"{path} cannot be moved")
    if not store.rename(at(beside), at(path)):
        store.rename(at(aside), at(path))
        raise OSError(f"{beside} cannot be moved")
    store.delete(at(aside), True)
    return spark.read.parquet(path)


def mark_notified(df: DataFrame, sent: DataFrame, key: str, column: str, as_of: str) -> DataFrame:
    """The time in column for the keys that were sent and had none."""
    told = sent.select(F.col(key).alias("__k")).distinct()
    return df.join(told, F.col(key) == F.col("__k"), "left").withColumn(column, F.when(F.col("__k").isNotNull(), F.coalesce(F.col(column), F.to_timestamp_ntz(F.lit(as_of)))).otherwise(F.col(column))).drop("__k")
