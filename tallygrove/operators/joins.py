"""Joins: semi, anti, refresh lists, entity matching, overlap of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_aware_not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """SQL's NOT IN: no rows at all if the right side has a null; a null key stays only if the right side is empty.

    One grouped count of the right side decides, so the join itself is a plain anti join on the key.
    """
    facts = right.agg(F.count("*").alias("__n"), F.count_if(F.col(right_key).isNull()).alias("__nulls"))
    kept = left.join(right.select(F.col(right_key).alias("__r")), F.col(key) == F.col("__r"), "left_anti")
    return kept.join(F.broadcast(facts)).filter((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__n", "__nulls")


def missing_or_stale(keys: DataFrame, key: str, known: DataFrame, seen: str, as_of: str, days: int) -> DataFrame:
    """Distinct keys that known does not have, or saw last more than days before as_of."""
    latest = known.groupBy(key).agg(F.max(seen).alias("__seen"))
    limit = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return keys.select(key).distinct().join(latest, key, "left").filter(F.col("__seen").isNull() | (F.col("__seen").cast("timestamp") < limit)).select(key)


def attach_many(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children's columns; [] where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def entity_match(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, left_group: str, right_group: str, left_value: str, right_value: str, within: float) -> DataFrame:
    """left_key, right_key: for each left key the right one of its group with the nearest value, if that is at most within away; of equal distances the smallest key.

    No pairs are made. A group's values are cut into bins, and a right row goes to each bin that it can be near to. There right values that the distance's rounding could make equal
    (nearly always a single one) stand as one entry, and in the order of values each left row looks at the entries just below and above its own.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    wide = within * 1.01  # bounds all values whose rounded distance is within
    bin_of = lambda c: F.floor(c / wide)
    value = F.col(right_value).cast("double")
    near = right.filter(finite(right_value)).select(F.col(right_group).alias("group"), F.explode(F.sequence(bin_of(value - wide), bin_of(value + wide))).alias("bin"), value.alias("value"), F.col(right_key).alias("right"))
    place = ["group", "bin"]
    least = near.groupBy(*place, "value").agg(F.min("right").alias("right"))
    ordered = W.partitionBy(*place).orderBy("value")
    opens = F.coalesce(F.col("value") - F.lag("value").over(ordered) > within * 2.0**-51, F.lit(True)).cast("int")
    entries = least.withColumn("opens", opens).withColumn("entry", F.sum("opens").over(ordered)).groupBy(*place, "entry").agg(F.min("value").alias("value"), F.collect_list(F.struct("value", "right")).alias("members"))
    own = left.filter(finite(left_value)).select(F.col(left_group).alias("group"), F.col(left_value).cast("double").alias("value"), F.col(left_key).alias("left")).filter("group IS NOT NULL").withColumn("bin", bin_of(F.col("value")))
    met = own.withColumn("entered", F.lit(True)).unionByName(entries.drop("entry").withColumn("entered", F.lit(False)), allowMissingColumns=True)
    # at an equal value an entry counts as below
    look = lambda *order: F.last("members", ignorenulls=True).over(W.partitionBy(*place).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    around = met.withColumn("below", look("value", "entered")).withColumn("above", look(F.col("value").desc(), F.col("entered").desc())).filter("entered")
    members = F.concat(F.coalesce("below", F.array()), F.coalesce("above", F.array()))
    best = F.array_min(F.transform(members, lambda m: F.struct(F.abs(F.col("value") - m["value"]).alias("distance"), m["right"].alias("right"))))
    found = around.select("left", best.alias("best")).filter(F.col("best.distance") <= within)
    return found.groupBy(F.col("left").alias(left_key)).agg(F.min("best")["right"].alias(right_key))


def containment(sets: DataFrame, owner: str, item: str, least: float) -> DataFrame:
    """(a, b, containment) of owners whose items lie in another's to least or more. sets has distinct (owner, item) rows.

    An owner of n items that lies in another to c items or more has one of its n - c + 1 rarest items there, so only these are looked for among all rows; owners
    that have fewer than c items are left out before the exact count. Pairs are counted from items, never made from all owners.
    """
    sizes = sets.groupBy(owner).agg(F.count("*").alias("size"))
    rarity = sets.groupBy(item).agg(F.count("*").alias("owners"))
    need = F.ceil(F.col("size") * least - 1e-9)
    ranked = sets.join(rarity, item).join(sizes, owner).withColumn("k", F.row_number().over(W.partitionBy(owner).orderBy("owners", item)))
    rare = ranked.filter(F.col("k") <= F.col("size") - need + 1).select(F.col(owner).alias("a"), item, need.alias("need"))
    large = sets.join(sizes, owner).select(F.col(owner).alias("b"), item, F.col("size").alias("b_size"))
    met = rare.join(large, item).filter("a <> b AND b_size >= need").select("a", "b").distinct()
    own, other = sets.select(F.col(owner).alias("a"), item), sets.select(F.col(owner).alias("b"), item)
    shared = met.join(own, "a").join(other, ["b", item]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.join(sizes.withColumnRenamed(owner, "a"), "a").select("a", "b", (F.col("shared") / F.col("size")).alias("containment")).filter(F.col("containment") >= least - 1e-12)
