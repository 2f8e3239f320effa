"""Whitening against numpy over exact integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import whitening
from tallygrove.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, v array<double>, c double, n long, whitened string"


def frame(spark, vectors, first=0):
    """Vectors, and extra columns whose names the operator has too."""
    return spark.createDataFrame([(first + i, v, 1, [0.5], 0.1, 3, "x") for i, v in enumerate(vectors)], SCHEMA)


def by_hand(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    multiples = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(multiples, dtype=float) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(a * a for a in row) for row in multiples], centred, values[::-1], found[:, ::-1]


def test_against_numpy(spark):
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) * (k + 1) + 50 * k for k in range(6)] for _ in range(300)]
    vectors = [*base, *[base[0]] * 150]  # one vector holds a third of the rows
    odd = [None, [], [1.0] * 5, [None] + [0.0] * 5, [float("nan")] + [0.0] * 5, [float("-inf")] + [1.0] * 5, [1e30] * 6]
    rows = whitening.whitened_rows(frame(spark, vectors + odd).repartition(3)).collect()
    n, deviation, centred, values, found = by_hand(vectors)
    assert len(rows) == n * 6 and {r["vec_id"] for r in rows} == set(range(n))
    got, signs = np.zeros((n, 6)), {}
    for r in rows:
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert abs(r["explained"] * values.sum() / values[r["component"] - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = centred @ found / np.sqrt(values)
    for k in range(6):
        signs = np.sign((got[:, k] * want[:, k]).sum())
        assert np.allclose(got[:, k], signs * want[:, k], atol=1e-8)


def test_components_without_a_spread_are_null(spark):
    rows = whitening.whitened_rows(frame(spark, [[float(i), 2.0 * i, 7.0] for i in range(20)])).collect()
    assert all((r["whitened"] is not None) == (r["component"] == 1) for r in rows) and rows[0]["identity_error"] < 1e-9
    same = whitening.whitened_rows(frame(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whitened_rows(frame(spark, [[3.0]])).count() == 1


def test_large_entries_stay_exact(spark):
    big = [[2.0**44, 1.0], [-(2.0**44), 2.0], [2.0**20, 3.0]]
    rows = {(r["vec_id"], r["component"]): r for r in whitening.whitened_rows(frame(spark, big)).collect()}
    n, deviation, *_ = by_hand(big)
    assert [rows[i, 1]["deviation"] for i in range(3)] == [d if d < 1 << 63 else None for d in deviation]


def test_null_ids_repeats_and_empty_tables(spark):
    rows = frame(spark, [[float(i % 3), float(i % 5)] for i in range(30)])
    nulls = rows.withColumn("vec_id", F.when(F.col("vec_id") > 2, F.col("vec_id")))
    assert whitening.whitened_rows(nulls).filter("vec_id IS NULL").count() == 6
    assert whitening.whitened_rows(rows.unionByName(rows)).count() == 120
    empty = whitening.whitened_rows(frame(spark, []))
    assert empty.count() == 0 and empty.columns == whitening.whitened_rows(rows).columns
    assert whitening.whitened_rows(frame(spark, [None, [None]])).count() == 0


def test_whole_table(spark, sf):
    rows = whitening.whitened_rows(table(spark, sf, "embeddings"))
    assert rows.count() == table(spark, sf, "embeddings").count() * 32
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-4
