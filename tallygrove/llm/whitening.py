"""Whitening of embeddings: exact integer centring, a Gramian by Spark MLlib's RowMatrix, eigenvectors, and a broadcast projection.

Entries c, as double, are taken as the long x = floor(64 c) + 1000000. Sums over all rows are exact (decimals), so n x - S is the exact n-fold of a centred
entry, and centred rows are its rounding alone: no large offset is ever subtracted from a rounded sum. RowMatrix.computeGramianMatrix over them, divided by
n, is the covariance, a dim x dim matrix: this, the sums and the components are all that the driver sees and broadcasts, and none of it grows with the rows.

Components are numbered by falling eigenvalue; of a component's two signs that is taken in which its largest entry is positive.

Defined cases: rows whose vector is null or has a null or non-finite entry are left out, and so are those with an entry of 2^46 or more, whose x a double
does not hold to the unit; the dimension is that of the most rows (of several, the largest), and rows of another one are left out, empty vectors always. A
component whose eigenvalue is zero (no more than dim * 2^-52 of the largest one) cannot be whitened: whitened is null there, and identity_error looks at the others (null if there are none).
A deviation beyond a long is null. Repeated rows and null ids count and are returned like any other; an empty table, or one without a usable vector, gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 46)
ROWS = 2000  # of a block: 2,000 rows of 1,000 dimensions are 16 MB of longs


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: n vectors, exact sums of x by dimension, unit eigenvectors as columns, their eigenvalues (both by falling eigenvalue), and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def sound(self) -> np.ndarray:
        """Which components have an eigenvalue above zero."""
        return self.values > len(self.sums) * 2.0**-52 * max(self.values[0], 0)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, an array of doubles, of the rows that have a vector of finite entries."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # not a number is larger than any number
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """x of a batch's vectors, as longs."""
    entries = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(entries * SCALE).astype(np.int64) + OFFSET


def _blocks(batches, dim: int):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, _matrix(part, dim)


def _sums(dim: int):
    """A task's sums by dimension, as decimals."""

    def run(batches):
        total = [0] * dim
        for _, x in _blocks(batches, dim):
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)  # neither half can overflow
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low, high, strict=True)]
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(dim), type=pa.int32()), "s": [str(t) for t in total]})

    return run


def _multiples(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: as longs where they fit, as Python integers otherwise."""
    quotient, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    moved = x - quotient
    if x.size and n * (int(np.abs(moved).max()) + 1) >= 1 << 63:
        return moved.astype(object) * n - np.array(rest, dtype=object)
    return moved * n - np.array(rest, dtype=np.int64)


def _deviations(multiples: np.ndarray) -> list[int | None]:
    """Sums of squares of every row, exact; null beyond a long."""
    if multiples.dtype != object and multiples.size and int(np.abs(multiples).max()) ** 2 * multiples.shape[1] < 1 << 63:
        return (multiples * multiples).sum(axis=1).tolist()
    totals = [sum(a * a for a in row) for row in multiples.tolist()]
    return [t if t < 1 << 63 else None for t in totals]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _multiples(x, n, sums).astype(np.float64) / n


def _emit_centred(dim: int, n: int, sums: tuple[int, ...]):
    def run(batches):
        for _, x in _blocks(batches, dim):
            c = _centred(x, n, sums)
            yield pa.RecordBatch.from_pydict({"c": pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), dim).cast(pa.list_(pa.float64()))})

    return run


def dimension(vectors: DataFrame) -> int:
    """That of the most rows; 0 if there are none."""
    found = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found["dim"] if found else 0


def gramian(columns: DataFrame) -> np.ndarray:
    """Sum of the outer products of the rows of a table whose only column is an array of doubles."""
    name = columns.columns[0]
    rows = MLUtils.convertVectorColumnsFromML(columns.select(array_to_vector(name).alias(name)), name)
    return RowMatrix(rows).computeGramianMatrix().toArray()


def fit(vectors: DataFrame, dim: int) -> Whitening:
    """The whitening of vectors (column v) of one dimension, over all of them."""
    n = vectors.count()
    partial = vectors.select("v").mapInArrow(_sums(dim), "d int, s string")
    sums = tuple(int(r["s"]) for r in partial.groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect())
    covariance = gramian(vectors.select("v").mapInArrow(_emit_centred(dim, n, sums), "c array<double>")) / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1], found[:, ::-1]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(dim)])
    return Whitening(n, sums, found * signs, values, float(np.trace(covariance)))


def _whitened(x: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """A row for each x, a column for each component; NaN (null, once pandas hands it to Arrow) for those that have no eigenvalue."""
    scale = np.where(model.sound[:components], np.sqrt(np.maximum(model.values[:components], 0)), np.nan)
    return _centred(x, model.n, model.sums) @ model.vectors[:, :components] / scale


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation, whitened (an array with an entry for each component, null where there is no eigenvalue) of every vector."""
    dim, shared = len(model.sums), vectors.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        import pandas as pd

        model = shared.value
        for frame in frames:
            for i in range(0, len(frame), ROWS):
                part = frame.iloc[i : i + ROWS]
                x = np.floor(np.concatenate(part["v"].tolist()).reshape(-1, dim) * SCALE).astype(np.int64) + OFFSET
                out = _whitened(x, model, components)
                yield pd.DataFrame({"vec_id": part["vec_id"].array, "deviation": pd.array(_deviations(_multiples(x, model.n, model.sums)), dtype="Int64"), "whitened": list(out)})

    rows = vectors.select("vec_id", "v").withColumn("vec_id", F.col("vec_id").cast("string"))  # text, since pandas has null longs as doubles
    return rows.mapInPandas(run, "vec_id string, deviation long, whitened array<double>").withColumn("vec_id", F.col("vec_id").cast("long"))


def identity_error(whitened: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the covariance of what whiten() gave minus the identity, over the components with an eigenvalue."""
    sound = np.flatnonzero(model.sound[:components])
    if not len(sound):
        return None
    kept = whitened.select(F.filter("whitened", lambda w: w.isNotNull()).alias("w"))
    means = np.array(kept.select(F.posexplode("w").alias("k", "w")).groupBy("k").agg(F.avg("w").alias("m")).orderBy("k").toPandas()["m"])
    return float(np.abs(gramian(kept) / model.n - np.outer(means, means) - np.eye(len(sound))).max())


def whitened_rows(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every usable vector and component."""
    vectors = usable(rows, id_col, vector_col)
    dim = dimension(vectors)
    if not dim:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    vectors = vectors.filter(F.size("v") == dim)
    model, components = fit(vectors, dim), min(components, dim)
    found = whiten(vectors, model, components)
    error = identity_error(found, model, components)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values[:components]]
    shares = F.array(*(F.lit(e).cast("double") for e in explained))
    exploded = found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return exploded.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
