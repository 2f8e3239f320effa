"""SimHash near-duplicates by a grid join over segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment into its bit count (0 to 2). The Manhattan distance of two such
count vectors never exceeds the Hamming distance of the fingerprints. The counts are dealt into thirds: of fingerprints at 4 or fewer
differing bits, the third where they differ most has 2 of them at least (or none differ), so in the pair of the other two thirds the vectors are at
Manhattan distance 2 or less, and some grid point lies within 1 of both. Each distinct fingerprint therefore goes, for each pair of thirds,
to its own cell and the cells next to it, equal cells are compared, and the exact Hamming distance decides.
Inside a cell only a spanning forest of the links is kept, so a large group of near copies costs no
pair-per-pair rows; cells beyond cell_limit are dealt out as pairs of salted sub-cells, which together cover every pair.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows of equal text are one class, so are repeated
rows; component_id is the smallest non-null doc_id of the component (null only if it has none); an empty table gives no rows; other
columns of the input are not looked at. Fingerprints are stored signed; the text form is 16 lower-case hex digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import apart, cut, emit, frees, small_batches
from tallygrove.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("t", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MAX_BITS = 4
ODD = 0x5555555555555555
THIRDS = [((1 << 22) - 1, 0), ((1 << 22) - 1 << 22, 22), ((1 << 20) - 1 << 44, 44)]  # bits of a third, and where they begin


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is set if it is set in over half the XXH64 values of the word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()  # splits at 0x09-0x0D and 0x20
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(begins.tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and t (hash of the text) of every row."""

    @frees
    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield emit({"doc_id": batch.column(0), "fp": values.view(np.int64), "t": batch.column(2)}, PRINTS)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")).mapInArrow(run, "doc_id long, fp long, t long")


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def cells(prints: DataFrame) -> DataFrame:
    """(cell, fp) for each fp's own cell and the cells next to it, in each pair of thirds.

    A cell is the counts, two bits each, with the left-out third zeroed but for a mark that no count can be.
    """
    low, high = F.col("fp").bitwiseAND(ODD), F.shiftrightunsigned("fp", 1).bitwiseAND(ODD)
    counts = prints.select("fp", low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1)).alias("y"))
    pairs = counts.select("fp", "y", F.explode(F.array(*[F.struct(F.lit(_signed(~third)).alias("mask"), F.lit(_signed(3 << at)).alias("mark")) for third, at in THIRDS])).alias("p"))
    own = pairs.select("fp", F.expr("y & p.mask").alias("y"), "p.*")
    near = F.expr("""
        transform(concat(array(0L),
                         transform(filter(sequence(0, 62, 2), i -> (shiftrightunsigned(mask, i) & 3L) = 3 AND (shiftrightunsigned(y, i) & 3L) < 2), i -> shiftleft(1L, i)),
                         transform(filter(sequence(0, 62, 2), i -> (shiftrightunsigned(y, i) & 3L) > 0), i -> shiftleft(3L, i))),
                  step -> (y ^ step) | mark)""")
    return own.select("fp", F.explode(near).alias("cell"))


def bits(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    """How many bits differ."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of one cell, breadth first."""
    left, ends = np.arange(len(fp)), ([], [])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            seed = queue.pop()
            near = bits(fp[left], fp[seed]) <= max_bits
            if near.any():
                found = left[near]
                ends[0].append(np.full(len(found), fp[seed]))
                ends[1].append(fp[found])
                queue.extend(found.tolist())
                left = left[~near]
    nothing = [np.zeros(0, dtype=fp.dtype)]
    return np.concatenate(ends[0] or nothing), np.concatenate(ends[1] or nothing)


def _compare(small: int, max_bits: int):
    """A task over rows (cell, fp) sorted by cell: small cells are compared at all distances in the sort order, others by forest()."""

    def whole(cell: np.ndarray, fp: np.ndarray):
        if not len(cell):
            return
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lengths = np.diff(np.append(starts, len(cell)))
        few = np.repeat(lengths <= small, lengths)
        c, f = cell[few], fp[few]
        a, b = [], []
        for lag in range(1, small):
            hit = (c[lag:] == c[:-lag]) & (bits(f[lag:], f[:-lag]) <= max_bits)
            if hit.any():
                a.append(f[:-lag][hit])
                b.append(f[lag:][hit])
        for s, n in zip(starts[lengths > small].tolist(), lengths[lengths > small].tolist(), strict=True):
            x, y = forest(np.unique(fp[s : s + n]), max_bits)
            a.append(x)
            b.append(y)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            links = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            links = links[links[:, 0] != links[:, 1]]
            yield emit({"a": np.ascontiguousarray(links[:, 0]), "b": np.ascontiguousarray(links[:, 1])}, LINKS)

    @frees
    def run(batches):
        held_c, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            c = np.concatenate([held_c, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy()])
            if not len(c):
                continue
            last = int(np.searchsorted(c == c[-1], True)) if c[0] != c[-1] else 0
            yield from whole(c[:last], f[:last])
            held_c, held_f = c[last:], f[last:]
        yield from whole(held_c, held_f)

    return run


def links(prints: DataFrame, *, max_bits: int = MAX_BITS, cell_limit: int = 20_000, small: int = 24) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect every two that max_bits or fewer bits tell apart.

    prints has distinct non-null longs fp.
    """
    if max_bits > 4:
        raise ValueError("the grid is proven for 4 differing bits at most")
    placed = cells(prints)
    # counted by a partial aggregate, so no task gathers a crowded cell
    several = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    # merged, never broadcast: Spark sizes placed by the fingerprints it is exploded from, some 200 times too low
    counted = placed.join(several.hint("merge"), "cell")
    # a crowded cell is dealt out: sub-cells i <= j of every pair of salts, each with the rows of salts i and j
    salted = counted.selectExpr("cell", "fp", f"CAST(ceil(n / {cell_limit}) AS INT) AS salts").selectExpr("cell", "fp", "salts", "CAST(pmod(xxhash64(fp), salts) AS INT) AS salt")
    dealt = salted.selectExpr("cell", "fp", "salt", "explode(sequence(0, salts - 1)) AS other", "salts").selectExpr("CASE WHEN salts = 1 THEN cell ELSE xxhash64(cell, least(salt, other), greatest(salt, other)) END AS cell", "fp")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(small, max_bits), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, max_bits: int, cell_limit: int) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): doc_id and fp of every row; fp, rep (smallest doc_id) and root (one for each component) of every fp."""
    with small_batches(docs.sparkSession):
        prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    pairs = links(classes.select("fp"), max_bits=max_bits, cell_limit=cell_limit)
    # components run over fingerprints; the smallest doc_id of each comes after
    joined = components(pairs).withColumnsRenamed({"id": "fp", "component": "root"})
    return prints, cut(classes.join(joined, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, cell_limit: int = 20_000) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints, rooted = _classes(docs, id_col, text_col, max_bits, cell_limit)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@apart
def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, cell_limit: int = 20_000) -> DataFrame:
    """One row of each component, in the input's own columns: that of the smallest doc_id (null ones last), then of the least text hash.

    Rows that agree in both are equal in all that is looked at; any one of them stays.
    """
    prints, rooted = _classes(docs, id_col, text_col, max_bits, cell_limit)
    hash_of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    whose = prints.join(rooted.select("fp", "root"), "fp").select("doc_id", "t", "root")
    first = whose.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("at")).select(F.col("at.doc_id").alias("__id"), F.col("at.t").alias("__t"))
    rows = docs.withColumn("__h", hash_of).join(first, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")), "left_semi")
    return rows.dropDuplicates([id_col, "__h"]).select(*docs.columns)
