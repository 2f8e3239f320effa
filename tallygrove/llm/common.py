"""What the corpus operators share: the shared folder, tables cut from their lineage, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache, cached_property, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, or (only where that is unset, as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub("^file:/+", "file:///", uri)


def own_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/tables-of-{spark.sparkContext.applicationId}"


_stage: dict[str, str] = {}  # application to the folder of the stage it is in


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{_stage.get(spark.sparkContext.applicationId, own_folder(spark))}/{name}-{uuid.uuid4().hex}"


def next_stage(spark: SparkSession, docs: DataFrame) -> None:
    """Intermediate tables go to a new folder from now on; those of the stage before, whose result has been written by now, are removed, but for the one that docs is read from."""
    app = spark.sparkContext.applicationId
    if app in _stage:
        where = spark._jvm.org.apache.hadoop.fs.Path(_stage[app])
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()}
        for child in store.listStatus(where) if store.exists(where) else []:
            if child.getPath().getName() not in folders:
                store.delete(child.getPath(), True)
    _stage[app] = f"{own_folder(spark)}/stage-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that the operators returned cannot be read after it, what was written from them can."""
    discard(spark, own_folder(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def apart(operator):
    """operator, which returns the columns of its first argument, with those whose names begin with two underscores, like its own, renamed while it runs."""

    @wraps(operator)
    def run(docs: DataFrame, **options) -> DataFrame:
        names = docs.columns
        own = [f"column {i}" if c.startswith("__") else c for i, c in enumerate(names)]
        known = dict(zip(names, own, strict=True))
        return operator(docs.toDF(*own), **{k: known.get(v, v) if k.endswith("_col") else v for k, v in options.items()}).toDF(*names)

    return run


def done(*tables: DataFrame) -> None:
    """Remove tables of cut() that nothing reads any more."""
    for t in tables:
        discard(t.sparkSession, t.cut_path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that cut() wrote once nothing reads it any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give freed memory back, powers of the span hash among it: a Python worker outlives its task, and what it keeps would add to the next one's."""
    SpanHash.forget()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:
        trim(0)


def frees(run):
    """A task that, once it is over and nothing of it is held, gives its memory back."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        release()

    return whole


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of long texts by fewer rows for what is executed inside, unless the session says otherwise already: both ends of the socket hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":  # Spark's default
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Rows regrouped so that a block's text bytes stay near limit; a longer single row is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        start, n = 0, len(lengths)
        for i in range(n):
            if size and size + lengths[i] > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                whole, held, size, start = pa.Table.from_batches(held), [], 0, i
                yield whole
                del whole
            size += lengths[i]
        if n > start:
            held.append(batch.slice(start, n - start))
        del batch
    if held:
        yield pa.Table.from_batches(held)


def emit(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """One record batch of the given columns."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix one) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def spread() -> np.ndarray:
    """A random-looking 64-bit number for every code point (and so for every byte)."""
    return mix64(np.arange(0x110000))


PRIME = np.uint64((1 << 31) - 1)


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME: its upper bits count like lower ones, as 2^31 is 1 there."""
    for _ in range(2):
        x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


def _powers_modulo(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1 modulo PRIME, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    known = 1
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = _modulo(out[:more] * np.uint64(pow(base, known, int(PRIME))))
        known += more
    return out


class SpanHash:
    """64-bit hashes of any span of a symbol array, from running sums of two polynomials: one modulo 2^64 (its base is odd and so invertible) and,
    since some texts collide there for every base, one modulo a prime. For grouping: span_classes() compares what it takes for equal."""

    BASE, SMALL = 0x9E3779B97F4A7C15 | 1, 1_350_490_027
    _powers = np.ones(1, dtype=np.uint64)
    _inverse, _small, _small_inverse = _powers, _powers, _powers

    @classmethod
    def forget(cls) -> None:
        """Drop the powers, which are as long as the longest array so far; the next one makes them anew."""
        cls._powers = cls._inverse = cls._small = cls._small_inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(SpanHash._powers) < n:
            for name, base in (("_powers", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
                p[0] = 1
                setattr(SpanHash, name, np.multiply.accumulate(p))
        self.sums, self.symbols = np.zeros(n, dtype=np.uint64), symbols
        np.cumsum(spread()[symbols] * SpanHash._powers[: n - 1], out=self.sums[1:])

    @cached_property
    def small(self) -> np.ndarray:
        out = np.zeros(len(self.sums), dtype=np.uint64)
        if len(SpanHash._small) < len(out):
            size = max(len(out), 1 << 16)
            SpanHash._small, SpanHash._small_inverse = _powers_modulo(self.SMALL, size), _powers_modulo(pow(self.SMALL, -1, int(PRIME)), size)
        np.cumsum(_modulo((spread()[self.symbols] >> np.uint64(34)) * SpanHash._small[: len(out) - 1]), out=out[1:])
        return out

    def rough(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) spans by the first polynomial alone: to choose or to sort by, not to tell spans apart."""
        return mix64((self.sums[ends] - self.sums[starts]) * SpanHash._inverse[starts])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) spans; equal spans hash alike, and the length goes in too."""
        return self.joined([(starts, ends, 0)], ends - starts)

    def joined(self, spans: list[tuple[np.ndarray, np.ndarray, int]], lengths: np.ndarray, extra: tuple = ()) -> np.ndarray:
        """Hashes of spans put together: each (start, end, place at which its first symbol then stands), and single symbols extra (code point, place)."""
        raw = small = np.zeros(1, dtype=np.uint64)
        sums_modulo = self.small
        for start, end, place in spans:
            raw = raw + (self.sums[end] - self.sums[start]) * SpanHash._inverse[start] * SpanHash._powers[place]
            moved = _modulo(_modulo(sums_modulo[end] - sums_modulo[start]) * SpanHash._small_inverse[start])
            small = small + (moved if isinstance(place, int) and place == 0 else _modulo(moved * SpanHash._small[place]))
        for symbol, place in extra:
            raw = raw + spread()[symbol] * SpanHash._powers[place]
            small = small + _modulo((spread()[symbol] >> np.uint64(34)) * SpanHash._small[place])
        return mix64(raw ^ mix64(_modulo(small) << np.uint64(32) ^ np.asarray(lengths).astype(np.uint64)))


def same_spans(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, chunk: int = 1 << 20) -> bool:
    """Whether the spans that begin at a and at b, of these lengths, have equal symbols, pair by pair."""
    total = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + chunk, side="right")))
        n = lengths[i:j]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not (symbols[np.repeat(a[i:j], n) + within] == symbols[np.repeat(b[i:j], n) + within]).all():
            return False
        i = j
    return True


def first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes occurs first."""
    first = np.zeros(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def span_classes(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the class of equal spans that each span is in, a span of each class); exact, as members are compared with their class."""
    codes, seen = pd.factorize(SpanHash(symbols).rough(begin, end))
    first, lengths = first_places(codes, len(seen)), end - begin
    again = np.flatnonzero(first[codes] != np.arange(len(codes)))
    other = first[codes[again]]
    if (lengths[again] != lengths[other]).any() or not same_spans(symbols, begin[again], begin[other], lengths[again]):
        spans = [symbols[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        codes, seen = pd.factorize(np.array([*spans, None], dtype=object)[:-1])
        first = first_places(codes, len(seen))
    return codes, first
