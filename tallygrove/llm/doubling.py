"""Substring deduplication in words by level-wise doubling: words in a window of several words that also starts somewhere else are removed.

Words are the maximal runs of characters other than the blanks 0x20 and 0x09-0x0D; a text is taken as its words joined by single spaces, so windows are equal
if their bytes are.

1. Documents are put together to blocks of about a megabyte, each a row of a table that later steps read again.
2. Windows of a quarter of the length come first. A block gives the hash of every window once (twice if it has the window twice), so that what
   stands in a third of all documents stands once or twice in a block's keys. They are sorted in numpy, packed by their leading bits, and dealt out by these.
3. Where the parts of equal leading bits meet, keys that occur twice or more are found and go back to the blocks that gave them.
4. A block keeps the words in which every window of this level is repeated for the length of a whole one, and drops the others: only these are extended
   to twice the length. Once no words are left, or the length asked for is reached, it ends. The last level's keys are BLAKE2b-128 digests of the windows' bytes, so what the short
   hashes of the levels before it may take for equal is told apart.
5. Removed spans meet the blocks, and every document is put together from what is left.

A task holds one block, or the keys that share their leading bits; these are twice as many groups as there are shuffle partitions or more, and a
partition's size is Spark's to set. Windows are judged on the input, not on what is left, and never cross documents.

Defined cases: null, empty and blank texts have no words; texts of fewer words than a window lose nothing; all copies of a repeated window go, its first place included;
repeated rows are copies; null ids are kept; an empty table gives no rows; other columns are not looked at. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import SpanHash, blocks, cut, done, frees, small_batches

WINDOW, BLOCK = 35, 1 << 20
KEY_BYTES, DIGEST_BYTES = 6, 16
SEGMENTS = pa.schema([("block", pa.int64()), ("doc", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())), ("text", pa.list_(pa.binary()))])
DOCUMENTS = pa.schema([("block", pa.int64()), ("id", pa.list_(pa.int64())), ("text", pa.list_(pa.binary()))])
KEYS = pa.schema([("radix", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
SPANS = pa.schema([("block", pa.int64()), ("doc", pa.list_(pa.int32())), ("s", pa.list_(pa.int64())), ("e", pa.list_(pa.int64()))])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("kept", pa.string())])
DDL = {
    "segments": "block long, doc array<int>, start array<long>, text array<binary>",
    "documents": "block long, id array<long>, text array<binary>",
    "keys": "radix int, block long, keys binary",
    "spans": "block long, doc array<int>, s array<long>, e array<long>",
    "result": "doc_id long, n_words long, spans array<struct<s: long, e: long>>, kept string",
}


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: tables in the shared folder hold all that later steps read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def levels(window: int, start: int | None = None) -> list[int]:
    """Lengths of windows, each at most twice the one before; the last is window."""
    out = [min(window, start or max(1, -(-window // 4)))]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Words:
    """The words of several texts, each with single spaces between words, as one buffer: begin and end of every word, and the text it is in."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        buffer = np.frombuffer(self.data, dtype=np.uint8)
        self.buffer = buffer
        self.end = np.flatnonzero(buffer == 0x20)
        self.begin = np.concatenate([[0], self.end[:-1] + 1])
        bounds = np.cumsum([len(t) + 1 for t in texts])  # a text without words would leave an empty word; callers have none
        self.first = np.concatenate([[0], np.searchsorted(self.end, bounds - 1) + 1]).astype(np.int64)
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def starts(self, length: int) -> np.ndarray:
        """First words of all windows of so many words."""
        n = len(self.end) - length + 1
        return np.flatnonzero(self.of[: max(n, 0)] == self.of[length - 1 :])

    def keys(self, length: int, last: bool, tile: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(first words, keys) of all windows; keys are numbers of KEY_BYTES bytes, or at the last level digests."""
        at = self.starts(length)
        begin, end = self.begin[at], self.end[at + length - 1]
        if last:
            view, digest = memoryview(self.data), hashlib.blake2b
            return at, np.array([digest(view[a:b], digest_size=DIGEST_BYTES).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], dtype=f"S{DIGEST_BYTES}")
        out = [np.zeros(0, dtype=np.uint64)]
        for i in range(0, len(at), tile):
            a, b = begin[i : i + tile], end[i : i + tile]
            out.append(SpanHash(self.buffer[a[0] : b[-1]]).rough(a - a[0], b - a[0]) >> np.uint64(64 - 8 * KEY_BYTES))
        return at, np.concatenate(out)


def pack(keys: np.ndarray) -> bytes:
    if keys.dtype != np.uint64:
        return keys.tobytes()
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(data, last: bool) -> np.ndarray:
    if last:
        return np.frombuffer(data, dtype=f"S{DIGEST_BYTES}")
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = raw
    return out.view("<u8").ravel()


def radix(keys: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of sorted keys, which are sorted like them."""
    if keys.dtype == np.uint64:
        return (keys >> np.uint64(8 * KEY_BYTES - bits)).astype(np.int32)
    head = np.frombuffer(keys.tobytes(), dtype=np.uint8).reshape(-1, DIGEST_BYTES)[:, :4].copy().view(">u4").ravel()
    return (head >> np.uint32(32 - bits)).astype(np.int32)


def _emit_keys(length: int, last: bool, bits: int):
    """A task over blocks: the keys of each, at most twice each, by their leading bits."""

    @frees
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, found = Words(batch.column("text")[i].as_py()).keys(length, last)
                if not len(found):
                    continue
                found, times = np.unique(found, return_counts=True)
                found = np.repeat(found, np.minimum(times, 2))
                part = radix(found, bits)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                pieces = [pack(x) for x in np.split(found, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), batch.column("block")[i].as_py())), pa.array(pieces, type=pa.binary())], schema=KEYS)

    return run


def _repeated(last: bool):
    """For the parts of several blocks that share their leading bits: what of each part occurs twice or more in all of them."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpack(x, last) for x in rows.column("keys").to_pylist()]
        every = np.concatenate(parts)
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for p in parts:
            p = np.unique(p)
            at = np.searchsorted(twice, p)
            out.append(pack(p[twice[np.minimum(at, len(twice) - 1)] == p]) if len(twice) else b"")
        keep = np.array([len(x) > 0 for x in out])
        return pa.table({"block": rows.column("block").filter(pa.array(keep)).combine_chunks(), "keys": pa.array([x for x in out if x], type=pa.binary())})

    return run


def repeated_keys(segments: DataFrame, length: int, last: bool) -> DataFrame:
    """block, keys: for every block the keys of its windows that also start elsewhere, in several rows."""
    bits = max(4, (2 * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    keys = segments.select("block", "text").mapInArrow(_emit_keys(length, last, min(bits, 30)), DDL["keys"])
    return keys.groupBy("radix").applyInArrow(_repeated(last), "block long, keys binary")


def _windows_alive(words: Words, keys: list, length: int, last: bool) -> np.ndarray:
    """Whether the window of this length that starts at a word is repeated; false where none starts."""
    at, found = words.keys(length, last)
    known = np.sort(np.concatenate([unpack(k, last) for k in keys]))
    alive = np.zeros(len(words.end), dtype=bool)
    alive[at] = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found
    return alive


def covered(words: Words, alive: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) words of the maximal runs in windows of which every part of the given length is alive; runs do not cross texts."""
    sums = np.concatenate([[0], np.cumsum(alive)])
    at = words.starts(window)
    at = at[sums[at + window - length + 1] - sums[at] == window - length + 1]
    mark = np.zeros(len(words.end) + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    inside = np.cumsum(mark)[:-1] > 0
    edges = np.zeros(len(inside) + 1, dtype=bool)
    edges[words.first] = True
    begin = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edges[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return begin, end


def _narrow(length: int, window: int):
    """For a block and its repeated keys: what is left of it, as new segments, or at the last level as spans of words to remove."""
    last = length == window

    def run(block: pa.Table, keys: pa.Table) -> pa.Table:
        schema = SPANS if last else SEGMENTS
        if not block.num_rows or not keys.num_rows:
            return schema.empty_table()
        row = block.slice(0, 1).to_pylist()[0]
        words = Words(row["text"])
        begin, end = covered(words, _windows_alive(words, keys.column("keys").to_pylist(), length, last), length, window)
        if not len(begin):
            return schema.empty_table()
        of = words.of[begin]
        start = np.array(row["start"], dtype=np.int64)[of] + begin - words.first[of]
        out = {"block": [row["block"]], "doc": [np.array(row["doc"], dtype=np.int32)[of]]}
        if last:
            out |= {"s": [start], "e": [start + end - begin]}
        else:
            out |= {"start": [start], "text": [[words.data[a:b] for a, b in zip(words.begin[begin].tolist(), words.end[end - 1].tolist(), strict=True)]]}
        return pa.table(out, schema=schema)

    return run


def _blocks(block_bytes: int):
    """A task over documents: their words, put together to blocks."""

    @frees
    def run(batches):
        for k, table in enumerate(blocks(batches, "text", block_bytes)):
            texts = [b" ".join(t.split()) if t else b"" for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([table.column("id").to_pylist()], type=DOCUMENTS.field("id").type), pa.array([texts], type=DOCUMENTS.field("text").type)], schema=DOCUMENTS)

    return run


def _segments(window: int):
    """Whole documents as segments, without those that hold no window."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("text")[i].as_py()
                doc = [k for k, t in enumerate(texts) if t.count(b" ") >= window - 1 and t]
                if doc:
                    yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([doc], type=SEGMENTS.field("doc").type), pa.array([[0] * len(doc)], type=SEGMENTS.field("start").type), pa.array([[texts[k] for k in doc]], type=SEGMENTS.field("text").type)], schema=SEGMENTS)

    return run


def _finish(block: pa.Table, spans: pa.Table) -> pa.Table:
    """Every document of a block with its spans and what is left of it."""
    if not block.num_rows:
        return RESULT.empty_table()
    row = block.slice(0, 1).to_pylist()[0]
    removed: dict[int, list[dict]] = {}
    for r in spans.to_pylist():
        for d, s, e in sorted(zip(r["doc"], r["s"], r["e"], strict=True)):
            own = removed.setdefault(d, [])
            if own and s <= own[-1]["e"]:
                own[-1]["e"] = max(own[-1]["e"], e)
            else:
                own.append({"s": s, "e": e})
    n_words, kept = [], []
    for d, text in enumerate(row["text"]):
        n_words.append(text.count(b" ") + 1 if text else 0)
        if d in removed:
            words, at, left = text.split(b" "), 0, []
            for x in removed[d]:
                left += words[at : x["s"]]
                at = x["e"]
            text = b" ".join(left + words[at:])
        kept.append(text)
    return pa.table({"doc_id": row["id"], "n_words": n_words, "spans": [removed.get(d, []) for d in range(len(kept))], "kept": pc.cast(pa.array(kept, type=pa.binary()), pa.string())}, schema=RESULT)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (removed words: array of struct s, e, maximal), kept (the other words, joined by single spaces) of every row.

    start: the first level's length, by default a quarter of window.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    with small_batches(spark), shuffles_freed(spark):
        whole = cut(rows.mapInArrow(_blocks(block_bytes), DDL["documents"]), "blocks")
    with small_batches(spark, 4), shuffles_freed(spark):
        now, spans = whole.mapInArrow(_segments(window), DDL["segments"]), None
        for length in levels(window, start):
            last = length == window
            keys = cut(repeated_keys(now, length, last), "keys")
            narrowed = cut(now.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(_narrow(length, window), DDL["spans" if last else "segments"]), "narrowed")
            done(keys, *([now] if hasattr(now, "cut_path") else []))
            now = narrowed
            if last:
                spans = now
            elif not now.head(1):
                spans = now.selectExpr("block", "doc", "start AS s", "start AS e")  # none
                break
        out = cut(whole.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_finish, DDL["result"]), "kept")
        done(whole, now)
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return remove_repeats(docs, **options).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
