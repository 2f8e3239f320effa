"""Long repeats of a corpus by run-length index: which bytes lie in a match-byte string that also starts somewhere else.

1. Distinct texts are written once, with the number of their copies, bucketed by their hash, so the two later joins with them move no text.
2. Every match-byte window holds an anchor: the least hash of its anchor-byte strings, leftmost among equals. Equal windows have equal
   anchors, so all occurrences of a repeat meet under the anchor's hash. A window that has the anchor lies inside a fixed context of it;
   contexts of equal anchors that overlap in a text are taken as one. Where shorter repeats are asked for too, anchors go by the shorter windows
   and contexts reach as far as the longer ones that begin with them.
3. Anchors that occur once are sifted out by the hashes of the others, then equal contexts of an anchor are counted with a partial aggregate and
   kept once, with their number.
4. The contexts of an anchor are indexed: suffix order, Burrows-Wheeler transform, its runs, and samples of the text positions
   at run ends with their common prefixes; only runs and samples are kept. Copies of a context lengthen runs and add none: they stand as a number
   at its first position, where a separator makes a run end. Inside a run the longest match of a position is one less than that of the position before
   it, so the matching statistics of the whole text are streamed from the samples. Starts that match match bytes or more are marked.
   An anchor with more than group_limit contexts is dealt out as pairs of salted parts, which together hold every pair of contexts.
5. Marks go back to all occurrences of their context, and each distinct text is cut once.

Anchors are only told apart by what the index then compares; contexts go by the BLAKE2b-128 of their bytes. Texts of any length are read tile by tile.

Defined cases: null texts are empty; texts shorter than match are left as they are; exact copies of a text of match bytes or more are
removed as a whole, all of them; repeated rows are copies; an empty table gives no rows; other columns are not looked at.

Where a repeat is told by its number of words (clean), shorter words than WORD bytes are filled up with bytes 255, which UTF-8 never holds: so many
words then have match bytes at least, whatever words they are. Where passages are counted beside the cut (remove_repeats), texts are indexed as they are, and
a passage is a run of so many words of what repeats over words of WORD bytes on average, so shorter words may leave one uncounted.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import SpanHash, apart, blocks, cut, discard, done, emit, frees, fresh_path, small_batches
from tallygrove.llm.linededup import sifted

MATCH, ANCHOR = 400, 128
WORD = 4
SHORT = re.compile(rb"(?<!\S)\S{1,%d}(?!\S)" % (WORD - 1))
TILE = 1 << 18
ANCHORS = pa.schema([("key", pa.int64()), ("context", pa.binary()), ("row", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
MARKS = pa.schema([("key", pa.int64()), ("context", pa.binary()), ("s", pa.int32()), ("e", pa.int32()), ("bytes", pa.int32())])


# -- anchors ---------------------------------------------------------------------------------------------------------------------------
def _anchors_of_tile(buffer: np.ndarray, ends: np.ndarray, start: int, tile: int, match: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of the windows that begin in a tile and end in the text they begin in."""
    stop = min(start + tile, len(buffer) - match + 1)
    width, windows = match - anchor + 1, stop - start
    at = np.arange(windows + width - 1)
    hashes = SpanHash(buffer[start : stop + match - 1]).rough(at, at + anchor)
    m, bits = len(hashes), np.uint64(len(hashes).bit_length())
    ranked = (hashes >> bits << bits) | at.astype(np.uint64)
    tiles = np.concatenate([ranked, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    i, j = np.searchsorted(ends, [start, stop - 1], side="right")
    borders = np.concatenate([[start], np.minimum(ends[i : j + 1], stop)])
    inside = np.arange(start, stop) + match <= np.repeat(ends[i : j + 1], np.diff(borders))
    p = np.unique((least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return p + start, hashes[p].view(np.int64)


def anchors(texts: list[bytes], match: int = MATCH, anchor: int = ANCHOR, tile: int = TILE, reach: int | None = None) -> dict[str, np.ndarray]:
    """Anchors of all windows: key (hash), context (BLAKE2b-128 of text[a:b]), row (which text), a, b, times (anchors taken as one). A context
    holds the reach bytes (match if not given) from the begin of each window of its anchor."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    data = b"".join(texts)
    buffer = np.frombuffer(data, dtype=np.uint8)
    found = [_anchors_of_tile(buffer, ends, start, tile, match, anchor) for start in range(0, len(buffer) - match + 1, tile)]
    p, where = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in found)]), return_index=True)
    if not len(p):
        return {f.name: pa.array([], type=f.type) if f.name == "context" else np.zeros(0, dtype=f.type.to_pandas_dtype()) for f in ANCHORS}
    key = np.concatenate([k for _, k in found])[where]
    row = np.searchsorted(ends, p, side="right")
    begin = ends[row] - lengths[row]
    a, b = np.maximum(p - (match - anchor), begin), np.minimum(p + (reach or match), ends[row])
    # contexts of one anchor that overlap in a text become one, lest the index take a string for a copy of itself
    by = np.lexsort((p, key, row))
    key, row, begin, a, b = key[by], row[by], begin[by], a[by], b[by]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (a[1:] >= b[:-1])]))
    key, row, begin, a, b = key[first], row[first], begin[first], a[first], b[np.append(first[1:], len(b)) - 1]
    view, digest = memoryview(data), hashlib.blake2b
    context = pa.array([digest(view[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)], type=pa.binary())
    return {"key": key, "context": context, "row": row, "a": a - begin, "b": b - begin, "times": np.diff(np.append(first, len(p)))}


def _find_anchors(match: int, anchor: int, reach: int, block_bytes: int):
    @frees
    def run(batches):
        for block in blocks(batches, "text", block_bytes):
            found = anchors(block.column("text").to_pylist(), match, anchor, reach=reach)
            row = found["row"]
            whose = {c: block.column(c).to_numpy()[row] for c in ("h1", "h2", "n")}
            yield pa.RecordBatch.from_pydict({"key": found["key"], "context": found["context"], "h1": whose["h1"], "h2": whose["h2"], "n": whose["n"], "a": found["a"].astype(np.int32), "b": found["b"].astype(np.int32), "times": found["times"].astype(np.int32)})

    return run


# -- the index -------------------------------------------------------------------------------------------------------------------------
def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth symbols at least (symbols below 512), by the ranks of as many prefixes as fit 64 bits, over those still tied."""
    n = len(symbols)
    bits = n.bit_length()
    packed = np.zeros(n, dtype=np.int64)
    for i in range(7):
        packed <<= 9
        packed[: n - i] |= symbols[i:]
    order = np.argsort(packed)
    rank, known = np.zeros(n + max(depth, 7) + 1, dtype=np.uint64), 7  # rank of a suffix: where its class of equals begins in the order, plus one; 0 is past the end
    packed = packed.take(order)
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    del packed
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0)).view(np.uint64)
    place = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(place) and known < depth:
        who = order.take(place)
        key = rank.take(who)
        fold = max(2, min(64 // bits, -(-depth // known)))
        for i in range(1, fold):
            key <<= np.uint64(bits)
            key |= rank.take(who + i * known)
        by = np.argsort(key)
        who, key = who.take(by), key.take(by)
        del by
        order[place] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank[who] = (place.take(np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))) + 1).view(np.uint64)
        place = place[~(new & np.append(new[1:], True))]
        known *= fold
    return order


def common_prefix(symbols: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int, chunk: int = 1 << 14) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, up to limit, by blocks of 32 symbols."""
    out = np.zeros(len(i), dtype=np.int32)
    padded = np.concatenate([symbols, np.zeros(limit + 32, dtype=symbols.dtype)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 32)
    for c in range(0, len(i), chunk):
        live = np.arange(c, min(c + chunk, len(i)))
        while len(live):
            at = out[live]
            same = words[i[live] + at] == words[j[live] + at]
            length = np.where(same.all(axis=1), 32, same.argmin(axis=1))
            out[live] += length.astype(np.int32)
            live = live[(length == 32) & (out[live] < limit)]
    return np.minimum(out, limit)


class RunIndex:
    """The runs of a text's Burrows-Wheeler transform (symbol and length), the text positions at both sides of every border between two runs, and how far
    the suffixes there agree. A context that stands for several copies has a border with its copy at its first position."""

    def __init__(self, symbols: np.ndarray, limit: int, copied: np.ndarray, lengths: np.ndarray):
        """copied: first positions of contexts with copies; lengths: of these contexts."""
        order = suffix_order(symbols, limit)
        transform = symbols.take(order - 1, mode="wrap")  # of position 0 the last symbol, a separator
        cuts = np.flatnonzero((transform[1:] != transform[:-1]) | (transform[1:] == 0)) + 1  # a run ends before each; a separator is its own run
        self.symbols, self.lengths, self.size = transform[np.append(0, cuts)], np.diff(np.concatenate([[0], cuts, [len(symbols)]])), len(symbols)
        ends, heads = order[cuts - 1], order[cuts]
        del order, transform
        common = common_prefix(symbols, ends, heads, limit)
        self.samples, self.common = np.concatenate([ends, heads, copied]), np.concatenate([common, common, lengths])

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match of its suffix that starts elsewhere, streamed from the samples."""
        at = np.arange(self.size)
        reach = np.zeros(self.size, dtype=np.int64)
        np.maximum.at(reach, self.samples, self.common)
        reach += at
        return np.maximum.accumulate(reach, out=reach) - at


def repeats(contexts: list[bytes], groups: np.ndarray, match: int | tuple[int, ...] = MATCH, copies: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """(context, s, e) of the maximal runs of bytes in match-byte strings that occur twice or more within a context's group; copies of each context, 1 if not given.
    With several lengths (context, s, e, length), for each of them."""
    lengths = np.array([len(c) for c in contexts], dtype=np.int64)
    stops = np.cumsum(lengths + 1)
    symbols = np.zeros(int(stops[-1]), dtype=np.int16)
    inside = np.ones(len(symbols), dtype=bool)
    inside[stops - 1] = False
    symbols[inside] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int16) + 1
    longest = np.zeros(len(symbols), dtype=np.int32)
    several = np.zeros(len(contexts), dtype=bool) if copies is None else copies > 1
    for g in np.split(np.arange(len(contexts)), np.flatnonzero(groups[1:] != groups[:-1]) + 1):
        a, b = int(stops[g[0]] - lengths[g[0]] - 1), int(stops[g[-1]])
        own = g[several[g]]
        index = RunIndex(symbols[a:b], int(lengths[g].max()) + 1, stops[own] - lengths[own] - 1 - a, lengths[own])
        longest[a:b] = index.matching_statistics()
    of = np.repeat(np.arange(len(contexts)), lengths + 1)
    np.minimum(longest, stops[of] - 1 - np.arange(len(symbols)), out=longest, casting="same_kind")
    if isinstance(match, int):
        return _runs(longest, match, of, stops - lengths - 1)
    return [(*run, m) for m in match for run in _runs(longest, m, of, stops - lengths - 1)]


def _runs(longest: np.ndarray, match: int, of: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, s, e) of the maximal runs of bytes in strings of match bytes, by the longest match of every position; of: contexts of the positions."""
    starts = np.flatnonzero(longest >= match)
    if not len(starts):
        return []
    own = of[starts]
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] > starts[:-1] + match)])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    begin = begin[own[fresh]]
    return list(zip(own[fresh].tolist(), (starts[fresh] - begin).tolist(), (starts[last] + match - begin).tolist(), strict=True))


def _index(lengths: tuple[int, ...], block_bytes: int):
    """A task over rows (part, key, context, n, piece) sorted by part: groups of equal part are indexed, several to a call."""

    def marks(rows: pa.Table):
        part = rows.column("part").to_numpy()
        found = repeats(rows.column("piece").to_pylist(), part, lengths, rows.column("n").to_numpy())
        if found:
            which, s, e, length = map(np.array, zip(*found, strict=True))
            yield emit({"key": rows.column("key").to_numpy()[which], "context": rows.column("context").combine_chunks().take(pa.array(which)), "s": s, "e": e, "bytes": length}, MARKS)

    @frees
    def run(batches):
        held: pa.Table | None = None
        for block in blocks(batches, "piece", block_bytes):
            held = block if held is None else pa.concat_tables([held, block])
            part = held.column("part").to_numpy()
            last = int(np.argmax(part == part[-1]))
            if last:
                yield from marks(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from marks(held)

    return run


# -- Spark -----------------------------------------------------------------------------------------------------------------------------
def _filled(batches):
    """Texts with their short words filled up to WORD bytes."""
    for block in blocks(batches, "text", 1 << 20):
        texts = [SHORT.sub(lambda word: word[0].ljust(WORD, b"\xff"), t) for t in block.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"h1": block.column("h1").combine_chunks(), "h2": block.column("h2").combine_chunks(), "text": pa.array(texts, type=pa.binary())})


class Texts:
    """The distinct texts of match bytes or more as a table: h1, h2 (two 64-bit hashes), n copies, text as bytes, bucketed by the hashes.

    Spark keeps buckets only for named tables, so it has a name in the catalog until drop().
    """

    def __init__(self, docs: DataFrame, match: int):
        self.spark = docs.sparkSession
        rows = docs.filter(F.octet_length("text") >= match).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("text").alias("text"))
        self.name, self.path, parts = f"texts_{uuid.uuid4().hex}", fresh_path(self.spark, "texts"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(parts, "h1", "h2").write.bucketBy(parts, "h1", "h2").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def removed_spans(texts: DataFrame, *, match: int = MATCH, least: int | None = None, anchor: int = ANCHOR, group_limit: int = 2048, block_bytes: int = 1 << 20) -> DataFrame:
    """h1, h2, spans (array of struct s, e, bytes; overlaps not yet merged) of the distinct texts that have any; texts is Texts.rows. bytes is the length
    of the repeated strings: match, and least as well if it is given (it is match at most)."""
    lengths = (match,) if least in (None, match) else (match, least)
    found = cut(texts.select("h1", "h2", "n", "text").mapInArrow(_find_anchors(lengths[-1], anchor, match, block_bytes), "key long, context binary, h1 long, h2 long, n long, a int, b int, times int"), "anchors")
    again = cut(found.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("occurrences")).filter("occurrences > 1").select("key"), "again")
    wanted = cut(sifted(found, again, "key"), "wanted")
    done(found, again)
    contexts = cut(wanted.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct("h1", "h2", "a", "b", "times")).alias("at")), "contexts")
    keys = contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.sum(F.col("n") * F.col("at.times")).alias("occurrences")).filter("occurrences > 1")
    known = contexts.join(keys, "key").select("key", "context", "n", "at.*", "contexts")
    salted = known.withColumn("salts", F.expr(f"CAST(ceil(contexts / {group_limit}) AS INT)")).withColumn("salt", F.expr("CAST(pmod(xxhash64(context, 7), salts) AS INT)"))
    dealt = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("part", F.expr("CASE WHEN salts = 1 THEN key ELSE xxhash64(key, least(salt, other), greatest(salt, other)) END"))
    pieces = texts.select("h1", "h2", "text").join(dealt, ["h1", "h2"]).select("part", "key", "context", "n", F.expr("substring(text, a + 1, b - a)").alias("piece"))
    marks = cut(pieces.repartition("part").sortWithinPartitions("part", "key").mapInArrow(_index(lengths, block_bytes), "key long, context binary, s int, e int, bytes int"), "marks")
    spans = cut(wanted.join(marks, ["key", "context"]).groupBy("h1", "h2").agg(F.collect_set(F.struct((F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"), "bytes")).alias("spans")), "spans")
    done(wanted, contexts, marks)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _long_enough(piece: bytes, words: int) -> bool:
    """Whether a run may hold a passage of so many words, or is of MATCH bytes without what fills its words up."""
    return len(piece.split()) >= words or len(piece) - piece.count(b"\xff") >= MATCH


def _cut_texts(match: int, words: int | None, passages: int | None):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("h1", "h2", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_bytes")}
            for r in batch.to_pylist():
                text = r["text"]
                runs = merged([(x["s"], x["e"]) for x in r["spans"] if x["bytes"] == match])
                # strings of match bytes are made of the shorter ones, so all spans together are what the shorter ones cover
                counted = sum(e - s for s, e in merged([(x["s"], x["e"]) for x in r["spans"]]) if len(text[s:e].split()) >= passages) if passages else 0
                if words:
                    runs = [(s, e) for s, e in runs if _long_enough(text[s:e], words)]
                at, left = 0, []
                for s, e in runs:
                    left.append(text[at:s])
                    at = e
                kept = b"".join([*left, text[at:]])
                for name, value in zip(out, (r["h1"], r["h2"], len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), counted), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("n_passage_bytes", pa.int64())]))

    return run


def changed_texts(docs: DataFrame, columns: list[str], *, text_col: str = "text", match: int = MATCH, words: int | None = None, passages: int | None = None, **options) -> DataFrame:
    """h1, h2, and those of n_removed, n_spans, kept_sha256, kept, n_passage_bytes that are asked for, of the distinct texts that lose bytes or (with passages, see remove_repeats)
    repeat shorter strings. With words (see clean) only kept is the text's own."""
    least = min(match, passages * (WORD + 1) - 1) if passages else match
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    if words:
        with small_batches(spark):
            texts = Texts(rows.mapInArrow(_filled, "h1 long, h2 long, text binary"), least)
    else:
        texts = Texts(rows, least)
    with small_batches(spark):
        spans = removed_spans(texts.rows, match=match, least=least, **options)
    hit = texts.rows.select("h1", "h2", "text").join(spans, ["h1", "h2"]).select("h1", "h2", "text", "spans")
    with small_batches(spark):
        changed = cut(hit.mapInArrow(_cut_texts(match, words, passages), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept string, n_passage_bytes long").select("h1", "h2", *columns), "changed")
    texts.drop()
    done(spans)
    return changed


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passages: int | None = None, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    With passages, a number of words, n_passage_bytes follows: the bytes in runs of so many words or more of what repeats over passages * (WORD + 1) - 1 bytes
    (match, if that is less). What is removed does not depend on it.
    """
    changed = changed_texts(docs, ["n_removed", "n_spans", "kept_sha256", *["n_passage_bytes"] * bool(passages)], text_col=text_col, passages=passages, **options)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return rows.join(changed, ["h1", "h2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *[F.coalesce("n_passage_bytes", F.lit(0)).cast("long").alias("n_passage_bytes")] * bool(passages))


@apart
def clean(docs: DataFrame, *, text_col: str = "text", words: int | None = None, **options) -> DataFrame:
    """The rows with their repeats cut out of the text, in the input's own columns.

    With words every passage of so many words that repeats goes, however short they are, and as before what repeats over MATCH bytes.
    A character of which bytes were removed goes as a whole; a row that had words and has none left is dropped.
    """
    if words:
        options |= {"match": words * (WORD + 1) - 1, "words": words}
    changed = changed_texts(docs, ["kept"], text_col=text_col, **options).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("kept").alias("__kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(changed, (F.xxhash64(text) == F.col("__h1")) & (F.xxhash64(F.lit(1), text) == F.col("__h2")), "left")

    cleaned = joined.withColumn(text_col, F.coalesce("__kept", text_col))
    return cleaned.filter(F.col("__kept").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
