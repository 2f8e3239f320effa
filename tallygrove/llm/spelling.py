"""Grouping of spelling variants: words that one inserted, deleted or replaced code point tells apart, by rolling-hash deletion keys.

Words are the maximal runs of LETTERS, A-Z in lower case; some lose a code point by a checksum of their document (misspelled()), so that any corpus has
variants. They are counted over all documents by a partial aggregate, and those of min_length code points and min_count occurrences take part.

1. Every word gives its own key and one for each of its deletions. A running polynomial over a block's code points has the hash of every prefix and suffix,
   so the key of a deletion is the sum of two numpy integers, and no deleted string is built.
2. Keys are dealt out by their leading bits (radix) and sorted within a partition; those that stand alone go. A row is a key, a word's number and a place.
3. What is left meets the words again, and within equal keys rows are told apart by the deleted strings themselves, so equal keys of different strings do
   no harm. Words that give the same string at the same place differ by a replacement there; a word that is itself that string differs from those that give
   it by an insertion. Every row of such a group needs only the group's size and its two best words: no pairs are made.
4. The parts are added up for every word: near words are counted exactly once, as two words have one place of replacement or one deleted string in common.
5. Forms at least double the count at each step, so a chain has at most 62 of them and pointer doubling finds the roots in 6 joins.

Groups cannot be hot: a string at a place has as many words as there are letters (90), and a string of n code points at most 90 (n + 1) words around it.

Defined cases: null and empty texts have no word; null doc_ids count as an empty doc_id in the checksum; repeated rows count again; words of equal n are
ordered by code points; a table without a word gives no rows; other columns are not looked at; a word's length is not limited, and its keys take memory in
proportion to it.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import SpanHash, blocks, cut, done, frees
from tallygrove.llm.pretokens import code_points

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELLED = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
RADIX_BITS = 16
STEPS = 6  # doublings that follow 64 forms
PARTS = pa.schema([("word", pa.string()), ("near", pa.int64()), ("n", pa.int64()), ("best", pa.string())])


def misspelled(doc_id, run) -> F.Column:
    """The run, or (where the crc32 of doc_id:run is a multiple of MISSPELLED) the run without its code point number crc32 % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % MISSPELLED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n, its occurrences over all documents, of the words that take part."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    found = runs.filter(F.length("run") >= min_length).select(misspelled(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return found.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, place of the deleted code point, key) of all deletions of all words, and of the words themselves at place -1."""
    cp, offsets = code_points(texts)
    spans, lengths = SpanHash(cp), np.diff(offsets)
    whole, of, place = np.arange(len(texts)), np.repeat(np.arange(len(texts)), lengths), np.arange(len(cp))
    prefix, suffix = (offsets[of], place, 0), (place + 1, offsets[of + 1], place - offsets[of])
    keys = [spans.of(offsets[:-1], offsets[1:]), spans.joined([prefix, suffix], lengths[of] - 1)]
    return np.concatenate([whole, of]), np.concatenate([np.full(len(texts), -1), place - offsets[of]]), np.concatenate(keys)


def _emit_keys(block_bytes: int):
    @frees
    def run(batches):
        for block in blocks(batches, "word", block_bytes):
            numbers = block.column("id").to_numpy()
            who, place, key = deletion_keys(block.column("word").to_pylist())
            for i in range(0, len(who), 200_000):
                some = slice(i, i + 200_000)
                yield pa.RecordBatch.from_pydict({"radix": (key[some] >> np.uint64(64 - RADIX_BITS)).astype(np.int32), "key": key[some].view(np.int64), "id": numbers[who[some]], "place": place[some].astype(np.int32)})

    return run


def _repeated(batches):
    """Of rows sorted by key those whose key another row has."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = rows.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        same = key[1:last] == key[: max(last - 1, 0)]
        keep = np.append(same, False) | np.append(False, same) if last else np.zeros(0, dtype=bool)
        yield from rows.slice(0, last).filter(pa.array(keep)).select(["key", "id", "place"]).combine_chunks().to_batches()
        held = rows.slice(last).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield from held.select(["key", "id", "place"]).to_batches()


def _better(a: tuple[int, str]) -> tuple[int, str]:
    """Sorts words (n, word) by falling n, then code points."""
    return -a[0], a[1]


def group_parts(rows: list[tuple[str, int, int]]):
    """Of the rows (word, place, n) of one deleted string: (word, its near words here, the best of them as n and word)."""
    itself = [(n, w) for w, place, n in rows if place < 0]
    longer = sorted({(n, w) for w, place, n in rows if place >= 0}, key=_better)
    if itself and longer:
        (n, w), best = itself[0], longer[0]
        yield w, len(longer), *best
        for _, x in longer:
            yield x, 1, n, w
    for place, same in groupby(sorted((r for r in rows if r[1] >= 0), key=lambda r: r[1]), key=lambda r: r[1]):
        ranked = sorted(((n, w) for w, _, n in same), key=_better)
        for k, (_, w) in enumerate(ranked if len(ranked) > 1 else []):
            yield w, len(ranked) - 1, *ranked[0 if k else 1]


def _verified_parts(batches):
    """group_parts() of the groups of equal deleted strings among rows (key, word, n, place) sorted by key."""

    def flush(rows):
        by: dict[str, list] = {}
        for _, word, n, place in rows:
            by.setdefault(word if place < 0 else word[:place] + word[place + 1 :], []).append((word, place, n))
        for same in by.values():
            if len(same) > 1:
                yield from group_parts(same)

    def emit(parts):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*parts, strict=True), PARTS, strict=True)], schema=PARTS)

    held, out = [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "place")), strict=True):
            if held and held[0][0] != row[0]:
                out.extend(flush(held))
                held = []
                if len(out) > 50_000:
                    yield emit(out)
                    out = []
            held.append(row)
    out.extend(flush(held))
    if out:
        yield emit(out)


def near_words(vocabulary: DataFrame, *, block_bytes: int = 1 << 18) -> DataFrame:
    """word, n_near, best (struct n, word: the near word of largest n) of the words that have a near word; vocabulary has id (unique), word (distinct), n."""
    keys = vocabulary.select("id", "word").mapInArrow(_emit_keys(block_bytes), "radix int, key long, id long, place int")
    repeated = cut(keys.repartition("radix").sortWithinPartitions("key").mapInArrow(_repeated, "key long, id long, place int"), "deletions")
    met = repeated.join(vocabulary, "id").select("key", "word", "n", "place")
    parts = met.repartition("key").sortWithinPartitions("key").mapInArrow(_verified_parts, "word string, near long, n long, best string")
    found = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "best")).alias("b"))
    out = cut(found.select("word", "n_near", F.struct((-F.col("b.n")).alias("n"), F.col("b.best").alias("word")).alias("best")), "near")
    done(repeated)
    return out


def roots(forms: DataFrame, steps: int = STEPS) -> DataFrame:
    """word and root of the words that have a form: the last one reached from word by forms. forms has word and form, without nulls or cycles."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(steps):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done(before)
        if not now.filter("moved").head(1):
            break
    return now.select("word", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that takes part; ratio (2 or more): how often as frequent a form must be."""
    if ratio < 2:
        raise ValueError("forms must at least double the count")
    vocabulary = cut(words(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = near_words(vocabulary)
    joined = vocabulary.select("word", "n").join(near, "word", "left")
    takes = F.col("best.n") >= ratio * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, F.col("best.n")).alias("form_n")), "forms")
    done(vocabulary, near)
    last = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
