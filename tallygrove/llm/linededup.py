"""Line deduplication within an edit distance, by a deletion-neighbourhood join.

Lines are the \\n-split pieces of a text that have a character other than a blank. Equal lines are one class, whose earliest place (doc_id, line number;
null doc_ids last) counts. Two lines are near if their edit distance is max_edits or less and no more than 1 - similarity of the longer one's length
(so at a similarity of 0.8 lines of under five characters have equal ones only).

Every class emits the hashes of its variants: itself, and with up to max_edits characters deleted or put as a wild card. Lines that share a variant with w
wild cards, of which one has d and the other e characters deleted, are at an edit distance of d + e + w or less, and lines at a distance share such a
variant. So for each variant and number of deletions the earliest place is found by a minimum over its rows, no pairs within a group are made, and
each class is left with the earliest place of those it may be near to. These partners are verified by edit distance on their texts.

Of lines at a distance of max_edits or less, one of max_edits + 1 equal parts of the shorter one stands in the other, moved by no more than the edits on
either side of it allow. So only classes that share a part with another class (a grouped count) are taken that far.

A line is removed if an equal or near line stands earlier. This is judged on the input: an earlier line that is itself removed still counts.

Defined cases: null, empty and blank texts have no line that takes part; rows with equal doc_id and text have equal places, and none of them
precedes the other; ties beyond that cannot occur; an empty table gives no rows; other columns of the input are kept by dedup() and not looked at.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import SpanHash, apart, blocks, cut, done, frees
from tallygrove.llm.pretokens import code_points

MAX_EDITS, SIMILARITY = 1, 0.8
WORD = r"[^\x20\x09-\x0D]"
HOT_LINES, HOT_SHARE = 1_000, 100_000
MOST_BITS = 1 << 28  # 32 MB
WILD = 0x10FFFF  # no character; a line that has it gives candidates that do not verify


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1 (hash of the text), pos, line, h1, h2 of the lines that take part."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t1"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(WORD)).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def place() -> F.Column:
    """Sorts by doc_id, null ones last, then line number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")


def spot() -> F.Column:
    """A hash of the line and its place."""
    return F.xxhash64("h1", "h2", F.coalesce("doc_id", F.lit(0)), "pos", F.col("doc_id").isNull())


def dealt(lines: DataFrame, told: DataFrame, every: int, *, hot: int = HOT_LINES, share: int = HOT_SHARE) -> DataFrame:
    """lines joined with told (h1, h2, n and more) by line. A class with more than hot lines and the share-th part of every is dealt out to as many parts as it has such numbers of
    lines: there are fewer than share such classes, and fewer than twice share parts, so their keys can be broadcast."""
    least = max(hot, every // share)
    parts = told.filter(F.col("n") > least).select("h1", "h2", F.ceil(F.col("n") / least).cast("int").alias("parts"))
    left = lines.join(F.broadcast(parts), ["h1", "h2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "pos", "t1"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = F.when(F.col("n") > least, F.sequence(F.lit(0), F.ceil(F.col("n") / least).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    return left.join(told.withColumn("part", F.explode(copies)).drop("n"), ["h1", "h2", "part"]).drop("part")


def sifted(rows: DataFrame, wanted: DataFrame, key: str, *, most: int = MOST_BITS) -> DataFrame:
    """rows without most of those whose key (a hash) is not in wanted, none of which is lost; a join on key that follows then shuffles few. The keys of wanted set bits,
    16 to a key and most at the most, in bitmaps that are broadcast: past most / 16 keys less and less is sifted out, and all the rest is as before."""
    slot = F.pmod(F.col(key), F.lit(min(most, max(1 << 15, 16 * wanted.count())))) + 1
    marked = wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).repartition("bucket")
    marks = marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("marks"))
    placed = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("bit", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.substring("marks", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(marks), "bucket").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)


def allowed(length, max_edits: int, similarity: float):
    """Edits allowed to a pair whose longer line has this length (a Column)."""
    return F.least(F.lit(max_edits), F.floor(length * (1 - similarity) + 1e-9).cast("int"))


def part_keys(max_edits: int) -> list[F.Column]:
    """Hashes of the parts of a line as the shorter of a pair, and of where the parts of a line that is 0 to max_edits characters shorter may stand in it."""
    n, parts, out = F.length("line"), max_edits + 1, []
    for shorter in range(max_edits + 1):
        cut_at = lambda i, s=shorter: F.floor((n - s) * i / parts).cast("int")
        for i in range(parts):
            for moved in range(max(-i, shorter - max_edits + i), min(i, shorter + max_edits - i) + 1):
                begin = F.greatest(cut_at(i) + moved, F.lit(0))
                out.append(F.xxhash64(F.lit(i), n - shorter, F.substring("line", begin + 1, cut_at(i + 1) - cut_at(i))))
    # a line's own parts are those it has for a partner of its length
    return out


def variants(lines: list[str], max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, characters deleted, wild cards) of the variants of every line."""
    cp, offsets = code_points(lines)
    spans, lengths = SpanHash(cp), np.diff(offsets)
    out = []
    for edits in range(max_edits + 1):
        if edits < 2:
            of = np.repeat(np.arange(len(lines)), lengths if edits else 1)
            places = np.arange(len(cp))[:, None] if edits else np.zeros((len(lines), 0), dtype=np.int64)
        else:
            own = [np.array(list(combinations(range(a, b), edits)), dtype=np.int64).reshape(-1, edits) for a, b in zip(offsets, offsets[1:])]
            of, places = np.repeat(np.arange(len(lines)), [len(x) for x in own]), np.concatenate([np.zeros((0, edits), dtype=np.int64), *own])
        for kinds in product((0, 1), repeat=edits):  # 1: a wild card
            before, at, pieces, extra = offsets[of], np.zeros(len(of), dtype=np.int64), [], []
            for k, wild in enumerate(kinds):
                pieces.append((before, places[:, k], at))
                at = at + places[:, k] - before
                if wild:
                    extra.append((WILD, at))
                    at = at + 1
                before = places[:, k] + 1
            pieces.append((before, offsets[of + 1], at))
            key = spans.joined(pieces, at + offsets[of + 1] - before, tuple(extra)).view(np.int64)
            out.append((of, key, np.full(len(of), edits - sum(kinds)), np.full(len(of), sum(kinds))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _emit_variants(max_edits: int, block_bytes: int):
    @frees
    def run(batches):
        for block in blocks(batches, "line", block_bytes):
            who, key, gone, wild = variants(block.column("line").to_pylist(), max_edits)
            whose = {c: block.column(c).combine_chunks() for c in ("h1", "h2", "no_id", "doc_id", "pos")}
            kind = block.column("n").to_numpy().astype(np.int64)[who] << 16 | wild << 8 | gone  # of the line's length, the wild cards and the deletions
            for i in range(0, len(who), 200_000):
                some = slice(i, i + 200_000)
                yield pa.RecordBatch.from_pydict({"v": key[some], "kind": kind[some]} | {c: x.take(pa.array(who[some])) for c, x in whose.items()})

    return run


def near_classes(lines: DataFrame, classes: DataFrame, *, max_edits: int, similarity: float, block_bytes: int = 1 << 18) -> DataFrame:
    """h1, h2 of the classes that have an earlier class within the edits allowed, verified. classes has the keys of part_keys()."""
    long_enough = allowed(F.col("chars") + max_edits, max_edits, similarity) > 0
    keys = classes.filter(long_enough).select("h1", "h2", F.explode(F.array_distinct("keys")).alias("part"))
    shared = keys.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    wanted = keys.join(shared, "part", "left_semi").select("h1", "h2").distinct()
    first = wanted.join(classes.select("h1", "h2", F.col("chars").alias("n"), "at.*"), ["h1", "h2"]).withColumn("where", spot())
    # the line is read at the class's earliest place: a key with one document's rows, however common the line is
    first = cut(first, "first")
    here = sifted(lines.select("line", spot().alias("where"), F.col("h1").alias("g1"), F.col("h2").alias("g2")), first, "where")
    at_place = here.join(first, "where").filter("g1 = h1 AND g2 = h2")
    texts = cut(at_place.groupBy("h1", "h2", "n", "no_id", "doc_id", "pos").agg(F.min("line").alias("line")), "lines")
    rows = texts.mapInArrow(_emit_variants(max_edits, block_bytes), "v long, kind long, h1 long, h2 long, no_id boolean, doc_id long, pos int")
    at, gone, wild = F.struct("no_id", "doc_id", "pos", "h1", "h2"), F.col("kind").bitwiseAND(255), F.shiftright("kind", 8).bitwiseAND(255)
    # dealt by variant once; the places are put together behind that shuffle. A variant's lines differ from it by max_edits characters, so its rows are few however many copies a line has
    least = [F.min(F.when(gone == e, at)).over(Window.partitionBy("v")).alias(f"m{e}") for e in range(max_edits + 1)]
    joined = rows.repartition("v").select("*", *least).select("*", at.alias("at"), gone.alias("gone"), wild.alias("wild"), F.shiftright("kind", 16).cast("int").alias("n"))
    # the other's length is n - gone + e
    fits = [F.when(F.col("gone") + F.col("wild") + e <= allowed(F.greatest(F.col("n"), F.col("n") - F.col("gone") + e), max_edits, similarity), F.col(f"m{e}")) for e in range(max_edits + 1)]
    partner = fits[0] if len(fits) == 1 else F.least(*fits)
    pairs = joined.withColumn("partner", partner).filter("partner < at").select("h1", "h2", F.col("partner.h1").alias("q1"), F.col("partner.h2").alias("q2")).distinct()
    other = texts.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("line").alias("other"))
    verified = pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).join(other, ["q1", "q2"])
    near = F.levenshtein("line", "other", max_edits).between(F.lit(0), allowed(F.greatest(F.length("line"), F.length("other")), max_edits, similarity))
    out = cut(verified.filter(near).select("h1", "h2").distinct().withColumn("near", F.lit(True)), "near")
    done(first, texts)
    return out


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t1, removed (sorted line numbers), removed_chars of the documents that lose a line."""
    lines = lines_of(docs, id_col, text_col)
    keys = part_keys(max_edits)
    own = lines.select("h1", "h2", "doc_id", "pos", F.length("line").alias("chars"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    grouped = own.groupBy("h1", "h2").agg(F.min(place()).alias("at"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("chars", *(f"k{i}" for i in range(len(keys))))])
    classes = cut(grouped.select("h1", "h2", "at", "n", "chars", F.array(*[f"k{i}" for i in range(len(keys))]).alias("keys")), "classes")
    near = near_classes(lines, classes, max_edits=max_edits, similarity=similarity)
    told = classes.select("h1", "h2", "at", "n").join(near, ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", "n", "at", "near")
    every = classes.agg(F.sum("n")).first()[0] or 0
    places = dealt(lines.select("doc_id", "t1", "pos", "h1", "h2", F.length("line").alias("chars")), told, every).filter(F.col("near").isNotNull() | (F.col("at") < place()))
    return places.groupBy("doc_id", "t1").agg(F.array_sort(F.collect_set("pos")).alias("removed"), F.collect_set(F.struct("pos", "chars")).alias("sized")).select("doc_id", "t1", "removed", F.expr("aggregate(sized, 0L, (a, x) -> a + x.chars)").alias("removed_chars"))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_chars, removed (line numbers from 0, joined by commas) of every row."""
    lost = removed_lines(docs, id_col=id_col, text_col=text_col, max_edits=max_edits, similarity=similarity).withColumnRenamed("doc_id", "lost_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t1"), F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = rows.join(lost.withColumnRenamed("t1", "lost_t1"), F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("t1") == F.col("lost_t1")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_chars", F.lit(0)).cast("long").alias("removed_chars"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


@apart
def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows with their removed lines taken out, in the input's own columns. A row that had words and has none left is dropped."""
    lost = removed_lines(docs, id_col=id_col, text_col=text_col, max_edits=max_edits, similarity=similarity).select(F.col("doc_id").alias("__lost_id"), F.col("t1").alias("__lost_t1"), F.col("removed").alias("__removed"))
    joined = docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("__lost_id")) & (F.xxhash64(F.col(text_col)) == F.col("__lost_t1")), "left")

    left = F.filter(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col("__removed"), i))
    cleaned = joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return cleaned.filter(F.col("__removed").isNull() | F.col(text_col).rlike(WORD)).select(*docs.columns)
