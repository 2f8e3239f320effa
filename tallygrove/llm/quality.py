"""Quality rules: word, symbol, line and repetition counts, and two perplexities, of bytes and of words, that must lie in their language's bands.

The language model is interpolated modified Kneser-Ney of order 5 over bytes, one for each value of the language column. Every byte of every text
is counted: tasks count their own partition's n-grams, Spark adds them up, and the counts of the lower orders, discounts, context weights
and probabilities are joins and grouped sums. The model is written to the shared folder as arrays sorted by n-gram hash, cut in
ranges; a scoring task looks its own distinct n-grams up range by range, so it holds one range and its own n-grams, never the whole model.

Byte n-grams saturate and know the texts they score. The word model goes by the other documents alone: a word of a document has the bits
-log2(df - 1/2), df being the number of documents of its language with the word (itself among them, so a word of its own has one bit), and a document
the mean over its words, up to log2 of the language's documents, which moves all of its documents alike. Words are runs between blanks, as bytes;
words of a single document are not in the model, since not to be found there says the same.

The bands: cross-entropies (bits a byte, bits a word) of the documents that pass the base rules give each language's median and its distances to
the lower and upper tail quantiles; a document stays within band_width of these distances from the median, in both.
Perplexity is two to that power, so the band on one is a band on the other.

Defined cases: null text has no word and fails the base rules; null language is a language of its own; a document without bytes has no
cross-entropy (null) and fails the base rules anyway; a language with no document that passes the base rules has no band;
repeated rows are scored each for itself, and count each; an empty table gives no rows. Columns other than id, text, and language are
not looked at by score(), and keep() returns the input's own columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm.common import apart, blocks, cut, discard, done, emit, first_places, frees, fresh_path, small_batches, span_classes

ORDER = 5
SYMBOLS = b"#*$%&|<>"
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
TAIL, BAND_WIDTH = 0.25, 7.0
FEW = 100_000  # rows of one a language that are broadcast: some megabytes
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _set(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


class Words:
    """The words of several texts: owner (which text each is of), code (its class of equal words), and the XXH64 of every class."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)  # every text ends in a line break of its own
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), self.lengths)
        self.inside = ~_set(BLANKS)[self.buffer]
        edge = np.diff(self.inside.astype(np.int8), prepend=0)
        self.begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.owner = self.of[self.begin]
        self.code, first = span_classes(self.buffer, self.begin, end)
        data, digest = self.buffer.data, xxhash.xxh64_intdigest
        self.digests = np.fromiter((digest(data[i:j]) for i, j in zip(self.begin[first].tolist(), end[first].tolist(), strict=True)), dtype=np.uint64, count=len(first)).view(np.int64)
        self.counts = np.bincount(self.owner, minlength=self.n)


# -- base counts -----------------------------------------------------------------------------------------------------------------------
def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n, of, buffer, owner, codes = words.n, words.of, words.buffer, words.owner, words.code
    out = {
        "n_words": words.counts,
        "word_chars": np.bincount(of[words.inside & (buffer & 0xC0 != 0x80)], minlength=n),
        "n_symbols": np.bincount(of[_set(SYMBOLS)[buffer]], minlength=n),
    }
    stop = np.flatnonzero(buffer == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    worded = np.searchsorted(words.begin, stop) > np.searchsorted(words.begin, start)
    start, stop = start[worded], stop[worded]
    line_owner, lines = of[start], span_classes(buffer, start, stop)[0]
    lines, seen = pd.factorize(lines * np.int64(n) + line_owner)
    later = np.ones(len(lines), dtype=bool)
    later[first_places(lines, len(seen))] = False
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n)
    again = np.zeros(len(codes) + 2, dtype=bool)
    if len(codes) >= 3:
        same, classes = owner[2:] == owner[:-2], len(words.digests)
        window = codes[:-2]
        for more, size in ((codes[1:-1], classes), (codes[2:], classes), (owner[2:], n)):  # numbers of pairs, of triples, and of a text's triples
            window = pd.factorize(window * np.int64(size) + more)[0]
        window = window[same]
        twice = np.flatnonzero(same)[(np.bincount(window) > 1)[window]] if len(window) else np.zeros(0, dtype=np.int64)
        for i in range(3):
            again[twice + i] = True
    out["n_repeat_words"] = np.bincount(owner[again[: len(owner)]], minlength=n)
    return out


# -- n-grams ---------------------------------------------------------------------------------------------------------------------------
def grams(texts: list[bytes]) -> np.ndarray:
    """The packed ORDER-byte string that ends at every byte (zero bytes stand before a text), text after text."""
    pad = bytes(ORDER - 1)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    buffer = np.frombuffer(b"".join(pad + t for t in texts) or b"", dtype=np.uint8).astype(np.int64)
    n = max(0, len(buffer) - ORDER + 1)
    packed = np.zeros(n, dtype=np.int64)
    for i in range(ORDER):
        packed = packed << 8 | buffer[i : i + n]
    inside = np.ones(n, dtype=bool)
    inside[(np.cumsum(lengths + ORDER - 1)[:-1, None] - ORDER + 1 + np.arange(ORDER - 1)).ravel()] = False  # windows over the border of two texts
    return packed[inside]


def _documents_with(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and in how many of the texts each is."""
    pairs = pd.factorize(words.code * np.int64(max(1, words.n)) + words.owner)[1]
    return words.digests, np.bincount(pairs // max(1, words.n), minlength=len(words.digests))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    codes, seen = pd.factorize(keys)
    return seen, np.bincount(codes, minlength=len(seen))


def _by_language(block: pa.Table):
    """(language, numbers of its rows) of a block."""
    codes, seen = pd.factorize(np.array(block.column("lang").to_pylist(), dtype=object))
    for k, lang in enumerate(seen):
        yield lang, np.flatnonzero(codes == k)


WORDS = 0  # stands for the order of a word
COUNTS = pa.schema([("order", pa.int32()), ("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    back, keys = pd.factorize(np.concatenate([k for k, _ in parts]))
    return keys, np.bincount(back, minlength=len(keys), weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _count(block_bytes: int, limit: int = 1_000_000):
    """A task that counts its n-grams, and the documents of its words, by language; it sums up what it holds beyond limit keys, and sends it on if that is still too much."""

    @frees
    def run(batches):
        held: dict[tuple[int, str], list] = {}

        def out():
            for (order, lang), parts in held.items():
                keys, n = _summed(parts)
                for i in range(0, len(keys), 100_000):
                    some = keys[i : i + 100_000]
                    yield emit({"order": np.full(len(some), order), "lang": [lang] * len(some), "gram": some, "n": n[i : i + 100_000]}, COUNTS)

        for block in blocks(batches, "text", block_bytes):
            texts = [t or b"" for t in block.column("text").to_pylist()]
            for lang, rows in _by_language(block):
                own = [texts[i] for i in rows]
                held.setdefault((ORDER, lang), []).append(_counted(grams(own)))
                held.setdefault((WORDS, lang), []).append(_documents_with(Words(own)))
            if sum(len(k) for parts in held.values() for k, _ in parts) > limit:
                held = {key: [_summed(parts)] for key, parts in held.items()}
                if sum(len(parts[0][0]) for parts in held.values()) > limit:
                    yield from out()
                    held = {}
        yield from out()

    return run


# -- the model -------------------------------------------------------------------------------------------------------------------------
def few_rows(rows: DataFrame, count: int) -> DataFrame:
    """The same rows, of which there are count (one a language): broadcast up to FEW, joined by a shuffle beyond it."""
    return F.broadcast(rows) if count <= FEW else rows


def _level(counts: DataFrame, order: int, lower: DataFrame | None, langs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, p) of one order, and (lang, gram, weight) of its contexts, which are grams of the order below. langs: how many languages there are."""
    clip = lambda x, top: F.greatest(F.lit(0.0), F.least(F.lit(top), x))
    share = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    discounts = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).select(
        "lang", *[clip(F.coalesce(i - (i + 1) * share * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i * 0.5)), float(i)).alias(f"d{i}") for i in (1, 2, 3)]
    )
    split = counts.withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1))
    sums = split.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("c1"), F.count_if(F.col("n") == 2).alias("c2"), F.count_if(F.col("n") > 2).alias("c3"))
    contexts = sums.join(few_rows(discounts, langs), "lang").withColumn("weight", F.greatest(F.lit(1e-9), F.expr("(d1 * c1 + d2 * c2 + d3 * c3) / total")))
    rows = split.join(contexts, ["lang", "context"])
    if lower is None:
        below = F.lit(1 / 256)
    else:
        rows, below = rows.join(lower.withColumnsRenamed({"gram": "suffix", "p": "q"}), ["lang", "suffix"]), F.col("q")
    taken = F.expr("greatest(0.0D, n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END)")
    p = rows.select("lang", "gram", (taken / F.col("total") + F.col("weight") * below).alias("p"))
    return p, contexts.select("lang", F.col("context").alias("gram"), "weight")


def language(column: str):
    """The language column with a value for null of its own, which no string equals."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("none"))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 1 << 20, range_rows: int = 1_000_000) -> str:
    """Path of the byte model: sorted Parquet ranges of (h, p, weight); h is the hash of language, order and gram. words_path() has the word model, whose p is df."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), language(lang_col).alias("lang"))
    counts = cut(rows.mapInArrow(_count(block_bytes), "order int, lang string, gram long, n long").groupBy("order", "lang", "gram").agg(F.sum("n").alias("n")).filter(f"order <> {WORDS} OR n > 1"), "grams")
    levels = [counts.filter(F.col("order") == ORDER).drop("order")]
    for order in range(ORDER - 1, 0, -1):  # a lower order counts the different bytes that come before
        levels.insert(0, cut(levels[0].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(F.count("*").alias("n")), "grams"))
    langs = counts.select("lang").distinct().count()
    tables, lower, kept = [], None, levels[:-1]
    for order, level in enumerate(levels, 1):
        p, weights = _level(level, order, lower, langs)
        lower = p = cut(p, "level")
        kept.append(p)
        tables.append(p.select(F.lit(order).alias("order"), "lang", "gram", "p", F.lit(None).cast("double").alias("weight")))
        tables.append(weights.select(F.lit(order - 1).alias("order"), "lang", "gram", F.lit(None).cast("double").alias("p"), "weight"))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    model = cut(every.groupBy("order", "lang", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight")).select(F.xxhash64("lang", "order", "gram").alias("h"), "p", "weight"), "model-rows")
    path = fresh_path(spark, "model")
    known = counts.filter(F.col("order") == WORDS).select(F.xxhash64("lang", "order", "gram").alias("h"), F.col("n").cast("double").alias("p"), F.lit(None).cast("double").alias("weight"))
    for rows, where in ((model, path), (known, words_path(path))):
        rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), "h").sortWithinPartitions("h").write.parquet(where)
    done(counts, model, *kept)
    return path


def words_path(path: str) -> str:
    return path + "-words"


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of arrays of longs, sorted."""
    return np.sort(pd.unique(np.concatenate([np.zeros(0, dtype=np.int64), *map(pd.unique, parts)])))


def lookup(path: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability and weight (not a number: none) of sorted, distinct hashes, from the model's ranges one batch of rows at a time."""
    p, weight = np.full(len(wanted), np.nan), np.full(len(wanted), np.nan)
    store, root = fs.FileSystem.from_uri(path)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        with store.open_input_file(info.path) as file:
            for rows in pq.ParquetFile(file).iter_batches(262_144):
                h = rows.column(0).to_numpy()
                a, b = np.searchsorted(wanted, [h[0], h[-1]], side="left") + [0, 1]
                own = wanted[a:b]
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = h[at] == own
                for out, column in ((p, 1), (weight, 2)):
                    out[a:b][hit] = rows.column(column).to_numpy(zero_copy_only=False)[at[hit]]
    return p, weight


def gram_hashes(lang: str, order: int, gram: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of (lang as string, order as int, gram as long): each value is hashed with the hash so far as the seed."""
    m = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

    def rotate(x, r):
        return x << np.uint64(r) | x >> np.uint64(64 - r)

    def final(x):
        x = (x ^ x >> np.uint64(33)) * m[1]
        x = (x ^ x >> np.uint64(29)) * m[2]
        return x ^ x >> np.uint64(32)

    with np.errstate(over="ignore"):
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42)) + m[4] + np.uint64(4)
        seed = final(rotate(seed ^ np.uint64(order) * m[0], 23) * m[1] + m[2])
        x = rotate(gram.view(np.uint64) * m[1], 31) * m[0]
        return final(rotate(seed + m[4] + np.uint64(8) ^ x, 27) * m[0] + m[3]).view(np.int64)


def log_probabilities(grams_of: dict[str, np.ndarray], path: str) -> dict[str, np.ndarray]:
    """Base-two log probability of distinct order-ORDER grams; unseen ones back off through the weights of their contexts."""
    asked: dict[str, list] = {}
    for lang, g in grams_of.items():
        ends = [g & ((1 << 8 * order) - 1) for order in range(ORDER, 0, -1)]
        asked[lang] = [_hashed(lang, order, x) for order, x in zip(range(ORDER, 0, -1), ends)] + [_hashed(lang, order - 1, x >> 8) for order, x in zip(range(ORDER, 0, -1), ends)]
    wanted = _distinct([h for x in asked.values() for h, _ in x])
    p, weight = lookup(path, wanted)
    out = {}
    for lang, x in asked.items():
        total, open_ = np.zeros(len(grams_of[lang])), np.ones(len(grams_of[lang]), dtype=bool)
        for k in range(ORDER):
            if not open_.any():
                break
            own_p, own_weight = (values[np.searchsorted(wanted, h)][codes] for values, (h, codes) in ((p, x[k]), (weight, x[ORDER + k])))
            seen = open_ & ~np.isnan(own_p)
            total[seen] += np.log2(own_p[seen])
            open_ &= ~seen
            step = open_ & ~np.isnan(own_weight)
            total[step] += np.log2(own_weight[step])
        total[open_] += np.log2(1 / 256)
        out[lang] = total
    return out


def _hashed(lang: str, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct grams, number of each gram among them)."""
    codes, seen = pd.factorize(grams)
    return gram_hashes(lang, order, seen), codes.astype(np.int32)


def word_bits(words_of: dict[str, np.ndarray], path: str) -> dict[str, np.ndarray]:
    """Bits of distinct words by the other documents that have them; path is that of train()."""
    hashes = {lang: gram_hashes(lang, WORDS, w) for lang, w in words_of.items()}
    wanted = _distinct(list(hashes.values()))
    df = np.nan_to_num(lookup(words_path(path), wanted)[0], nan=1.0)
    return {lang: -np.log2(df[np.searchsorted(wanted, h)] - 0.5) for lang, h in hashes.items()}


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BITS = ("__bits", "__word_bits")


def _texts(block: pa.Table) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else t or b"" for t in block.column("text").to_pylist()]


def _score(path: str, kept: list[str], text_col: str, block_bytes: int, chunk_bytes: int = 1 << 19):
    """A task that asks the models once for the distinct n-grams and words of a block, and then goes through the block's texts chunk by chunk.

    Rows come with the columns kept, then their language, and then the text unless it is among those kept.
    """
    names = [*("text" if c == text_col else f"k{i}" for i, c in enumerate(kept)), "lang", *(["text"] if text_col not in kept else [])]

    @frees
    def run(batches):
        renamed = (b.rename_columns(names) for b in batches)
        for block in blocks(renamed, "text", block_bytes):
            numbers: dict[str, int] = {}
            parts = [(chunk, Part(chunk, numbers)) for chunk in blocks(block.to_batches(), "text", chunk_bytes)]
            by_gram, by_word = _of_models([part for _, part in parts], list(numbers), path)
            for chunk, part in parts:
                bits, words = part.sums(by_gram, by_word)
                mean = [b / n if n else None for b, n in zip(bits.tolist(), part.lengths.tolist(), strict=True)]
                by_words = [b / n if n else None for b, n in zip(words.tolist(), part.counts["n_words"].tolist(), strict=True)]
                columns = [c.combine_chunks() for c in chunk.columns[: len(kept) + 1]] + [pa.array(part.counts[c], pa.int64()) for c in STATS] + [pa.array(mean, pa.float64()), pa.array(by_words, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "__lang", *(f"__{c}" for c in STATS), *BITS])
            del parts, by_gram, by_word, chunk, part, columns, block  # before the next block is read

    return run


class Part:
    """What is kept of a chunk of texts until the models are asked: base counts, and for every byte and word the number of its distinct n-gram or word of a language."""

    def __init__(self, chunk: pa.Table, numbers: dict[str, int]):
        texts = _texts(chunk)
        own = np.array([numbers.setdefault(x, len(numbers)) for x in chunk.column("lang").to_pylist()], dtype=np.int64)
        words = Words(texts)
        self.counts, self.lengths = base_counts(words), words.lengths - 1
        codes, self.grams = pd.factorize(np.repeat(own, self.lengths) << 8 * ORDER | grams(texts))
        self.gram_codes = codes.astype(np.min_scalar_type(len(self.grams)))
        codes, seen = pd.factorize(own[words.owner] * np.int64(max(1, len(words.digests))) + words.code)
        self.word_codes, self.word_langs, self.words = codes.astype(np.min_scalar_type(len(seen))), seen // max(1, len(words.digests)), words.digests[seen % max(1, len(words.digests))]

    def sums(self, by_gram: tuple[np.ndarray, np.ndarray], by_word: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the bytes and bits of the words of every text."""
        of_gram = by_gram[1][np.searchsorted(by_gram[0], self.grams)]
        of_word = np.zeros(len(self.words))
        for k, (known, values) in enumerate(by_word):
            mine = self.word_langs == k
            of_word[mine] = values[np.searchsorted(known, self.words[mine])]
        return _sum_runs(-of_gram[self.gram_codes], self.lengths), _sum_runs(of_word[self.word_codes], self.counts["n_words"])


def _sum_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of these lengths, one after the other."""
    out, some = np.zeros(len(lengths)), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def _of_models(parts: list[Part], langs: list[str], path: str):
    """((n-grams with their language's number, log probability), [(words, bits) of each language]) of all parts' distinct n-grams and words."""
    every = _distinct([p.grams for p in parts])
    bounds = np.searchsorted(every >> 8 * ORDER, np.arange(len(langs) + 1))
    of = log_probabilities({lang: every[a:b] & (1 << 8 * ORDER) - 1 for lang, a, b in zip(langs, bounds, bounds[1:])}, path)
    words = {lang: _distinct([p.words[p.word_langs == k] for p in parts]) for k, lang in enumerate(langs)}
    bits = word_bits(words, path)
    return (every, np.concatenate([np.zeros(0), *(of[lang] for lang in langs)])), [(words[lang], bits[lang]) for lang in langs]


def bands(scores: DataFrame, *, tail: float = TAIL, width: float = BAND_WIDTH, step: float = 0.001, bits: str = "__bits") -> DataFrame:
    """__lang, __low, __high: bits between which documents stay, from a histogram of the scores in bins of step (exact up to step)."""
    bins = scores.filter(F.col(bits).isNotNull() & ~F.col("__failed")).groupBy("__lang", F.floor(F.col(bits) / step).alias("bin")).agg(F.count("*").alias("n"))
    run = W.partitionBy("__lang").orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy("__lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * step
    marks = ranked.groupBy("__lang").agg(at(tail).alias("lo"), at(0.5).alias("mid"), at(1 - tail).alias("hi"))
    spare = F.lit(10 * step)
    return marks.select("__lang", (F.col("mid") - width * F.greatest(F.col("mid") - F.col("lo"), spare)).alias("__low"), (F.col("mid") + width * F.greatest(F.col("hi") - F.col("mid"), spare)).alias("__high"))


def judged(docs: DataFrame, kept: list[str], *, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 8 << 20, tail: float = TAIL, width: float = BAND_WIDTH) -> DataFrame:
    """The columns kept and, under names that begin with two underscores, the base counts, bits, failed and kept."""
    with small_batches(docs.sparkSession):
        path = train(docs, text_col=text_col, lang_col=lang_col)
    text = [] if text_col in kept else [F.col(text_col).cast("string").cast("binary").alias("__text")]
    rows = docs.select(*[F.col(c) for c in kept], language(lang_col).alias("__lang"), *text)
    schema = T.StructType([*rows.select(*kept, "__lang").schema.fields, *[T.StructField(f"__{c}", T.LongType()) for c in STATS], *[T.StructField(c, T.DoubleType()) for c in BITS]])
    failed = F.expr(f"__n_words < {MIN_WORDS} OR 100 * __n_repeat_words > {MAX_REPEAT_PERCENT} * __n_words")
    with small_batches(docs.sparkSession):
        scores = cut(rows.mapInArrow(_score(path, kept, text_col, block_bytes), schema).withColumn("__failed", failed), "scores")
    for where in (path, words_path(path)):
        discard(docs.sparkSession, where)
    stays, marks = ~F.col("__failed"), None
    for c in BITS:
        low, high = f"{c}_low", f"{c}_high"
        own = bands(scores, tail=tail, width=width, bits=c).withColumnsRenamed({"__low": low, "__high": high})
        marks = own if marks is None else marks.join(own, "__lang", "full")
        stays = stays & F.col(c).between(F.col(low), F.col(high))
    marks = cut(marks, "bands")
    found = scores.join(few_rows(marks, marks.count()), "__lang", "left")
    return found.withColumn("__kept", F.coalesce(stays, F.lit(False)))


def score(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept, bits (cross-entropy a byte; its power of two is the perplexity)."""
    found = judged(docs, [id_col], **options)
    return found.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f"__{c}").alias(c) for c in STATS], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__bits").alias("bits"))


@apart
def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, in the input's own columns."""
    return judged(docs, docs.columns, **options).filter("__kept").select(*docs.columns)
