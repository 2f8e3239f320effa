"""Lossless WebP media columns: payload bytes to VP8L images and back to pixel arrays.

The decoder reads prefix codes (simple and normal), meta prefix groups, back-references with the two-dimensional distance codes, the
colour cache, and inverts the predictor, cross-colour, subtract-green and palette (with pixel bundling) transforms. The encoder writes
literals and back-references at any distance, and on request each of the transforms and the colour cache.

Like the images of a crawl, those of a stored column are of several forms (FORMS), which need every part of the decoder: with a palette where there
are 256 colours at most, with green subtracted and a colour cache, or with a predictor and cross-colour. A checksum of the pixels says which; the
predictor's mode (left or above) is the one with the smaller residues. Photographs gain by the last form, texts do
not: on texts of documents the mix takes 0.78 bytes a byte, and back-references alone would take 0.50.

A payload is stored as an RGB image of 192 pixels (576 bytes) a row; one longer than max_rows rows is a sequence of such images, one WebP file
after the other. Rows are encoded and decoded each for itself, so a task's memory is bounded by its longest text.

Defined cases: null text is empty; an empty text is one row of 255s; equal texts give equal media and features; repeated rows and null
doc_ids are kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import blocks, cut, emit, frees

ROW, PIXELS = 576, 192
MAX_ROWS = 16_384  # the format's largest height
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LIMIT = 11  # bits of the encoder's longest code

# Fixed values of the format: the order in which code length codes are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
# The format's near distances, as (pixels to the left, rows up): by distance, then by how far to the side, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# -- prefix codes ----------------------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _mirrored() -> list[int]:
    """Every number of 15 bits with its bits in reverse."""
    x = np.arange(1 << 15)
    return sum((x >> k & 1) << 14 - k for k in range(15)).tolist()


def canonical(lengths: list[int] | bytes) -> dict[int, tuple[int, int]]:
    """(code as it is read, least significant bit first; bits) of every symbol that has one."""
    code, before, out, mirrored = 0, 0, {}, _mirrored()
    for symbol in sorted([s for s, n in enumerate(lengths) if n], key=lengths.__getitem__):
        bits = lengths[symbol]
        code <<= bits - before
        before = bits
        out[symbol] = (mirrored[code << 15 - bits], bits)
        code += 1
    return out


def complete(lengths: bytes) -> int:
    """Bits of the longest code; an incomplete or overfull prefix code is an error."""
    top = max(lengths, default=0)
    if not top or sum(1 << top - n for n in lengths if n) != 1 << top:
        raise ValueError("a prefix code is not complete")
    return top


@lru_cache(maxsize=64)
def reading_table(lengths: bytes, shift: int = 0) -> tuple[list[tuple[int, int]], int]:
    """(table, mask): the symbol (shifted) that the next bits & mask stand for, and its bits. A lone symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [(used[0] << shift, 0)], 0
    top = complete(lengths)
    table = [(0, 0)] * (1 << top)
    for symbol, (code, n) in canonical(lengths).items():
        table[code :: 1 << n] = [(symbol << shift, n)] * (1 << top - n)
    return table, (1 << top) - 1


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    x = np.arange(1 << bits)
    return sum((x >> k & 1) << bits - 1 - k for k in range(bits)) if bits else x


def packed_table(lengths: bytes) -> tuple[np.ndarray, int]:
    """(symbol << 4 | bits for the next bits of the stream, how many those are) of a code of LIMIT bits at most."""
    n = np.frombuffer(lengths, dtype=np.uint8)
    used = np.flatnonzero(n)
    if len(used) == 1:
        return used << 4, 0
    order = used[np.argsort(n[used], kind="stable")]
    size = n[order].astype(np.int64)
    top = int(size[-1]) if len(size) else 0
    share = 1 << top - size
    if not top or share.sum() != 1 << top:
        raise ValueError("a prefix code is not complete")
    out = np.empty(1 << top, dtype=np.int64)
    out[_reversed(top)] = np.repeat(order << 4 | size, share)
    return out, top


def code_lengths(counts: np.ndarray, lane: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman code lengths of many codes at once: counts of their used symbols, sorted by code (lane); a code's counts are halved until no length is over the limit."""
    lengths, live = np.ones(len(counts), dtype=np.int64), np.flatnonzero(np.bincount(lane)[lane] > 1)  # a lone symbol has length 1
    while len(live):
        own = np.unique(lane[live], return_inverse=True)[1]
        lengths[live] = depth = _depths(counts[live], own)
        over = np.zeros(own[-1] + 1, dtype=bool)
        over[own[depth > limit]] = True
        live = live[over[own]]
        counts = (counts + 1) // 2
    return lengths


def _depths(counts: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Depths of the leaves in the Huffman trees of lanes 0, 1 and so on, of two leaves or more; a step joins the two least nodes of every lane that has two.

    Nodes of a lane stand by rising count, leaves and joined ones each in a row, so the least is the first of one row; of equal ones a leaf goes first.
    """
    size = np.bincount(lane)
    order = np.lexsort((counts, lane))
    room, by = 2 * size + 1, np.argsort(-size, kind="stable")
    base = np.cumsum(room) - room  # a lane's leaves, a number over all others, its joined nodes, and one such number more
    leaves = base[lane] + np.arange(len(lane)) - (np.cumsum(size) - size)[lane]
    value = np.full(int(room.sum()), 1 << 60, dtype=np.int64)
    value[leaves] = counts[order]
    parent = np.arange(len(value))
    leaf, joined, active = base[by], (base + size + 1)[by], np.searchsorted(-size[by], -np.arange(1, size.max()), side="left")
    first = joined.copy()
    for step, n in enumerate(active.tolist()):
        if n < len(leaf):
            leaf, joined, first = leaf[:n], joined[:n], first[:n]
        new, total = first + step, 0
        for _ in range(2):
            x, y = value.take(leaf), value.take(joined)
            is_leaf = x <= y
            parent[np.where(is_leaf, leaf, joined)] = new
            total = total + np.minimum(x, y)
            leaf = leaf + is_leaf
            joined = joined + ~is_leaf
        value[new] = total
    depth = (parent != np.arange(len(parent))).astype(np.int64)
    while True:
        depth += depth[parent]
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    out = np.empty(len(lane), dtype=np.int64)
    out[order] = depth[leaves]
    return out


def codes_of(lengths: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code as it is read, bits) of the used symbols of many codes, sorted by code (lane) and symbol. A lone symbol takes no bits."""
    order = np.lexsort((lengths, lane))
    share = np.int64(1) << 15 - lengths[order]
    n = np.bincount(lane)
    before = np.cumsum(share) - share
    before -= np.repeat(before[(np.cumsum(n) - n)[n > 0]], n[n > 0])
    code, bits = np.empty(len(lane), dtype=np.int64), lengths.copy()
    code[order] = _reversed(15)[before]
    bits[n[lane] == 1] = 0
    return code, bits


# -- writing ---------------------------------------------------------------------------------------------------------------------------
class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def scatter(words: np.ndarray, at: np.ndarray, values: np.ndarray, chunk: int = 1 << 17) -> None:
    """Add to a stream, as numbers of 32 bits each, values of up to 48 bits at these rising places, which do not overlap."""
    for c in range(0, len(at), chunk):
        value, place = values[c : c + chunk].astype(np.uint64), at[c : c + chunk]
        word, shift = place >> 5, (place & 31).astype(np.uint64)
        first = int(word[0])
        low, high = (value & np.uint64(0xFFFF_FFFF)) << shift, value >> np.uint64(32) << shift
        for k, part in enumerate((low & np.uint64(0xFFFF_FFFF), (low >> np.uint64(32)) + (high & np.uint64(0xFFFF_FFFF)), high >> np.uint64(32))):
            sums = np.bincount(word - first, weights=part.astype(np.float64)).astype(np.uint64)
            words[first + k : first + k + len(sums)] += sums


OWN = [4] * 13 + [5] * 6  # lengths of a complete code for all 19 symbols of code lengths


@lru_cache(maxsize=1)
def _preamble() -> tuple[int, int]:
    """(bits, how many) of a code of many symbols, up to the lengths."""
    out = Writer()
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(OWN[s], 3)
    out.put(0, 1)
    return out.value, out.n


def put_codes(symbols: np.ndarray, lengths: np.ndarray, lane: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, value, bits) of what writes prefix codes, in order: their used symbols, sorted by code (lane) and symbol, and how many symbols each could have."""
    n = np.bincount(lane, minlength=len(alphabet))
    last = np.cumsum(n) - 1
    lanes = np.arange(len(alphabet))
    simple = (n <= 2) & (symbols[last] < 256)
    # few symbols: what kind, then the symbols
    own = simple[lane]
    few = [np.flatnonzero(simple), lane[own]], [5 + 2 * (n[simple] - 1), symbols[own]], [np.full(simple.sum(), 3), np.full(own.sum(), 8)]
    # many: what the lengths are written by, each length after the zeros before it, and the zeros at the end
    many, own = np.flatnonzero(~simple), ~own
    value, bits = _preamble()
    before = np.concatenate([[-1], symbols[:-1]])
    before[last - n + 1] = -1
    where = np.concatenate([lane[own], many])
    zeros = np.concatenate([(symbols - before - 1)[own], (alphabet - 1 - symbols[last])[many]])
    length = np.concatenate([lengths[own], np.full(len(many), NO_LENGTH)])
    order = np.argsort(where, kind="stable")
    where, zeros, length = where[order], zeros[order], length[order]
    table, sizes = _lengths_after()
    entry = zeros % 138 * (NO_LENGTH + 1) + length
    value_of, size_of = table[entry], sizes[entry]
    full = zeros // 138  # runs of 138 zeros
    if full.any():
        again = np.repeat(np.arange(len(where)), full + 1)
        rest = np.append(again[1:] != again[:-1], True)
        (run,), (run_bits,) = (x[[138 * (NO_LENGTH + 1) + NO_LENGTH]] for x in (table, sizes))
        where, value_of, size_of = where[again], np.where(rest, value_of[again], run), np.where(rest, size_of[again], run_bits)
    lanes = np.concatenate([*few[0], many, many, where])
    values = np.concatenate([*few[1], np.full(len(many), value & 0xFFFF_FFFF), np.full(len(many), value >> 32), value_of])
    sizes = np.concatenate([*few[2], np.full(len(many), 32), np.full(len(many), bits - 32), size_of])
    order = np.argsort(lanes, kind="stable")
    return lanes[order], values[order], sizes[order]


@lru_cache(maxsize=1)
def _own_codes() -> dict[int, tuple[int, int]]:
    return canonical(OWN)


NO_LENGTH = 16


@lru_cache(maxsize=1)
def _lengths_after() -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many) of 0 to 138 code lengths of zero and one more length, or NO_LENGTH, row by row."""
    found = [_length_after(zeros, length if length < NO_LENGTH else None) for zeros in range(139) for length in range(NO_LENGTH + 1)]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True))


def _length_after(zeros: int, length: int | None) -> tuple[int, int]:
    """(bits, how many) of so many code lengths of zero and one more length, if any."""
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    while zeros >= 11:
        tokens.append((18, min(zeros, 138) - 11, 7))
        zeros -= min(zeros, 138)
    if zeros >= 3:
        tokens.append((17, zeros - 3, 3))
    elif zeros:
        tokens += [(0, 0, 0)] * zeros
    if length is not None:
        tokens.append((length, 0, 0))
    codes, value, size = _own_codes(), 0, 0
    for s, extra, bits in tokens:
        code, n = codes[s]
        value |= (code | extra << n) << size
        size += n + bits
    return value, size


def prefix_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, extra values, extra bits) of lengths or distances from 1 on."""
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> extra & 1)), v & (1 << extra) - 1, extra


def cache_index(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFF_FFFF)) >> (32 - bits).astype(np.uint64)).astype(np.int64)


def by_place(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): keys of 64 bits, of which the first 40 count (fewer past 16 million), in their order, and equal ones by place; one sort of plain numbers is the fastest."""
    bits = np.uint64(max(24, len(key).bit_length()))
    packed = np.sort(key >> bits << bits | np.arange(len(key), dtype=np.uint64))
    return packed >> bits, (packed & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def references(argb: np.ndarray, least: int = 4, longest: int = 4096, farthest: int = 100_000, of: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, from the left as they come: each place is matched with the last one before it that has the same least pixels.

    With of (the number of the image that each pixel is in, rising) images stand one after the other, and each is matched within itself.
    """
    n = len(argb) - least + 1
    if n < 2:
        return []
    key = argb.astype(np.uint64)[:n]
    for k in range(1, least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + argb[k : k + n].astype(np.uint64)
    key, order = by_place(key * np.uint64(0x9E3779B97F4A7C15))  # the last pixel reaches the leading bits, too
    again = np.flatnonzero(key[1:] == key[:-1])
    here, before = order[again + 1], order[again]
    same = here - before <= farthest
    if of is not None:
        same &= of[here + least - 1] == of[before]
    for k in range(least):
        same &= argb[here + k] == argb[before + k]
    distance = np.zeros(n + 1, dtype=np.int64)
    distance[here[same]] = (here - before)[same]
    change = np.flatnonzero(np.diff(distance, prepend=0))
    edge = change[distance[change] > 0]
    if not len(edge):
        return []
    stop = change[np.searchsorted(change, edge, side="right")]
    out, covered = [], 0
    for s, e, d in zip(edge.tolist(), stop.tolist(), distance[edge].tolist(), strict=True):
        b = max(s, covered)
        if b < e:
            covered = e + least - 1
            for at in range(b, covered, longest):
                out.append((at, min(longest, covered - at), d))
    return out


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """Distance in pixels to the first near code that stands for it."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, y * width + x), code)
    return out


@lru_cache(maxsize=512)
def _near_table(width: int) -> np.ndarray:
    """The code of every distance that has a near one, 0 for the others."""
    near = _near_codes(width)
    out = np.zeros(max(near) + 1, dtype=np.int64)
    out[list(near)] = list(near.values())
    return out


def distance_codes(distances: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes of distances in images of these widths."""
    known, which = np.unique(widths, return_inverse=True)
    tables = [_near_table(w) for w in known.tolist()]
    sizes = np.array([len(t) for t in tables], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    near = np.concatenate([*tables, [0]])[starts[which] + np.minimum(distances, sizes[which] - 1)]
    return np.where((distances < sizes[which]) & (near > 0), near, distances + 120)


def put_images(images: list[tuple[np.ndarray, int, int, bool]]) -> list[tuple[int, int]]:
    """(bits, how many) of entropy-coded images (pixels, width, bits of the colour cache, whether it is a main one): literals, back-references, and colour cache hits.

    The images are written side by side: a step is one for all of them.
    """
    count = len(images)
    sizes = np.array([len(a) for a, *_ in images], dtype=np.int64)
    widths, cache_bits, main = (np.array([image[k] for image in images], dtype=np.int64) for k in (1, 2, 3))
    argb, of = np.concatenate([a for a, *_ in images]), np.repeat(np.arange(count, dtype=np.int32), sizes)
    n = len(argb)
    runs, length, distance = np.array(references(argb, of=of), dtype=np.int64).reshape(-1, 3).T
    covered = np.zeros(n + 1, dtype=np.int8)
    np.add.at(covered, runs, 1)
    np.add.at(covered, runs + length, -1)
    literal = np.cumsum(covered[:n], dtype=np.int8) == 0
    hit = np.zeros(n, dtype=bool)
    index = np.zeros(n, dtype=np.int32)
    held = np.flatnonzero(cache_bits[of])
    if len(held):
        index[held] = cache_index(argb[held], cache_bits[of[held]])
        order = held[by_place((of[held].astype(np.int64) << int(cache_bits.max()) | index[held]).astype(np.uint64) << np.uint64(max(24, len(held).bit_length())))[1]]
        hit[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (index[order[1:]] == index[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    plain, cached = np.flatnonzero(literal & ~hit), np.flatnonzero(literal & hit)
    channels = {c: (argb[plain] >> k & 255).astype(np.int32) for c, k in (("g", 8), ("r", 16), ("b", 0), ("a", 24))}
    near_symbol, extra, more = prefix_symbols(length)
    far_symbol, extra_far, more_far = prefix_symbols(distance_codes(distance, widths[of[runs]]))
    who, who_cached, who_run = of[plain], of[cached], of[runs]
    # lanes: the codes of green, of red and blue, of alpha, and of distances, image by image
    room = 280 + (1 << int(cache_bits.max()) if cache_bits.any() else 0)
    seen = {
        "g": (np.concatenate([who, who_cached, who_run]), np.concatenate([channels["g"], index[cached] + 280, near_symbol + 256])),
        "r": (np.concatenate([who, who]), np.concatenate([channels["r"], channels["b"]])),
        "a": (who, channels["a"]),
        "d": (who_run, far_symbol),
    }
    counts = np.concatenate([np.bincount(lane * np.int64(room) + symbol, minlength=count * room).reshape(count, room) for lane, symbol in seen.values()])
    counts[~counts.any(axis=1), 0] = 1
    alphabet = np.concatenate([280 + np.where(cache_bits > 0, 1 << cache_bits, 0), np.full(2 * count, 256), np.full(count, 40)])
    lane, symbol = np.nonzero(counts)
    lengths = code_lengths(counts[lane, symbol], lane)
    tables = np.zeros((2, 4 * count * room), dtype=np.int64)
    tables[:, lane * room + symbol] = codes_of(lengths, lane)
    whose, values, bits = put_codes(symbol, lengths, lane, alphabet)
    parts = [(np.arange(count), np.where(cache_bits > 0, 1 | cache_bits << 1, 0), np.where(cache_bits > 0, 5, 1) + main)]
    for k in (0, 1, 1, 2, 3):  # red and blue share a code
        a, b = np.searchsorted(whose, [k * count, (k + 1) * count])
        parts.append((whose[a:b] - k * count, values[a:b], bits[a:b]))

    def coded(k: int, image: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (k * count + image.astype(np.int64)) * room + symbol
        return tables[0].take(at), tables[1].take(at)

    value, bits = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    own_value, own_bits = coded(0, who, channels["g"])
    for k, c in ((1, "r"), (1, "b"), (2, "a")):
        code, size = coded(k, who, channels[c])
        own_value |= code << own_bits
        own_bits += size
    value[plain], bits[plain] = own_value, own_bits
    del own_value, own_bits, code, size, channels, seen, who
    value[cached], bits[cached] = coded(0, who_cached, index[cached] + 280)
    (code, size), (code_far, size_far) = coded(0, who_run, near_symbol + 256), coded(3, who_run, far_symbol)
    value[runs] = code | extra << size | (code_far | extra_far << size_far) << size + more
    bits[runs] = size + more + size_far + more_far
    written = literal
    written[runs] = True
    parts.append((of[written], value[written], bits[written]))
    del value, bits, of, index, argb
    # where all that stands: parts one after the other in an image, which begins at a whole byte
    totals = np.array([np.bincount(image, weights=size, minlength=count) for image, _, size in parts]).astype(np.int64)
    starts, room = np.cumsum(totals, axis=0) - totals, totals.sum(axis=0) + 7 >> 3
    base = np.cumsum(room) - room
    words = np.zeros(int(room.sum()) // 4 + 3, dtype=np.uint64)
    for (image, value, size), total, start in zip(parts, totals, starts, strict=True):
        scatter(words, (8 * base + start - (np.cumsum(total) - total))[image] + np.cumsum(size) - size, value)
    stream = words.astype("<u4").tobytes()
    return [(int.from_bytes(stream[b : b + r], "little"), size) for b, r, size in zip(base.tolist(), room.tolist(), totals.sum(axis=0).tolist(), strict=True)]


@lru_cache(maxsize=4096)
def _even_image(pixel: int, n: int, width: int) -> tuple[int, int]:
    """(bits, how many) of an image of n equal pixels."""
    return put_images([(np.full(n, pixel, dtype=np.int64), width, 0, False)])[0]


def encode(rgb: np.ndarray, width: int, **form) -> bytes:
    """A WebP file of rows of RGB pixels (array of n x 3)."""
    return encode_many([(rgb, width, form)])[0]


def encode_many(images: list[tuple[np.ndarray, int, dict]]) -> list[bytes]:
    """WebP files of images: rows of RGB pixels (array of n x 3), the width, and the options of transformed()."""
    made = [transformed(rgb, width, **form) for rgb, width, form in images]
    palettes = [(table, len(table), 0, False) for parts, _ in made for table in parts if isinstance(table, np.ndarray)]
    tables = iter(put_images(palettes) if palettes else [])
    files = []
    for (parts, _), body in zip(made, put_images([main for _, main in made]) if made else [], strict=True):
        out = Writer()
        for part in [*parts, body]:
            out.put(*(next(tables) if isinstance(part, np.ndarray) else part))
        data = out.bytes()
        chunk = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
        files.append(b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk)
    return files


def transformed(rgb: np.ndarray, width: int, *, cache_bits: int = 0, transforms: tuple[int, ...] = (), mode: int = 1, block_bits: int = 4) -> tuple[list, tuple[np.ndarray, int, int, bool]]:
    """(what stands before the main image: bits and how many, or a palette's pixels; the main image for put_images()). Transforms are applied in the order given, each at most once."""
    argb = (0xFF000000 | rgb[:, 0].astype(np.int64) << 16 | rgb[:, 1].astype(np.int64) << 8 | rgb[:, 2]).astype(np.int64)
    height = len(argb) // width
    parts: list = [(0x2F, 8), (width - 1 | height - 1 << 14, 32)]
    now = width
    for kind in transforms:
        parts.append((1 | kind << 1, 3))
        if kind in (PREDICTOR, CROSS_COLOUR):
            parts.append((block_bits - 2, 3))
            tiles = ((now + (1 << block_bits) - 1) >> block_bits) * ((height + (1 << block_bits) - 1) >> block_bits)
            element = 0xFF000000 | (mode << 8 if kind == PREDICTOR else 5 << 16 | 250 << 8 | 7)
            parts.append(_even_image(element, tiles, (now + (1 << block_bits) - 1) >> block_bits))
            argb = _minus(argb, predicted(argb, now, mode)) if kind == PREDICTOR else cross_colour(argb, np.full(len(argb), element), -1)
        elif kind == SUBTRACT_GREEN:
            green = argb >> 8 & 255
            argb = _minus(argb, green << 16 | green)
        else:
            table, argb = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette holds 256 colours at most")
            parts += [(len(table) - 1, 8), _minus(table, np.concatenate([[0], table[:-1]]))]
            argb, now = bundle(argb, now, len(table))
    parts.append((0, 1))
    return parts, (argb, now, cache_bits, True)


# -- transforms ------------------------------------------------------------------------------------------------------------------------
def _bytes(argb: np.ndarray) -> np.ndarray:
    """n x 4 array of blue, green, red and alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(-1, 4)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    return (_bytes(a) - _bytes(b)).view("<u4").ravel().astype(np.int64)


def _plus(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def _clamped(parts) -> int:
    out = 0
    for x in parts:
        out = out << 8 | max(0, min(255, x))
    return out


def _full(left: int, top: int, corner: int) -> int:
    return _clamped(a + b - c for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True))


def _half(x: int, corner: int) -> int:
    return _clamped(a + int((a - c) / 2) for a, c in zip(_channels(x), _channels(corner), strict=True))


def prediction(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The value a mode predicts from the pixels to the left, above, above right, and above left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), top)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, top)
        case 8:
            return _mean(corner, top)
        case 9:
            return _mean(top, right)
        case 10:
            return _mean(_mean(left, corner), _mean(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _full(left, top, corner)
        case 13:
            return _half(_mean(left, top), corner)
    return 0xFF000000


def _around(px, i: int, width: int, mode: int) -> int:
    if i == 0:
        return 0xFF000000
    if i < width:
        return px[i - 1]
    if i % width == 0:
        return px[i - width]
    return prediction(mode, px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1])


def predicted(argb: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What one mode predicts for every pixel of a known image."""
    if mode in (1, 2):
        before = np.concatenate([[0xFF000000], argb[:-1]])
        above = before.copy()
        above[width:] = argb[:-width]
        if mode == 2:
            return above
        before[width::width] = above[width::width]
        return before
    px = argb.tolist()
    return np.array([_around(px, i, width, mode) for i in range(len(px))], dtype=np.int64)


def unpredicted(residue: np.ndarray, width: int, mode: int) -> np.ndarray:
    """The image of residues of mode 1 (left) or 2 (above), by running sums."""
    px = _bytes(residue).reshape(-1, width, 4).copy()
    px[0, 0, 3] += 255  # the first pixel's prediction is black
    px[0] = np.cumsum(px[0], axis=0, dtype=np.uint8)
    if mode == 1:
        px[:, 0] = np.cumsum(px[:, 0], axis=0, dtype=np.uint8)
        px[1:] = np.cumsum(px[1:], axis=1, dtype=np.uint8)
    else:
        px = np.cumsum(px, axis=0, dtype=np.uint8)
    return px.reshape(-1, 4).view("<u4").ravel().astype(np.int64)


def cross_colour(argb: np.ndarray, element: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what green says of red and blue, and red of blue."""
    signed = lambda x: (x & 255 ^ 128) - 128
    green, red, blue = argb >> 8 & 255, argb >> 16 & 255, argb & 255
    g_to_r, g_to_b, r_to_b = signed(element), signed(element >> 8), signed(element >> 16)
    new_red = red + sign * (g_to_r * signed(green) >> 5) & 255
    original = new_red if sign > 0 else red
    new_blue = blue + sign * ((g_to_b * signed(green) >> 5) + (r_to_b * signed(original) >> 5)) & 255
    return argb & 0xFF00FF00 | new_red << 16 | new_blue


def bundling(colours: int) -> int:
    """log2 of the palette indexes in a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def bundle(index: np.ndarray, width: int, colours: int) -> tuple[np.ndarray, int]:
    """Palette indexes as pixels, several in one where the palette is small; and the new width."""
    shift = bundling(colours)
    packed_width, each = (width + (1 << shift) - 1) >> shift, 8 >> shift
    rows = index.reshape(-1, width)
    padded = np.zeros((len(rows), packed_width << shift), dtype=np.int64)
    padded[:, :width] = rows
    value = sum(padded[:, k :: 1 << shift] << k * each for k in range(1 << shift))
    return (0xFF000000 | value << 8).ravel(), packed_width


def unbundle(argb: np.ndarray, table: np.ndarray, packed_width: int, width: int) -> np.ndarray:
    """Colours of the palette indexes in the pixels; an index past the palette is transparent black."""
    shift = bundling(len(table))
    each = 8 >> shift
    green = (argb >> 8 & 255).reshape(-1, packed_width)
    index = np.stack([green >> k * each & (1 << each) - 1 for k in range(1 << shift)], axis=2).reshape(len(green), -1)[:, :width]
    return np.concatenate([table, np.zeros(256, dtype=np.int64)])[index.ravel()]


# -- reading ---------------------------------------------------------------------------------------------------------------------------
class Reader:
    """Bits of a VP8L stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.n = data, 0, 0, 0

    def get(self, bits: int) -> int:
        while self.n < bits:
            self.value |= int.from_bytes(self.data[self.at : self.at + 6], "little") << self.n
            self.at += 6
            self.n += 48
        out = self.value & (1 << bits) - 1
        self.value >>= bits
        self.n -= bits
        return out

    def check(self) -> None:
        if 8 * self.at - self.n > 8 * len(self.data):
            raise ValueError("the stream ends too soon")

    def symbol(self, code: tuple) -> int:
        table, mask = reading_table(*code)
        if self.n < 16:
            self.value |= int.from_bytes(self.data[self.at : self.at + 6], "little") << self.n
            self.at += 6
            self.n += 48
        out, bits = table[self.value & mask]
        self.value >>= bits
        self.n -= bits
        return out

    def code(self, size: int, shift: int = 0) -> tuple[bytes, int]:
        """The lengths of a prefix code over size symbols, and by how much its symbols are shifted."""
        lengths = bytearray(size)
        if self.get(1):
            count = self.get(1) + 1
            lengths[self.get(8 if self.get(1) else 1)] = 1
            if count == 2:
                lengths[self.get(8)] = 1
            return bytes(lengths), shift
        own = bytearray(19)
        for s in LENGTH_ORDER[: 4 + self.get(4)]:
            own[s] = self.get(3)
        left = 2 + self.get(2 + 2 * self.get(3)) if self.get(1) else size
        table, mask = reading_table(bytes(own), 0)
        i, before, data, at, value, n = 0, 8, self.data, self.at, self.value, self.n
        while i < size and left:
            left -= 1
            if n < 24:
                value |= int.from_bytes(data[at : at + 12], "little") << n
                at += 12
                n += 96
            s, bits = table[value & mask]
            value >>= bits
            n -= bits
            if s < 16:
                lengths[i] = s
                before = s or before
                i += 1
                continue
            bits, times = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
            times += value & (1 << bits) - 1
            value >>= bits
            n -= bits
            if i + times > size:
                raise ValueError("code lengths run past the alphabet")
            if s == 16:
                lengths[i : i + times] = bytes([before]) * times
            i += times
        self.at, self.value, self.n = at, value, n
        return bytes(lengths), shift

    def number(self, symbol: int) -> int:
        """A length or distance from its prefix symbol."""
        if symbol < 4:
            return symbol + 1
        extra = symbol - 2 >> 1
        return (2 + (symbol & 1) << extra) + self.get(extra) + 1

    def image(self, width: int, height: int, main: bool) -> np.ndarray:
        """The ARGB pixels of an entropy-coded image."""
        return self.body(self.head(width, height, main), [])

    def head(self, width: int, height: int, main: bool) -> dict:
        """What stands before an image's pixels: size, colour cache, prefix code groups and which group is where."""
        cache_bits = self.get(4) if self.get(1) else 0
        meta, meta_bits, groups, side = None, 0, 1, 0
        if main and self.get(1):
            meta_bits = self.get(3) + 2
            side = (width + (1 << meta_bits) - 1) >> meta_bits
            meta = (self.image(side, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8 & 0xFFFF).tolist()
            groups = max(meta) + 1
        codes = [[self.code(280 + (1 << cache_bits if cache_bits else 0)), *[self.code(256, shift) for shift in (16, 0, 24)], self.code(40)] for _ in range(groups)]
        return {"width": width, "total": width * height, "cache_bits": cache_bits, "meta": meta, "meta_bits": meta_bits, "side": side, "codes": codes}

    def body(self, head: dict, out: list[int]) -> np.ndarray:
        """The pixels, of which out has the first ones already."""
        width, total, cache_bits, meta, meta_bits, side, codes = head.values()
        cache = [0] * (1 << cache_bits) if cache_bits else None
        seen = 0  # pixels already in the cache
        shift = 32 - cache_bits
        group = codes[0]
        while len(out) < total:
            if meta is None and cache is None:
                green = self._literals(group, out, total)
                if green is None:
                    break
            else:
                i = len(out)
                if meta:
                    group = codes[meta[(i // width >> meta_bits) * side + (i % width >> meta_bits)]]
                green = self.symbol(group[0])
            if green < 256:
                red, blue, alpha = (self.symbol(group[k]) for k in (1, 2, 3))
                out.append(alpha | red | green << 8 | blue)
            elif green < 280:
                length, code = self.number(green - 256), self.number(self.symbol(group[4]))
                distance = code - 120 if code > 120 else max(1, NEAR[code - 1][1] * width + NEAR[code - 1][0])
                if distance > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the image")
                if distance >= length:
                    start = len(out) - distance
                    out += out[start : start + length]
                else:
                    piece = out[-distance:]
                    out += (piece * (length // distance + 1))[:length]
            else:
                for px in out[seen:]:
                    cache[(px * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = px
                seen = len(out)
                out.append(cache[green - 280])
        self.check()
        return np.array(out, dtype=np.int64)

    def seek(self, bit: int) -> None:
        self.at, self.value, self.n = bit >> 3, 0, 0
        self.get(bit & 7)

    def _literals(self, group, out: list[int], total: int) -> int | None:
        """Append literals up to the image's end (None) or a symbol that is none (which is returned)."""
        (gt, gm), (rt, rm), (bt, bm), (at_, am) = [reading_table(*code) for code in group[:4]]
        data, at, value, n, append = self.data, self.at, self.value, self.n, out.append
        found = None
        for _ in range(total - len(out)):
            if n < 60:
                value |= int.from_bytes(data[at : at + 12], "little") << n
                at += 12
                n += 96
            green, bits = gt[value & gm]
            value >>= bits
            n -= bits
            if green > 255:
                found = green
                break
            red, bits = rt[value & rm]
            value >>= bits
            n -= bits
            blue, bits = bt[value & bm]
            value >>= bits
            n -= bits
            alpha, bits = at_[value & am]
            if bits:
                value >>= bits
                n -= bits
            append(alpha | red | green << 8 | blue)
        self.at, self.value, self.n = at, value, n
        if 8 * at - n > 8 * len(data):
            raise ValueError("the stream ends too soon")
        return found


def opened(file: bytes) -> tuple[Reader, dict, list, int, int]:
    """(reader, head of the main image, transforms to undo, width, height): a file up to its pixels."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Reader(file[21 : 20 + struct.unpack("<I", file[16:20])[0]])
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(1)
    if bits.get(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.get(1):
        kind = bits.get(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.get(3) + 2
            side = (now + (1 << size) - 1) >> size
            undo.append((kind, bits.image(side, (height + (1 << size) - 1) >> size, False), size, side, now))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind,))
        else:
            table = bits.image(bits.get(8) + 1, 1, False)
            table = sum(np.cumsum(table >> s & 255) % 256 << s for s in (0, 8, 16, 24))
            packed = (now + (1 << bundling(len(table))) - 1) >> bundling(len(table))
            undo.append((kind, table, packed, now))
            now = packed
    return bits, bits.head(now, height, True), undo, width, height


def undone(argb: np.ndarray, undo: list) -> np.ndarray:
    """Pixels with the transforms inverted, last first."""
    for kind, *more in reversed(undo):
        if kind == SUBTRACT_GREEN:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | (argb & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF
        elif kind == PALETTE:
            argb = unbundle(argb, *more)
        else:
            tiles, size, side, w = more
            at = np.arange(len(argb))
            element = tiles[(at // w >> size) * side + (at % w >> size)]
            if kind == CROSS_COLOUR:
                argb = cross_colour(argb, element, 1)
            else:
                modes = element >> 8 & 15
                if modes[0] in (1, 2) and (modes == modes[0]).all():
                    argb = unpredicted(argb, w, int(modes[0]))
                    continue
                px = argb.tolist()
                for i, mode in enumerate(modes.tolist()):
                    px[i] = _plus(px[i], _around(px, i, w, mode))
                argb = np.array(px, dtype=np.int64)
    return argb


def decode(file: bytes) -> tuple[np.ndarray, int, int]:
    """(ARGB pixels, width, height) of a lossless WebP file."""
    bits, head, undo, width, height = opened(file)
    return undone(bits.body(head, []), undo), width, height


def decode_many(files: list[bytes], least: int = 64) -> list[tuple[np.ndarray, int, int]]:
    """What decode() gives for each file.

    Images with one group of codes of LIMIT bits at most are read side by side, a pixel of each at a time, while there are least of them; the longest ones
    that are left then go on each by itself.
    """
    found = [opened(f) for f in files]
    begun: list = [[] for _ in files]
    wide = [i for i, (_, head, *_) in enumerate(found) if head["meta"] is None and max(map(max, (code[0] for code in head["codes"][0]))) <= LIMIT]
    if len(wide) >= least:
        for i, (px, bit) in zip(wide, _side_by_side([found[i][:2] for i in wide], least), strict=True):
            begun[i] = px
            found[i][0].seek(bit)
    whole = [np.asarray(out, dtype=np.int64) if len(out) == head["total"] else bits.body(head, list(out)) for (bits, head, *_), out in zip(found, begun, strict=True)]
    return [(undone(px, undo), width, height) for px, (_, _, undo, width, height) in zip(whole, found, strict=True)]


def _extra(value: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, bits used) of lengths or distances from their prefix symbols and the bits that follow."""
    bits = np.where(symbol < 4, 0, symbol - 2 >> 1)
    more = (value & (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)).astype(np.int64)
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << bits) + more + 1), bits


def _side_by_side(images: list[tuple[Reader, dict]], least: int) -> list[tuple[np.ndarray, int]]:
    """(first pixels, bit position after them) of each image. A lane is an image; every lane has one pixel more after each step, read or copied."""
    n, room = len(images), 1 << LIMIT
    sizes = np.array([len(bits.data) for bits, _ in images], dtype=np.int64)
    base = np.cumsum(sizes + 8) - sizes - 8
    buffer = b"".join(bits.data + bytes(8) for bits, _ in images)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(buffer, dtype="<u8", count=1), shape=(len(buffer) - 7,), strides=(1,))
    last = len(words) - 1
    totals = np.array([head["total"] for _, head in images], dtype=np.int64)
    order = np.argsort(-totals, kind="stable")  # the last lanes are complete first
    images, totals = [images[i] for i in order], totals[order]
    tables, masks = np.zeros((5, n * room), dtype=np.uint16), np.zeros((5, n), dtype=np.uint64)
    widths = np.array([head["width"] for _, head in images], dtype=np.int64)
    cache_bits = np.array([head["cache_bits"] for _, head in images], dtype=np.uint64)
    for i, (_, head) in enumerate(images):
        made: dict[bytes, tuple[np.ndarray, int]] = {}
        for c, (lengths, _) in enumerate(head["codes"][0]):
            if lengths not in made:
                made[lengths] = packed_table(lengths)
            table, top = made[lengths]
            tables[c, i * room : i * room + (1 << top)], masks[c, i] = table, (1 << top) - 1
    pos = base[order] * 8 + np.array([8 * bits.at - bits.n for bits, _ in images], dtype=np.int64)
    place = np.cumsum(totals) - totals
    out = np.zeros(int(totals.sum()), dtype=np.int64)
    left, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    with_cache = bool(cache_bits.any())
    cache_room = 1 << int(cache_bits.max())
    cache = np.zeros(n * cache_room if with_cache else 0, dtype=np.int64)
    near = np.array(NEAR, dtype=np.int64)
    lanes, t, end = n, 0, pos.copy()
    row = np.arange(n) * room
    while True:
        while lanes and totals[lanes - 1] <= t:
            lanes -= 1
        if lanes < least:
            break
        reading = np.flatnonzero(left[:lanes] == 0)
        value = words[np.minimum(pos[reading] >> 3, last)] >> (pos[reading] & 7).astype(np.uint64)
        at = row[reading]
        symbol = tables[0].take(at + (value & masks[0][reading]).astype(np.int64))
        used = symbol & 15
        green = (symbol >> 4).astype(np.int64)
        px = np.zeros(lanes, dtype=np.int64)
        plain = np.flatnonzero(green < 256)
        other = np.flatnonzero(green >= 256) if len(plain) < len(green) else plain[:0]
        if len(other):
            who, more, of = reading[other], value[other] >> used[other].astype(np.uint64), green[other]
            cached = of >= 280
            if cached.any():
                px[who[cached]] = cache[who[cached] * cache_room + of[cached] - 280]
            copying = ~cached
            if copying.any():
                who, more, of = who[copying], more[copying], of[copying] - 256
                length, bits = _extra(more, of)
                more >>= bits.astype(np.uint64)
                far = tables[4].take(row[who] + (more & masks[4][who]).astype(np.int64))
                back, further = _extra(more >> (far & 15).astype(np.uint64), (far >> 4).astype(np.int64))
                spot = near[np.minimum(back, 120) - 1]
                back = np.where(back > 120, back - 120, np.maximum(1, spot[:, 1] * widths[who] + spot[:, 0]))
                if (back > t).any() or (t + length > totals[who]).any():
                    raise ValueError("a back-reference leaves the image")
                left[who], distance[who] = length, back
                pos[who] += bits + (far & 15) + further
            value, at, green = value[plain], at[plain], green[plain]
            pos[reading] += used
            reading, used = reading[plain], used[plain]
        else:
            pos[reading] += used
        value = value >> used.astype(np.uint64)
        bits = np.zeros(len(reading), dtype=np.int64)
        found = green << 8
        for c, shift in ((1, 16), (2, 0), (3, 24)):
            symbol = tables[c].take(at + (value & masks[c][reading]).astype(np.int64))
            own = symbol & 15
            value >>= own.astype(np.uint64)
            bits += own
            found |= (symbol >> 4).astype(np.int64) << shift
        px[reading] = found
        pos[reading] += bits
        copies = np.flatnonzero(left[:lanes])
        if len(copies):
            px[copies] = out[place[copies] + t - distance[copies]]
            left[copies] -= 1
        out[place[:lanes] + t] = px
        if with_cache:
            spread = (px.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFF_FFFF)) >> (np.uint64(32) - cache_bits[:lanes])
            cache[np.arange(lanes) * cache_room + np.where(cache_bits[:lanes] > 0, spread, np.uint64(0)).astype(np.int64)] = px
        t += 1
    if ((pos - base[order] * 8) > 8 * sizes[order]).any():
        raise ValueError("the stream ends too soon")
    done = np.minimum(totals, t)
    results: list = [None] * n
    for i, k in enumerate(order.tolist()):
        px = out[place[i] : place[i] + done[i]]
        if left[i] and done[i] < totals[i]:  # a copy that is under way
            px = px.tolist()
            for _ in range(int(left[i])):
                px.append(px[-int(distance[i])])
        results[k] = (px, int(pos[i] - base[k] * 8))
    return results


def pixels(argb: np.ndarray) -> np.ndarray:
    """n x 3 array of red, green and blue."""
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=1).astype(np.uint8)


# -- payloads --------------------------------------------------------------------------------------------------------------------------
FORMS = [{"transforms": (PALETTE,)}, {"transforms": (SUBTRACT_GREEN,), "cache_bits": 5}, {"transforms": (PREDICTOR, CROSS_COLOUR)}]


def form_of(rgb: np.ndarray, width: int) -> dict:
    """How an image is stored: the form that its pixels' checksum says, without the palette if it has more than 256 colours, and with the better of two predictors."""
    form = dict(FORMS[zlib.crc32(rgb.tobytes()) % len(FORMS)])
    argb = rgb[:, 0].astype(np.int64) << 16 | rgb[:, 1].astype(np.int64) << 8 | rgb[:, 2]
    if PALETTE in form["transforms"] and len(pd.unique(argb)) > 256:
        form["transforms"] = ()
    if PREDICTOR in form["transforms"]:
        size = [int(np.abs(_bytes(_minus(argb, predicted(argb, width, mode) & 0xFFFFFF)).view(np.int8).astype(np.int64)).sum()) for mode in (1, 2)]
        form["mode"] = 1 if size[0] <= size[1] else 2
    return form


def store(payload: bytes, max_rows: int = MAX_ROWS) -> bytes:
    """A payload of whole rows as one WebP file, or several one after the other."""
    return store_many([payload], max_rows)[0]


def store_many(payloads: list[bytes], max_rows: int = MAX_ROWS, together: int = 1 << 20) -> list[bytes]:
    """What store() gives for each payload; images are encoded side by side, up to so many bytes together or one that is larger."""
    out: list[list[bytes]] = [[] for _ in payloads]
    held, size = [], 0

    def write() -> None:
        for (i, *_), file in zip(held, encode_many([image for _, image in held]), strict=True):
            out[i].append(file)
        held.clear()

    for i, payload in enumerate(payloads):
        for at in range(0, len(payload), ROW * max_rows):
            rgb = np.frombuffer(payload[at : at + ROW * max_rows], dtype=np.uint8).reshape(-1, 3)
            if held and size + rgb.size > together:
                write()
                size = 0
            held.append((i, (rgb, PIXELS, form_of(rgb, PIXELS))))
            size += rgb.size
    write()
    return [b"".join(files) for files in out]


def load_many(media: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(n x 3 pixel array, rows) of each value that store() made."""
    files, owner = [], []
    for i, value in enumerate(media):
        at = 0
        while at < len(value):
            size = struct.unpack("<I", value[at + 4 : at + 8])[0] + 8
            files.append(value[at : at + size])
            owner.append(i)
            at += size
    parts: list[list[np.ndarray]] = [[] for _ in media]
    rows = [0] * len(media)
    for i, (argb, _, height) in zip(owner, decode_many(files), strict=True):
        parts[i].append(pixels(argb))
        rows[i] += height
    return [(np.concatenate(p) if len(p) != 1 else p[0], n) for p, n in zip(parts, rows, strict=True)]


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of every row."""

    @frees
    def run(batches):
        for block in blocks(batches, "text", 1 << 20):
            texts = [t or b"" for t in block.column("text").to_pylist()]
            media = store_many([t + b"\xff" * (-len(t) % ROW if t else ROW) for t in texts])
            yield emit({"doc_id": block.column("doc_id").combine_chunks(), "n_bytes": [len(t) for t in texts], "media": media}, MEDIA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the decoded pixels of a media column give: size, digests, and a feature text of rows and mean colour."""

    @frees
    def run(batches):
        for block in blocks(batches, "media", 8 << 20):
            out = {name: [] for name in FEATURES.names}
            listed = block.to_pylist()
            for r, (px, rows) in zip(listed, load_many([r["media"] for r in listed]), strict=True):
                payload = px.tobytes()
                mean = px.mean(axis=0)
                found = (r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), f"{PIXELS}x{rows}:{mean[0]:.4f},{mean[1]:.4f},{mean[2]:.4f}")
                for name, value in zip(FEATURES.names, found, strict=True):
                    out[name].append(value)
            yield emit(out, FEATURES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as a media column in the shared folder, read back and decoded."""
    return features(cut(media_column(docs, id_col=id_col, text_col=text_col), "media"))
