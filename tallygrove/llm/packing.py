"""Cost-balanced packing of token sequences.

A sequence's cost is estimated as linear plus quadratic (attention) in the lengths of its pieces. Documents are cut at multiples of the
capacity; what remains goes, longest first, to the sequence of lowest cost that still has room. A remainder that fits nowhere whole is cut
over the sequences with room, so all but the last sequence of a block are full.

Each Spark partition packs its own documents in blocks of bounded size: no shuffle, nothing on the driver, and a retried task gives the
same rows. A partition's blocks number their sequences from (partition << 32), so numbers are unique.

Defined cases: null or empty text is a document of the end mark only; repeated doc_ids and null doc_ids are documents of their own; an
empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import blocks, emit, frees
from tallygrove.llm.pretokens import Vocabulary, gathered, word_rows

SPECIAL = "<|endoftext|>"
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


@cache
def byte_symbols() -> str:
    """The character that byte-level BPE vocabularies show each byte as: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in set(printable) else next(rest)) for b in range(256))


class WordIds:
    """Ids of numbered words, end to end in flat; those of word k lie in bounds[k]:bounds[k + 1]."""

    def __init__(self, model):
        self.model, self.shown = model, dict(enumerate(byte_symbols()))
        self.clear()

    def clear(self) -> None:
        self.flat, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def add(self, words: list[str]) -> None:
        sizes = np.cumsum([0, *(len(w.encode()) for w in words)]).tolist()
        text = "".join(words).encode().decode("latin-1").translate(self.shown)
        ids = [[t.id for t in self.model.tokenize(text[a:b])] for a, b in zip(sizes, sizes[1:])]
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], dtype=np.uint32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids])])


@cache
def tokenizer(path: str):
    """The tokenizer of a file, and its vocabulary of words encoded so far in this worker."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return whole, Vocabulary(WordIds(whole.model))


def encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens added; a special token's own string in a text is that token."""
    whole, vocabulary = tokenizer(path)
    marked = {i for i, t in enumerate(texts) if SPECIAL in t}
    plain = ["" if i in marked else t for i, t in enumerate(texts)] if marked else texts
    for first, rows, sizes in word_rows(plain, vocabulary):
        ids, lengths = gathered(rows, vocabulary.store.flat, vocabulary.store.bounds)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        begin = 0
        for i, end in enumerate(ends.tolist(), first):
            yield np.array(whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32) if i in marked else ids[begin:end]
            begin = end


class Packer:
    """Sequences of one block: pieces go to the lowest-cost sequence with room."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic

    def cost(self, length):
        return self.linear * length + self.quadratic * length * length

    def place(self, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(piece, begin within it, length, sequence) for pieces no longer than the capacity.

        Sequences with equal room wait in one heap by cost; the cheapest of all heaps with room enough takes the piece.
        """
        from heapq import heappop, heappush

        n = -(-int(lengths.sum()) // self.capacity)
        waiting: list[list[tuple[float, int]]] = [[] for _ in range(self.capacity + 1)]
        waiting[self.capacity] = [(0.0, s) for s in range(n)]
        cheapest = np.full(self.capacity + 1, np.inf)
        if n:
            cheapest[self.capacity] = 0.0
        out = []

        def put(piece: int, begin: int, length: int, room: int) -> None:
            cost, s = heappop(waiting[room])
            out.append((piece, begin, length, s))
            left = room - length
            heappush(waiting[left], (cost + self.cost(length), s))
            cheapest[left] = waiting[left][0][0]
            cheapest[room] = waiting[room][0][0] if waiting[room] else np.inf

        for piece in np.argsort(-lengths, kind="stable").tolist():
            begin, left = 0, int(lengths[piece])
            while left:
                room = left + int(np.argmin(cheapest[left:]))
                if cheapest[room] < np.inf:
                    put(piece, begin, left, room)
                    break
                room = int(np.flatnonzero(cheapest[1:] < np.inf)[-1]) + 1  # fits nowhere whole: the roomiest takes a part
                put(piece, begin, room, room)
                begin, left = begin + room, left - room
        return out


def pack_block(doc_ids: list, ids: list[np.ndarray], first_sequence: int, packer: Packer) -> tuple[dict[str, list], int]:
    """Piece columns of one block of documents, and how many sequences it filled."""
    cap = packer.capacity
    rows: dict[str, list] = {f.name: [] for f in PIECES}

    def add(doc: int, start: int, length: int, sequence: int, offset: int) -> None:
        own = np.ascontiguousarray(ids[doc][start : start + length], dtype="<u4")
        for name, value in (("doc_id", doc_ids[doc]), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own.tobytes())), ("doc_tokens", len(ids[doc])), ("sequence_id", first_sequence + sequence), ("offset", offset), ("cost", packer.cost(length))):
            rows[name].append(value)

    used = 0
    rest = np.array([len(x) % cap for x in ids], dtype=np.int64)
    for doc, x in enumerate(ids):
        for start in range(0, len(x) - cap + 1, cap):
            add(doc, start, cap, used, 0)
            used += 1
    docs = np.flatnonzero(rest)
    filled: dict[int, int] = {}
    for piece, begin, length, s in packer.place(rest[docs]):
        doc = int(docs[piece])
        add(doc, len(ids[doc]) - int(rest[doc]) + begin, length, used + s, filled.get(s, 0))
        filled[s] = filled.get(s, 0) + length
    return rows, used + len(filled)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")

    @frees
    def run(batches):
        packer, sequence = Packer(capacity, linear, quadratic), TaskContext.get().partitionId() << 32
        for block in blocks(batches, "text", block_bytes):
            texts = [t or "" for t in block.column("text").to_pylist()]
            ids = [np.append(x, np.uint32(end_id)).astype(np.uint32) for x in encoded(texts, path)]
            rows, used = pack_block(block.column("doc_id").to_pylist(), ids, sequence, packer)
            sequence += used
            yield emit(rows, PIECES)
        tokenizer(path)[1].clear()  # the worker lives on, and other tasks need its memory

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DDL)
