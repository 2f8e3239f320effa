"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each Spark partition.

A partition's texts are split into pre-tokens, and the distinct ones become token-position rows (word, position, token). The recursive
query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of minimum rank until no word has a pair
left. Ordered aggregation gives a word's ids and decodes them to bytes. Documents are put together from their words' results.

Memory is bounded by the block of texts and by the batch of words given to one query; DuckDB runs in one thread with a memory limit.

Defined cases: null text counts as empty: no tokens, and the digests of the empty string. Repeated rows are encoded each for itself; an
empty table gives no rows; other columns are not looked at. One pre-token of n bytes takes up to n rounds, so a single unbroken run of
very many letters is slow, though right.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import blocks, emit, frees
from tallygrove.llm.pretokens import Vocabulary, word_rows

DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_words", pa.int64())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long"
NONE, MASK = (1 << 62) - 1, (1 << 31) - 1

CONTRACT = f"""
WITH RECURSIVE step AS (
    SELECT w, p, t, false AS done FROM pieces
    UNION ALL
    SELECT s.w, s.p, CASE WHEN s.p = b.p AND b.key < {NONE} THEN b.merged ELSE s.t END AS t, b.key = {NONE} AS done
    FROM step s JOIN (
        SELECT w, min(key) AS key, (min(key) >> 32)::INTEGER AS merged, (min(key) & {MASK})::INTEGER AS p, arg_min(second, key) AS second
        FROM (
            SELECT n.w, n.second, coalesce((m.merged::BIGINT << 32) | n.p, {NONE}) AS key
            FROM (
                SELECT w, p, t, lead(t) OVER word AS after, lead(p) OVER word AS second
                FROM step WHERE NOT done WINDOW word AS (PARTITION BY w ORDER BY p)
            ) n LEFT JOIN merges m ON m.pair = (n.t::BIGINT << 32) | n.after
        ) GROUP BY w
    ) b ON s.w = b.w AND NOT s.done
    WHERE b.key = {NONE} OR s.p IS DISTINCT FROM b.second
)
SELECT s.w, list(s.t ORDER BY s.p) AS ids, string_agg(v.hex, '' ORDER BY s.p) AS hex
FROM step s JOIN tokens v ON v.t = s.t
WHERE s.done
GROUP BY s.w ORDER BY s.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """The DuckDB side: merge table and vocabulary of one rank file, and the words encoded so far, as decimal text and decoded bytes."""

    def __init__(self, path: str, batch_words: int = 40_000, memory: str = "300MB"):
        self.batch_words, self.ranks = batch_words, read_ranks(path)
        ranks = self.ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        tokens = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        merges = pa.table({"pair": pa.array([a for a, _ in pairs], pa.int64()), "merged": pa.array([r for _, r in pairs], pa.int32())})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM tokens")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.counts, self.decimal, self.decoded = [], [], []

    def add(self, words: list[str]) -> None:
        for i in range(0, len(words), self.batch_words):
            self._encode([w.encode() for w in words[i : i + self.batch_words]])

    def _encode(self, words: list[bytes]) -> None:
        """A word that is a token is that token; the others start from their bytes."""
        whole = [self.ranks.get(w, -1) for w in words]
        parts = [b"\0" if r >= 0 else w for w, r in zip(words, whole, strict=True)]
        lengths = np.array([len(x) for x in parts])
        t = self.single[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        at = np.cumsum(lengths) - lengths
        known = np.array(whole) >= 0
        t[at[known]] = np.array(whole, dtype=np.int32)[known]
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pieces = pa.table({"w": w, "p": (np.arange(len(t)) - np.repeat(at, lengths)).astype(np.int32), "t": t})
        self.db.register("pieces", pieces)
        found = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
        self.db.unregister("pieces")
        ids = found.column("ids").combine_chunks()
        bounds = ids.offsets.to_numpy()
        flat = ids.flatten().to_numpy().tolist()
        self.counts += np.diff(bounds).tolist()
        ends = bounds.tolist()
        self.decimal += [(" " + " ".join(map(str, flat[a:b]))).encode() for a, b in zip(ends, ends[1:])]
        self.decoded += [bytes.fromhex(x) for x in found.column("hex").to_pylist()]


@cache
def vocabulary(path: str) -> Vocabulary:
    """The words encoded so far in this worker."""
    return Vocabulary(Encoder(path), limit=800_000)


def digests(texts: list[str], path: str):
    """(tokens, digest of the decimal ids, digest of the decoded bytes, words) of each text."""
    known = vocabulary(path)
    for _, rows, sizes in word_rows(texts, known):
        tokens = np.concatenate([[0], np.cumsum(np.array(known.store.counts, dtype=np.int64)[rows])])
        decimal, decoded, rows, at = known.store.decimal.__getitem__, known.store.decoded.__getitem__, rows.tolist(), 0
        for n in sizes.tolist():
            own, at = rows[at : at + n], at + n
            yield int(tokens[at] - tokens[at - n]), hashlib.sha256(b"".join(map(decimal, own))[1:]).hexdigest(), hashlib.sha256(b"".join(map(decoded, own))).hexdigest(), n


def encode_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_words of every row."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    @frees
    def run(batches):
        for block in blocks(batches, "text", block_bytes):
            found = list(digests([t or "" for t in block.column("text").to_pylist()], path))
            columns = dict(zip(DIGESTS.names[1:], map(list, zip(*found, strict=True)), strict=True))
            yield emit({"doc_id": block.column("doc_id").combine_chunks()} | columns, DIGESTS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DDL)


def encode_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and the ids themselves."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    @frees
    def run(batches):
        for block in blocks(batches, "text", block_bytes):
            known, ids = vocabulary(path), []
            for _, rows, sizes in word_rows([t or "" for t in block.column("text").to_pylist()], known):
                ends = np.cumsum(sizes).tolist()
                ids += [[int(i) for k in rows[a:b].tolist() for i in known.store.decimal[k].split()] for a, b in zip([0, *ends], ends)]
            yield emit({"doc_id": block.column("doc_id").combine_chunks(), "ids": ids}, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes, by ordered aggregation in DuckDB; a null list decodes to no bytes."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    @frees
    def run(batches):
        db = vocabulary(path).store.db
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            bounds = lists.offsets.to_numpy() if len(lists) else np.zeros(1, dtype=np.int32)
            flat = lists.flatten().to_numpy()
            rows = pa.table({"d": np.repeat(np.arange(len(lists)), np.diff(bounds)), "p": np.arange(len(flat)), "t": flat})
            db.register("given", rows)
            found = dict(db.execute("SELECT d, string_agg(v.hex, '' ORDER BY p) FROM given JOIN tokens v USING (t) GROUP BY d").fetchall())
            db.unregister("given")
            yield emit({"doc_id": batch.column(0), "decoded": [bytes.fromhex(found.get(d, "")) for d in range(len(lists))]}, schema)

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
