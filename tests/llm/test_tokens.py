"""Packing and BPE against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tallygrove.llm import bpe_sql, packing, pretokens


def test_pretokens_split_as_the_pattern_does():
    rnd, pattern = random.Random(1), regex.compile(P.PATTERN)
    parts = ["a", "B", "é", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "²", "!", "中", " ", "'t", "'ve", "😀", " ", "\x85"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    cp, offsets = pretokens.code_points(texts)
    begin, joined = pretokens.starts(cp, offsets), "".join(texts)
    assert [joined[a:b] for a, b in zip(begin, [*begin[1:], len(cp)], strict=True)] == [w for t in texts for w in pattern.findall(t)]


def test_packing(docs, odd_texts):
    rows = packing.pack(docs, capacity=256).toPandas()
    encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for doc, text in enumerate(odd_texts):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in rows[rows.doc_id == doc].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    filled = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in filled:
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


def test_packing_leaves_little_padding_and_balances():
    packer = packing.Packer(64, 1.0, 1 / 64)
    lengths = np.array([random.Random(3).randint(1, 63) for _ in range(500)])
    placed = packer.place(lengths)
    totals = {}
    for _, _, n, s in placed:
        totals[s] = totals.get(s, 0) + n
    assert sum(totals.values()) == lengths.sum() and max(totals.values()) <= 64 and len(totals) == -(-lengths.sum() // 64)


def test_special_token_strings_are_the_token(spark):
    text = "a <|endoftext|> b"
    encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert list(packing.encoded([text], P.path("byte_bpe_50k.json")))[0].tolist() == encoder.encode(text, add_special_tokens=False).ids


def test_bpe(docs, odd_texts):
    ranks = bpe_sql.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in bpe_sql.encode_decode(docs).collect()}
    for doc, text in enumerate(odd_texts):
        ids = library.encode_ordinary(text or "")
        assert found[doc]["n_tokens"] == len(ids)
        assert found[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe_sql.decode_ids(bpe_sql.encode_ids(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(odd_texts)}


@pytest.mark.parametrize("f", [packing.pack, bpe_sql.encode_decode])
def test_empty(empty, f):
    assert f(empty).count() == 0


ALIKE = ["abcdefgh" + 24 * "q" + "ijklmnop" + 24 * "q", "WpQXMZne" + 24 * "q" + "pVpFjcOV" + 24 * "q"]  # words of one XXH64


def test_words_of_equal_hashes(spark):
    import xxhash

    from tests.llm.conftest import documents

    assert xxhash.xxh64_intdigest(ALIKE[0]) == xxhash.xxh64_intdigest(ALIKE[1])
    encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = [x.tolist() for x in packing.encoded(ALIKE, P.path("byte_bpe_50k.json"))]
    assert got == [encoder.encode(t, add_special_tokens=False).ids for t in ALIKE]
    rows = {r["doc_id"]: r["decoded_sha256"] for r in bpe_sql.encode_decode(documents(spark, ALIKE).coalesce(1)).collect()}
    assert [rows[i] for i in range(2)] == [hashlib.sha256(t.encode()).hexdigest() for t in ALIKE]


def test_a_long_unbroken_run(spark):
    from tests.llm.conftest import documents

    text = "".join(random.Random(5).choice("abcde") for _ in range(1500))
    ranks = bpe_sql.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe_sql.encode_decode(documents(spark, [text])).first()["n_tokens"] == len(library.encode_ordinary(text))
