"""Level-wise doubling against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallygrove.llm import doubling
from tallygrove.llm.common import table
from tests.llm.conftest import documents

SPLIT = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    return [w for w in "".join(" " if c in SPLIT else c for c in text or "").split(" ") if w]


def by_hand(texts, window):
    words = [split(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def prose(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    small, large = ["a", "b", "é"], [f"w{i}" for i in range(500)]
    passage = prose(rnd, 20, large)
    texts = [None, "", " \n\t", " ", "one", passage, prose(rnd, 200, small), "x " * 90, *[prose(rnd, rnd.randint(1, 60), large) for _ in range(30)]]
    texts += [f"{prose(rnd, rnd.randint(0, 30), large)}\n\t {passage}\r\n{prose(rnd, rnd.randint(0, 30), large)}" for _ in range(60)]
    texts += [f"{passage[:-1]}Q {passage}", texts[-1], texts[-1], f"{passage}{passage}"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("window", "start", "block"), [(12, None, 1000), (7, 1, 1 << 20), (20, 20, 300), (1, None, 1 << 20), (13, 5, 1)])
def test_against_all_windows(spark, window, start, block):
    texts = corpus(window)
    rows = doubling.report(documents(spark, texts).repartition(3), window=window, start=start, block_bytes=block).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert len(rows) == len(texts) and [found[i] for i in range(len(texts))] == by_hand(texts, window)


def test_spans_and_kept_texts(spark):
    rows = {r["doc_id"]: r for r in doubling.remove_repeats(documents(spark, ["p q a b c d r", "a b c\td", "a b c", "z a b c d a b c d"]), window=4).collect()}
    assert [[tuple(x) for x in rows[i]["spans"]] for i in range(4)] == [[(2, 6)], [(0, 4)], [], [(1, 9)]]
    assert [rows[i]["kept"] for i in range(4)] == ["p q r", "", "a b c", "z"]


def test_equal_short_hashes_are_told_apart(spark, monkeypatch):
    """Thue-Morse texts are equal for the polynomial of the levels before the last."""
    one = ["xy"[i.bit_count() & 1] for i in range(2048)]
    other = ["yx"[i.bit_count() & 1] for i in range(2048)]
    a, b = doubling.Words([" ".join(one).encode()]), doubling.Words([" ".join(other).encode()])
    assert a.keys(2048, False)[1] == b.keys(2048, False)[1] and a.keys(2048, True)[1] != b.keys(2048, True)[1]
    rows = doubling.report(documents(spark, [" ".join(one), " ".join(other)]), window=2048, start=2048).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


def test_levels_and_keys():
    assert doubling.levels(35) == [9, 18, 35] and doubling.levels(35, 1) == [1, 2, 4, 8, 16, 32, 35] and doubling.levels(1) == [1]
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (doubling.unpack(doubling.pack(keys), False) == keys).all() and (np.diff(doubling.radix(keys, 5)) >= 0).all()
    digests = np.sort(np.array([hashlib.blake2b(bytes([i, i]), digest_size=16).digest() for i in range(200)], dtype="S16"))
    assert (doubling.unpack(doubling.pack(digests), True) == digests).all() and (np.diff(doubling.radix(digests, 9)) >= 0).all()


def test_null_ids_repeated_rows_and_empty_tables(spark, empty):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(None, text), (None, text), (3, "a b"), (3, "a b")], "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS id", "'k' AS keys")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in doubling.report(df).collect()) == [(0, 40), (0, 40), (3, 0), (3, 0)]
    assert doubling.report(empty).count() == 0 and doubling.report(documents(spark, [None])).count() == 1


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), by_hand([r["text"] for r in rows], 35)))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in doubling.report(docs).collect()} == want
    assert sum(n for _, n, _ in want.values()) > 0
