"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallygrove.llm import spelling
from tallygrove.llm.common import table
from tests.llm.conftest import documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    n = counted(rows)
    around = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in around.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def texts(seed, letters="aÉ"):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 6))) for _ in range(40)]
    weights = [2 ** rnd.randint(0, 7) for _ in base]
    return [" ".join(rnd.choices(base, weights, k=60)) for _ in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    some = [None, "", " ", "x1y2", "Über-ÜBER über×÷ÿÿÿÿÿ", *texts(seed)]
    want = by_hand(list(enumerate(some)))
    assert found(spelling.variants(documents(spark, some))) == want
    assert any(f for f, *_ in want.values()) and any(r[3] > 2 for r in want.values())


def test_equal_keys_are_told_apart_by_their_strings(spark, monkeypatch):
    rows = [("abcde", 0, 5), ("xbcde", 0, 9), ("bcde", -1, 7), ("abcdf", 4, 3)]
    parts = sorted(spelling.group_parts([r for r in rows if r[0] != "abcdf"]))
    assert parts == [("abcde", 1, 7, "bcde"), ("abcde", 1, 9, "xbcde"), ("bcde", 2, 9, "xbcde"), ("xbcde", 1, 5, "abcde"), ("xbcde", 1, 7, "bcde")]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": [1] * 4, "word": [r[0] for r in rows], "n": [r[2] for r in rows], "place": [r[1] for r in rows]})
    assert sorted(r for b in spelling._verified_parts([batch]) for r in zip(*(c.to_pylist() for c in b.columns))) == parts


def test_keys_that_stand_alone_go_over_batch_borders():
    import pyarrow as pa

    rows = [(k, i, 0) for i, k in enumerate([1, 2, 2, 3, 3, 3, 4, 5, 5])]
    for size in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("key", "id", "place"), map(list, zip(*rows[i : i + size]))))) for i in range(0, 9, size)]
        assert [r for b in spelling._repeated(batches) for r in b.column("id").to_pylist()] == [1, 2, 3, 4, 5, 7, 8]


def test_chains_null_ids_repeats_and_very_long_words(spark):
    chain = " ".join(w for k, w in enumerate(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]) for _ in range(3 * 2**k))
    long = "qz" * 30_000
    rows = [(None, chain), (None, chain), (7, f"{long} {long} {long}"), (8, f"{long}x " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS n", "'w' AS word", "'r' AS root", "2L AS id", "'k' AS key")
    assert found(spelling.variants(df)) == by_hand(rows)


def test_empty_and_without_words(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(documents(spark, [None, "", "abcdef"])).count() == 0


def test_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    want = counted([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = found(spelling.variants(docs))
    assert {w: r[2] for w, r in got.items()} == want
    assert all(f is None or near(w, f) for w, (f, *_) in got.items()) and sum(f is not None for f, *_ in got.values()) > 50
