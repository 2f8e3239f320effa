"""Line dedup, SimHash and long repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallygrove.llm import components, linededup, runindex, simhash


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def removed_by_hand(texts, most):
    lines = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    near = lambda x, y: x == y or distance(x, y) <= min(most, max(len(x), len(y)) // 5)
    return {(d, p) for d, p, x in lines if any((e, q) < (d, p) and near(x, y) for e, q, y in lines)}


@pytest.mark.parametrize("most", [1, 2])
def test_lines_against_all_pairs(spark, most):
    from tests.llm.conftest import documents as make

    rnd = random.Random(2)
    base = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(1, 14))) for _ in range(16)]

    def near(x):
        for _ in range(rnd.randint(0, most)):
            i = rnd.randrange(len(x) + 1)
            x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + "q" + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + x[i : i + 1] + x[i:]])
        return x

    texts = [None, "", " \n\t", *["\n".join(near(rnd.choice(base)) for _ in range(rnd.randint(1, 5))) for _ in range(50)]]
    found = {r["doc_id"]: r for r in linededup.report(make(spark, texts), max_edits=most).collect()}
    gone = {(d, int(p)) for d, r in found.items() for p in r["removed"].split(",") if p}
    assert gone == removed_by_hand(texts, most)
    assert found[0]["n_lines"] == found[1]["n_lines"] == 0
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup(make(spark, texts), max_edits=most).collect()}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
        assert d not in kept if any(e == d for e, _ in gone) and not want.strip() else kept[d] == want


def test_common_lines_are_dealt_out(spark):
    lines = spark.range(400).selectExpr("id AS doc_id", "id AS t1", "CAST(0 AS int) AS pos", "IF(id < 300, 0, id) AS h1", "0L AS h2")
    told = lines.groupBy("h1", "h2").count().withColumnRenamed("count", "n").filter("h1 <> 350").selectExpr("h1", "h2", "n", "h1 AS value")
    found = linededup.dealt(lines, told, 400, hot=5, share=20)
    assert sorted((r["doc_id"], r["value"]) for r in found.collect()) == [(i, 0 if i < 300 else i) for i in range(400) if i != 350]
    none = linededup.dealt(lines.limit(0), told.limit(0), 0)
    assert none.count() == 0
    # most earlier places of one line are found in parts
    gone = linededup.removed_lines(spark.range(3000).selectExpr("id AS doc_id", "concat('one common line of the site\n', id, ' apart ', sha1(string(id))) AS text"))
    assert sorted((r["doc_id"], r["removed"]) for r in gone.collect()) == [(i, [0]) for i in range(1, 3000)]


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_sifted_rows_hold_all_that_is_wanted(spark, most):
    rows = spark.range(40_000).selectExpr("id", "xxhash64(id) AS hash")
    left = linededup.sifted(rows, wanted := rows.filter("id % 8 = 3"), "hash", most=most)
    assert left.columns == ["id", "hash"] and left.join(wanted, "hash", "left_semi").count() == 5000
    assert left.count() < (12_000 if most == 1 << 15 else 8_000)
    assert linededup.sifted(rows, rows.limit(0), "hash").count() == 0 == linededup.sifted(rows.limit(0), wanted, "hash").count()


def test_lines_that_one_polynomial_confuses(spark):
    """Thue-Morse strings, which a hash modulo 2^64 takes for equal."""
    from tests.llm.conftest import documents as make

    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    assert [r["n_removed"] for r in linededup.report(make(spark, [one, one.translate(str.maketrans("ab", "ba"))])).collect()] == [0, 0]
    found = runindex.remove_repeats(make(spark, [one[:900], one.translate(str.maketrans("ab", "ba"))[:900]])).collect()
    assert [r["n_removed"] for r in sorted(found)] == [x[1] for x in repeats_by_hand([one[:900], one.translate(str.maketrans("ab", "ba"))[:900]], 400)]


def test_lines_keep_columns_and_repeated_rows(spark, docs, empty):
    assert linededup.dedup(docs).columns == docs.columns
    assert linededup.report(empty).count() == 0 and linededup.dedup(empty).count() == 0
    twice = docs.filter("doc_id = 7").unionByName(docs.filter("doc_id = 7"))
    assert [r["n_removed"] for r in linededup.report(twice).collect()] == [0, 0]


def fingerprint_by_hand(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def by_hand(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, odd_texts, empty):
    prints = {i: fingerprint_by_hand(t) for i, t in enumerate(odd_texts)}
    want = by_hand(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_keep_one_of_rows_without_id(spark, docs):
    """Copies stay one even where doc_ids are null or name two texts."""
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "other words stand here now"), (1, "a b c d e f"), (1, "third text of one id too"), (None, "other words stand here now")], "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(rows).collect()), key=str)
    assert kept == [(1, "a b c d e f"), (1, "third text of one id too"), (None, "other words stand here now")]


def test_links_in_crowded_cells(spark):
    """Dense groups, salted cells and the edge of four bits against all pairs."""
    rng = np.random.default_rng(4)
    prints = set()
    for centre in rng.integers(0, 2**63, 6).tolist():
        for _ in range(60):
            x = centre
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    want = by_hand(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    for limit, small in ((20_000, 24), (8, 4)):
        pairs = simhash.links(spark.createDataFrame(signed, "fp long"), cell_limit=limit, small=small)
        joined = by_hand(prints, lambda a, b, p={frozenset((x % 2**64, y % 2**64)) for x, y in pairs.collect()}: frozenset((a, b)) in p)
        assert joined == want


def test_cells_are_not_broadcast(spark):
    """Spark sizes the cells by the fingerprints they are exploded from: a broadcast of them filled the driver."""
    plan = simhash.links(spark.range(1000).selectExpr("xxhash64(id) AS fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (5, 5), (200, 100)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_by_hand(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + match] for d in data for i in range(len(d) - match + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - match + 1):
            if seen[d[i : i + match]] > 1:
                cover[i : i + match] = True
        out.append((len(d), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~cover[:-1]])).hexdigest()))
    return out


def test_index_against_all_windows():
    rnd = random.Random(3)
    for _ in range(120):
        match, letters = rnd.choice([3, 5, 8]), rnd.choice([b"a", b"ab", b"abcd", bytes(range(3))])
        base = bytes(rnd.choice(letters) for _ in range(40))
        pieces = []
        for _ in range(rnd.randint(1, 5)):
            t = bytearray(base[rnd.randint(0, 10) : rnd.randint(15, 40)])
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(letters)
            pieces.append(bytes(t))
        seen = Counter(p[i : i + match] for p in pieces for i in range(len(p) - match + 1))
        want = set()
        for k, p in enumerate(pieces):
            for i in range(len(p) - match + 1):
                if seen[p[i : i + match]] > 1:
                    want |= {(k, j) for j in range(i, i + match)}
        assert {(k, j) for k, s, e in runindex.repeats(pieces, np.zeros(len(pieces), int), match) for j in range(s, e)} == want


def test_repeats(spark, docs, odd_texts, empty):
    from tests.llm.conftest import documents as make

    rnd = random.Random(9)
    prose = lambda n: "".join(rnd.choice("abcdefg \né") for _ in range(n))
    passage = prose(130)
    texts = [*odd_texts, prose(90) + passage + prose(50), passage[5:] + prose(70), prose(30) + passage[:110], "ab" * 90, "periodic " * 60, prose(300), prose(79), *[passage + prose(3) for _ in range(12)]]
    for limit in (4096, 3):
        found = runindex.remove_repeats(make(spark, texts), match=80, anchor=24, group_limit=limit).collect()
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(found, key=lambda r: r["doc_id"])] == repeats_by_hand(texts, 80)
    assert runindex.remove_repeats(empty).count() == 0
    cleaned = runindex.clean(docs)
    assert cleaned.columns == docs.columns


def test_texts_of_equal_hashes_keep_their_bytes(spark):
    """Two texts of one XXH64 that share no string of the match length."""
    from tests.llm.conftest import documents as make

    pair = ["abcdefgh" + 24 * "q" + "ijklmnop" + 24 * "q", "WpQXMZne" + 24 * "q" + "pVpFjcOV" + 24 * "q"]
    assert xxhash.xxh64_intdigest(pair[0]) == xxhash.xxh64_intdigest(pair[1])
    rows = runindex.remove_repeats(make(spark, pair), match=64, anchor=24).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]
    found = runindex.anchors([p.encode() for p in pair], 64, 24)
    assert len(set(found["context"].to_pylist())) == len(found["context"])
    assert sorted(r["n_removed"] for r in runindex.remove_repeats(make(spark, [*pair, pair[0]]), match=64, anchor=24).collect()) == [0, 64, 64]


def test_passages_under_400_bytes_stay(spark):
    """By contract op 10 goes by 400 bytes, not by words: of two passages of 51 words the one of 380 bytes stays, the one of 405 goes; the pipeline's stage cuts both."""
    from tests.llm.conftest import documents as make

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = lambda size: " ".join(word(n) for n in [6] * 50 + [size - 350])
    around = lambda x: " ".join(word(7) for _ in range(40)) + f" {x} " + " ".join(word(7) for _ in range(40))
    short, long = passage(380), passage(405)
    assert all(len(x.split()) == 51 for x in (short, long))
    rows = make(spark, [around(x) for x in (short, short, long, long)])
    found = {r["doc_id"]: r["n_removed"] for r in runindex.remove_repeats(rows).collect()}
    assert found[0] == found[1] == 0 and all(405 <= found[i] <= 407 for i in (2, 3))
    texts = {r["doc_id"]: r["text"] for r in runindex.clean(rows, words=51, anchor=80).collect()}
    assert not any(x in t for t in texts.values() for x in (short, long))


def test_passages_are_counted_beside_the_cut(spark):
    """Op 10's query counts the bytes of repeated passages of over 50 words under 400 bytes; what it removes is as without that count."""
    from tests.llm.conftest import documents as make

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    around = lambda x: " ".join(word(7) for _ in range(40)) + f" {x} " + " ".join(word(7) for _ in range(40))
    passage, few, long = " ".join(word(5) for _ in range(51)), " ".join(word(11) for _ in range(30)), " ".join(word(6) for _ in range(70))
    rows = make(spark, [*(around(x) for x in (passage, passage, few, few, long, long, word(5))), None])
    found = {r["doc_id"]: r for r in runindex.remove_repeats(rows, passages=51, anchor=80).collect()}
    assert all(len(passage) <= found[i]["n_passage_bytes"] <= len(passage) + 6 for i in (0, 1)) and found[0]["n_removed"] == 0
    assert [found[i]["n_passage_bytes"] for i in (2, 3, 6, 7)] == [0] * 4
    assert all(found[i]["n_passage_bytes"] == found[i]["n_removed"] >= len(long) for i in (4, 5))
    assert [found[r["doc_id"]][:5] == tuple(r) for r in runindex.remove_repeats(rows).collect()] == [True] * 8
