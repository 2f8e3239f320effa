"""WARC packages, WebP images and license windows."""

import base64
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from tallygrove.llm import licenses, warc, webp


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, digest int, payload string")


def test_round_trip_and_revisits(spark):
    rows = [(5, "http://a/ü?x=1\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b", None), (7, "http://c", ""), (2, "u", "x" * 100_000), (None, "n", "<p>é</p>"), (3, None, "<p>é</p>")]
    found = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(pages(spark, rows)).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    p, e, x = "<p>é</p>", "", "x" * 100_000
    assert found == {(3, "response", None, 9, digest(p)), (5, "revisit", 3, 9, digest(p)), (None, "revisit", 3, 9, digest(p)), (7, "response", None, 0, digest(e)), (9, "revisit", 7, 0, digest(e)), (2, "response", None, 100_000, digest(x))}
    assert warc.round_trip(pages(spark, [])).count() == 0
    large_only = warc.round_trip(pages(spark, rows), min_bytes=10)
    assert {r["record_type"] for r in large_only.collect()} == {"response"}


def test_packages_in_a_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    written = warc.write_packages(warc.with_revisits(pages(spark, [(1, "a", "one"), (2, "b", "two")])), folder).collect()
    assert sum(r["records"] for r in written) == 2
    found = warc.read_packages(warc.find_packages(spark, folder)).collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in found} == {(1, b"one"), (2, b"two")}


def test_zip64_and_broken_packages():
    data = warc.package([(1, "u", b"hello", None, False)])
    whole = zipfile.ZipFile(io.BytesIO(data))
    assert whole.testzip() is None and all(i.compress_type == 0 for i in whole.infolist())

    class File:
        def __init__(self, raw):
            self.raw = raw

        def read_at(self, n, at):
            return self.raw[at : at + n]

    at = data.rfind(b"PK\x05\x06")
    count, length, offset = struct.unpack("<HII", data[at + 10 : at + 20])
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, offset)
    wide = data[:at] + end64 + b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for raw in (data, wide, data[:-2] + b"\x03\x00abc"):
        package = warc.Package(File(raw), len(raw))
        assert [r["payload"] for r in package.records()] == [b"hello"]
    with pytest.raises(ValueError):
        warc.Package(File(b"no zip at all, but long enough to look at"), 41)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.WARC_MEMBER, "x" * 1000)
    with pytest.raises(ValueError):
        warc.Package(File(packed.getvalue()), len(packed.getvalue())).locate(warc.WARC_MEMBER)


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0, 1), (0, 1)])
@pytest.mark.parametrize("cache_bits", [0, 3, 10])
def test_webp_round_trips(transforms, cache_bits):
    rng = np.random.default_rng(1)
    for width, height in ((1, 1), (7, 5), (19, 13)):
        for colours in (1, 2, 4, 9, 100, 999):
            if 3 in transforms and colours > 256:
                continue
            index = rng.integers(0, colours, width * height)
            rgb = rng.integers(0, 256, (colours, 3))[np.repeat(index, 6)[: width * height]].astype(np.uint8)
            argb, w, h = webp.decode(webp.encode(rgb, width, cache_bits=cache_bits, transforms=transforms, mode=11, block_bits=2))
            assert (w, h) == (width, height) and (webp.pixels(argb) == rgb).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rgb = np.random.default_rng(mode).integers(0, 256, (19 * 9, 3)).astype(np.uint8)
    assert (webp.pixels(webp.decode(webp.encode(rgb, 19, transforms=(0,), mode=mode, block_bits=3))[0]) == rgb).all()


def test_near_distances():
    """The table's order: by distance, and each place once."""
    places = [(y, x) for x, y in webp.NEAR]
    assert len(set(places)) == 120 and places[:4] == [(1, 0), (0, 1), (1, 1), (1, -1)]
    far = [y * y + x * x for y, x in places]
    assert far == sorted(far)


def test_side_by_side():
    """Images of many sizes and kinds at once give what each gives alone."""
    rng = np.random.default_rng(8)
    files = []
    for k in range(90):
        width, height, colours = (int(x) for x in rng.integers(1, 30, 3))
        rgb = rng.integers(0, 256, (colours, 3))[rng.integers(0, colours, width * height)].astype(np.uint8)
        files.append(webp.encode(rgb, width, cache_bits=int(rng.choice([0, 0, 0, 4])), transforms=[(), (), (2,), (1,), (3,)][k % 5]))
    for got, want in zip(webp.decode_many(files, least=3), map(webp.decode, files), strict=True):
        assert got[1:] == want[1:] and (got[0] == want[0]).all()
    assert webp.decode_many([]) == []


def test_written_side_by_side():
    """Images of many sizes and forms at once give the files that each gives alone, and read back."""
    rng = np.random.default_rng(9)
    images = []
    for k in range(60):
        width, height, colours = (int(x) for x in rng.integers(1, 30, 3))
        rgb = rng.integers(0, 256, (colours, 3))[np.repeat(rng.integers(0, colours, width * height), rng.integers(1, 9))[: width * height]].astype(np.uint8)
        images.append((rgb, width, {"cache_bits": int(rng.choice([0, 0, 3, 11])), "transforms": [(), (2,), (0, 1), (3,)][k % 4], "block_bits": 2}))
    files = webp.encode_many(images)
    for file, (rgb, width, form) in zip(files, images, strict=True):
        assert file == webp.encode(rgb, width, **form) and (webp.pixels(webp.decode(file)[0]) == rgb).all()
    assert webp.encode_many([]) == [] and webp.store_many([]) == []


def test_code_lengths_against_a_heap():
    import heapq

    def alone(counts, limit):
        while True:
            heap = [(n, i, (i,)) for i, n in enumerate(counts)]
            heapq.heapify(heap)
            depth = [int(len(counts) == 1)] * len(counts)
            while len(heap) > 1:
                (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
                for i in left + right:
                    depth[i] += 1
                heapq.heappush(heap, (a + b, len(counts) + len(counts) - len(heap), left + right))
            if max(depth) <= limit:
                return depth
            counts = [(n + 1) // 2 for n in counts]

    rng = np.random.default_rng(4)
    lanes = [[7], [1, 1], [3, 900], [2**k for k in range(30)], [1] * 312] + [(rng.integers(1, 50, n) ** rng.integers(1, 4)).tolist() for n in rng.integers(1, 200, 40).tolist()]
    flat, lane = np.array(sum(lanes, [])), np.repeat(np.arange(len(lanes)), [len(x) for x in lanes])
    found = webp.code_lengths(flat, lane)
    for k, counts in enumerate(lanes):
        assert found[lane == k].tolist() == alone(counts, webp.LIMIT)


def test_texts_are_encoded_together():
    """A block's texts share the encoder's steps: before, each of them took about a thousand calls."""
    import cProfile
    import pstats

    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 10, 300).tolist()]
    payloads = [(text := " ".join(words[i] for i in rng.integers(0, 300, 250).tolist()).encode()) + b"\xff" * (-len(text) % webp.ROW) for _ in range(300)]
    webp.store_many(payloads[:3])
    with cProfile.Profile() as profile:
        media = webp.store_many(payloads)
    assert pstats.Stats(profile).total_calls < 300 * len(payloads)
    assert media[:5] == [webp.store(p) for p in payloads[:5]] and [px.tobytes() for px, _ in webp.load_many(media)] == payloads
    assert webp.store_many(payloads, together=5000) == media and [m.count(b"RIFF") for m in webp.store_many(payloads, max_rows=1)] == [len(p) // webp.ROW for p in payloads]


def test_stored_images_need_every_part_of_the_decoder(spark):
    """Of the documents' images: each transform, the colour cache, literals, and back-references near and far."""
    from tallygrove.llm.common import table

    rows = table(spark, "/root/testdata/sf0.01", "documents").select("text").limit(300).collect()
    seen, cached, far, near = set(), 0, 0, 0
    for (t,) in rows:
        raw = (t or "").encode()
        rgb = np.frombuffer(raw + b"\xff" * (-len(raw) % 576 if raw else 576), dtype=np.uint8).reshape(-1, 3)
        form = webp.form_of(rgb, webp.PIXELS)
        _, head, undo, width, _ = webp.opened(webp.encode(rgb, webp.PIXELS, **form))
        seen |= {kind for kind, *_ in undo}
        cached += head["cache_bits"] > 0
        argb = rgb[:, 0].astype(np.int64) << 16 | rgb[:, 1].astype(np.int64) << 8 | rgb[:, 2]
        distances = [d for _, _, d in webp.references(argb)]
        near += sum(d in webp._near_codes(webp.PIXELS) for d in distances)
        far += sum(d not in webp._near_codes(webp.PIXELS) for d in distances)
    assert seen == {webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE} and cached and near and far


def test_broken_files():
    good = webp.encode(np.zeros((4, 3), dtype=np.uint8), 2)
    for bad in (b"", good[:12], b"RIFF" + good[4:12] + b"VP8 " + good[16:]):
        with pytest.raises((ValueError, struct.error)):
            webp.decode(bad)


def test_media_column(docs, odd_texts, empty):
    found = {r["doc_id"]: r for r in webp.round_trip(docs).collect()}
    for i, t in enumerate(odd_texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = webp.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert found[7][3:] == found[8][3:] and webp.round_trip(empty).count() == 0
    two = webp.store(bytes(range(256)) * 9, max_rows=2)
    assert webp.load_many([two])[0][0].tobytes() == bytes(range(256)) * 9 and two.count(b"RIFF") == 2


def test_licenses(spark, docs, empty):
    from tests.llm.conftest import documents

    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).count() == 0
    filler = "some words of no license at all stand here "
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    cut = " ".join(words[:40] + ["changed"] + words[41:])
    texts = [filler + mit.upper() + " " + filler, filler * 3 + cut, " ".join(words[:20]), "Released under the\nMIT   License!", None, filler + licenses.TEMPLATES["ISC"] + licenses.TEMPLATES["GPL-3.0-or-later"]]
    found = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(documents(spark, texts)).collect()}
    assert set(found) == {(0, "MIT"), (1, "MIT"), (3, "MIT-notice"), (5, "ISC"), (5, "GPL-3.0-or-later")}
    n = len(licenses.shingles_of(mit))
    assert found[0, "MIT"] == 1.0 and abs(found[1, "MIT"] - (n - 5) / n) < 1e-9


def test_every_template_is_told_from_its_rivals(spark):
    from tests.llm.conftest import documents

    names = list(licenses.TEMPLATES)
    filler = "some words of no license at all stand here "
    found = {(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(documents(spark, [filler * 3 + t + " " + filler * 3 for t in licenses.TEMPLATES.values()])).collect()}
    assert found == {(i, name, 1.0) for i, name in enumerate(names)}


def test_licenses_against_sql(spark):
    import random

    import duckdb

    from tallygrove.llm.oracles import SQL
    from tests.llm.conftest import documents

    draw, texts = random.Random(5), [None, ""]
    for _ in range(60):
        parts = []
        for t in draw.sample(list(licenses.TEMPLATES.values()), 3):
            words = t.split()
            words = [w for w in words if draw.random() > draw.choice((0.0, 0.01, 0.04))]
            parts += [" ".join(words[draw.choice((0, 0, len(words) // 12)) :]), " ".join(["word"] * draw.choice((0, 1, 30)))]
        texts.append(" ".join(parts))
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    held = {tuple(r) for r in con.execute(SQL["op3_licenses"]).fetchall()}
    found = [tuple(r[c] for c in ("doc_id", "license", "containment")) for r in licenses.scan(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == held and len({name for _, name, _ in found}) > 15
