"""Status documents, rebuilt tables, sizes of images and replaced files."""

import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import images, status, updates
from tallygrove.sources import sinks

START = datetime(2024, 5, 1, 6)
LOG = "job string, run int, at timestamp, seq int, kind string, step string, done int, total int, error string"


def log(spark, *rows):
    return spark.createDataFrame([("batch", run, START + timedelta(days=run, minutes=i), i, kind, *[*more, *[None] * (4 - len(more))]) for i, (run, kind, *more) in enumerate(rows)], LOG)


def test_status(spark):
    rows = [(0, "start"), (0, "step", "crawl"), (0, "progress", None, 3, 9), (0, "ok", "crawl"), (0, "step", "score"), (0, "finish"), (1, "start"), (1, "step", "crawl"), (1, "progress", None, 4, 8), (1, "failed", "crawl", None, None, "x" * 400)]
    rows += [(1, "step", "score"), (1, "failed", "score"), (1, "finish"), (2, "start"), (2, "step", "crawl"), (2, "note"), (2, "progress", None, 1, 2)]
    done, failed, running = status.run_status(log(spark, *rows)).orderBy("run").collect()
    assert (done["state"], done["completed_steps"], done["failures"], done["step"], done["step_done"], done["last_done_at"]) == ("done", ["crawl"], [], None, None, None)
    assert failed["state"] == "failed" and failed["last_done_at"] == done["finished_at"]
    assert [(f["step"], len(f["error"] or ""), f["done"], f["total"]) for f in failed["failures"]] == [("crawl", 300, 4, 8), ("score", 0, None, None)]
    assert (running["state"], running["step"], running["step_done"], running["step_total"], running["finished_at"]) == ("running", "crawl", 1, 2, None)
    assert running["last_done_at"] == done["finished_at"] and running["progress_at"] == START + timedelta(days=2, minutes=16)
    assert [r["run"] for r in status.current(status.run_status(log(spark, *rows))).collect()] == [2]
    assert status.run_status(log(spark, *rows).limit(0)).count() == 0


def test_document_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/status.json"
    for n in (1, 2):
        sinks.replace_document(spark.range(n, n + 1).select(sinks.as_json(["id"])), path)
        assert json.loads(open(path).read()) == {"id": n}
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["status.json"]


def test_rebuilt(spark, tmp_path):
    path = f"{tmp_path}/labels"
    spark.createDataFrame([("a", "core"), ("b", "na"), ("b", None)], "label string, verdict string").write.parquet(path)
    columns = {"label": "string", "verdict": "string", "pinned": "boolean"}
    allowed = lambda *x: {"verdict": F.col("verdict").isin(*x)}
    with pytest.raises(ValueError, match="verdict"):
        updates.rebuilt(spark.read.parquet(path), path, columns, checks=allowed("core"))
    with pytest.raises(ValueError, match="one row"):
        updates.rebuilt(spark.read.parquet(path), path, columns, unique={"one row": ["label"]})
    assert spark.read.parquet(path).columns == ["label", "verdict"]
    made = updates.rebuilt(spark.read.parquet(path), path, columns, defaults={"pinned": False}, checks=allowed("core", "na"))
    assert sorted(map(str, made.collect())) == sorted(map(str, spark.read.parquet(path).collect())) and made.filter("NOT pinned").count() == 3
    assert [x.name for x in tmp_path.iterdir()] == ["labels"]


def test_orphans_by_seconds(spark):
    runs = spark.createDataFrame([(k, START - timedelta(seconds=s), None, None, e) for k, s, e in ((1, 1800, None), (2, 1801, None), (3, 9000, "late"))], "id int, begun timestamp, ended timestamp, result string, error string")
    found = updates.orphans_closed(runs, started="begun", ended="ended", result="result", error="error", as_of="2024-05-01 06:00:00", minutes=30).orderBy("id").collect()
    assert [r["result"] for r in found] == [None, "failed", "failed"] and found[2]["error"].startswith("late [orphan") and found[1]["ended"] == START


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (1500).to_bytes(4) + (3301).to_bytes(4)
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (17_000).to_bytes(2, "little")
    uris = ["data:image/png;base64," + base64.b64encode(png).decode(), "data:image/gif;base64," + base64.b64encode(gif).decode(), "data:image/png;base64,???", "https://www.example.com/a.png", None, "data:image/jpeg;base64,/9j/"]
    rows = spark.createDataFrame([(1, i, u) for i, u in enumerate(uris)], "p int, i int, uri string").select("p", "i", images.image_size(images.data_content(F.col("uri"))).alias("s")).select("p", "i", "s.*")
    assert [(r["width"], r["height"]) for r in rows.orderBy("i").collect()] == [(1500, 3301), (300, 17_000), *[(None, None)] * 4]
    cut = images.slices(rows, posting="p", ordinal="i").orderBy("part").collect()
    assert [r["part"] for r in cut] == list(range(14)) and [(r["i"], r["width"], r["top"], r["bottom"]) for r in cut[:4]] == [(0, 1000, 0, 1100), (0, 1000, 1060, 2200), (1, 300, 0, 1100), (1, 300, 1060, 2200)]


def test_images_of_one_ordinal(spark):
    """Their slices alternate from the top, and the limit counts them so; a null ordinal comes last."""
    rows = spark.createDataFrame([(1, 2, 300, 2500), (1, 2, 400, 1500), (1, 2, 300, 1000), (1, 1, 500, 900), (1, None, 200, 20_000), (1, 3, 999, 1100)], "p int, i int, width int, height int")
    cut = images.slices(rows, posting="p", ordinal="i").orderBy("part").collect()
    want = [(1, 500, 0, 900), (2, 300, 0, 1000), (2, 300, 0, 1100), (2, 400, 0, 1100), (2, 300, 1060, 2200), (2, 400, 1060, 1500), (2, 300, 2160, 2500), (3, 999, 0, 1100)]
    assert [(r["i"], r["width"], r["top"], r["bottom"]) for r in cut] == want + [(None, 200, max(0, k * 1100 - 40), k * 1100 + 1100) for k in range(6)]
    assert [r["part"] for r in images.slices(rows, posting="p", ordinal="i", most=3).orderBy("part").collect()] == [0, 1, 2]
