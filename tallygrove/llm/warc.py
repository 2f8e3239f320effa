"""WARC records in ZIP packages: written by Spark tasks, and read back by byte ranges without extraction.

A package is a ZIP file with a stored (not deflated) member archive/data.warc.gz, one gzip member a record, and a stored member
indexes/index.cdxj that has each record's offset and length. The reader parses the end record, the ZIP64 records where they are present,
and the central directory; it finds where a stored member's bytes lie, reads the index, and then reads records by range.

Writing: a task writes its partition's rows in packages of bounded size to the shared folder, under names of its own, and returns their
paths; a retried task's earlier packages are never listed and so never read. Equal payloads of at least min_bytes are told by SHA-1,
counted with a partial aggregate, and only digests that occur more than once are joined back; Spark splits a hot digest's rows.

Defined cases: a null html is an empty payload; a null url leaves the target out; every row with the smallest page_id of its payload is a
response (so are exact repeats of that row), and rows with a null page_id count as the largest; an empty table writes no package
and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import blocks, cut, emit, frees, fresh_path

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGES = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


# -- records ---------------------------------------------------------------------------------------------------------------------------
def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def base32_sha1(payload: bytes) -> str:
    """The payload's SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 response or revisit record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Columns of a record; the payload's size and digest are computed for a response and taken from the headers for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = stated if revisit else base32_sha1(payload)
    if digest != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")) if revisit else len(payload)
    return {"page_id": _from_urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _from_urn(fields.get("WARC-Refers-To"))}


# -- packages --------------------------------------------------------------------------------------------------------------------------
def package(rows: Iterator[tuple]) -> bytes:
    """A ZIP package of (page_id, url, payload, refers_to, revisit) rows."""
    out, lines = io.BytesIO(), []
    for page_id, url, payload, refers_to, revisit in rows:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = squeeze.compress(record(page_id, url, payload, refers_to, revisit)) + squeeze.flush()
        lines.append(f"{_urn(page_id)} 19700101000000 " + json.dumps({"url": url, "mime": "warc/revisit" if revisit else "text/html", "digest": f"sha1:{base32_sha1(payload)}", "offset": out.tell(), "length": len(data), "filename": WARC_MEMBER.split("/")[1]}))
        out.write(data)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(WARC_MEMBER, out.getbuffer())
        z.writestr(INDEX_MEMBER, "\n".join(lines))
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": WARC_MEMBER}, {"path": INDEX_MEMBER}]}))
    return whole.getvalue()


class Package:
    """A ZIP package in any store that pyarrow opens, read by ranges."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = self._directory()

    @classmethod
    def open(cls, uri: str) -> Package:
        store, path = fs.FileSystem.from_uri(uri)
        return cls(store.open_input_file(path), store.get_file_info(path).size)

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{length} bytes asked for at {offset}, {len(data)} there")
        return bytes(data)

    def _directory(self) -> dict[str, dict]:
        tail_size = min(self.size, 65_557)  # the end record and the longest comment
        tail = self.read(self.size - tail_size, tail_size)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self.read(self.size - tail_size + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            end = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is missing")
            count, length, offset = struct.unpack("<QQQ", end[32:56])
        directory, members, at = self.read(offset, length), {}, 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, plain, name_n, extra_n, note_n, start = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
            name = directory[at + 46 : at + 46 + name_n].decode()
            extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # 64-bit values, in this order, of the fields that are all ones
                    wide = [v[0] for v in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                extra = extra[4 + n :]
            members[name] = {"method": method, "size": plain, "packed": packed, "header": start}
            at += 46 + name_n + extra_n + note_n
        return members

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the package, and how many there are."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        header = self.read(m["header"], 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        name_n, extra_n = struct.unpack("<HH", header[26:30])
        return m["header"] + 30 + name_n + extra_n, m["size"]

    def index(self) -> list[tuple[int, int]]:
        """(offset, length) of every record of the archive member, in order."""
        lines = self.read(*self.locate(INDEX_MEMBER)).decode().split("\n")
        entries = [json.loads(x[x.index("{") :]) for x in lines if x]
        return sorted((e["offset"], e["length"]) for e in entries)

    def records(self, run_bytes: int = 4 << 20) -> Iterator[dict]:
        """Every record; neighbouring ones are read in one range of about run_bytes."""
        base, size = self.locate(WARC_MEMBER)
        entries, i = self.index(), 0
        while i < len(entries):
            j, first = i, entries[i][0]
            while j < len(entries) and (j == i or entries[j][0] + entries[j][1] - first <= run_bytes):
                j += 1
            last = entries[j - 1]
            if last[0] + last[1] > size:
                raise ValueError("the index points past the archive member")
            data = self.read(base + first, last[0] + last[1] - first)
            for offset, length in entries[i:j]:
                yield parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))
            i = j


# -- Spark -----------------------------------------------------------------------------------------------------------------------------
def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to: the smallest page_id of the payload where another row is the response."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    again = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return rows.join(again, "digest", "left").select("page_id", "url", "payload", F.expr("CASE WHEN first IS NOT NULL AND NOT (page_id <=> first) THEN first END").alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, *, package_bytes: int = 16 << 20) -> DataFrame:
    """archive, records, bytes of the packages that the rows of with_revisits() were written to."""

    @frees
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        for block in blocks(batches, "payload", package_bytes):
            listed = block.to_pylist()
            data = package((r["page_id"], r["url"], r["payload"], r["refers_to"], r["refers_to"] is not None) for r in listed)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            yield emit({"archive": [f"{folder}/{name}"], "records": [len(listed)], "bytes": [len(data)]}, PACKAGES)

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


def read_packages(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Every record of the packages listed in column archive."""

    @frees
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for r in Package.open(uri).records():
                    if not with_payload:
                        r["payload"] = None
                    held.append(r)
                    size += r["payload_bytes"] if with_payload else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, RECORDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, RECORDS)

    return archives.select("archive").mapInArrow(run, RECORDS_DDL)


def find_packages(spark: SparkSession, folder: str) -> DataFrame:
    """archive of every package below a folder; only names are listed, no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("archive"))


def round_trip(pages: DataFrame, *, min_bytes: int = 0, package_bytes: int = 16 << 20) -> DataFrame:
    """Pages written to packages and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    written = cut(write_packages(with_revisits(pages, min_bytes=min_bytes), fresh_path(spark, "packages"), package_bytes=package_bytes), "manifest")
    spread = written.repartition(max(1, written.count()))
    return read_packages(spread, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
