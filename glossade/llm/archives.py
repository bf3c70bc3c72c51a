"""Operator 5: web archives packed in ZIP files, written and read by range.

An archive is a ZIP of stored members: archive/data.warc.gz (a gzip member a record) and indexes/index.cdxj (a JSON line a
record with offset and length). The reader parses the end record, the ZIP64 end record where it is needed and the central
directory, finds where the stored members begin, and reads single records by offset: nothing is extracted. Archives lie in
the shared folder and are opened by URI, so any store that pyarrow reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import re
import struct
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A new archive is begun when one has this many bytes.
ARCHIVE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\uffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "urn:none"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(stored: bytes) -> dict:
    """What a gzipped record holds: its header fields, and the payload's bytes, length and digest."""
    raw = gzip.decompress(stored)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    told = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"fields": fields, "payload": payload, "size": size, "digest": told}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def zipped(records: list[tuple[int | None, bytes]], zip64: bool = False) -> bytes:
    """An archive of (page_id, gzipped record) pairs; zip64 writes the large form whatever the size."""
    out, at, lines = io.BytesIO(), 0, []
    for page, r in records:
        lines.append(json.dumps({"page": page, "offset": at, "length": len(r)}))
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((DATA, [r for _, r in records]), (INDEX, ["\n".join(lines).encode()])):
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            with z.open(info, "w", force_zip64=zip64) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()


class ZipReader:
    """Members of a ZIP by range. read_at(n, offset) gives n bytes; size is the file's."""

    def __init__(self, read_at, size: int):
        self.read_at, self.members = read_at, {}
        tail_at = max(0, size - 65_557 - 20)
        tail = read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            place = end - 20
            if place < 0 or tail[place : place + 4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (at,) = struct.unpack_from("<Q", tail, place + 8)
            large = read_at(56, at)
            if large[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", large, 32)
        at, raw = 0, read_at(length, start)
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full, name_n, extra_n, note_n = struct.unpack_from("<H8xIIHHH", raw, at + 10)
            (local,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + name_n].decode()
            extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
            if 0xFFFFFFFF in (packed, full, local):
                packed, full, local = self._large(extra, packed, full, local)
            self.members[name] = (method, packed, local)
            at += 46 + name_n + extra_n + note_n

    @staticmethod
    def _large(extra: bytes, packed: int, full: int, local: int) -> tuple[int, int, int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                at += 4
                got = []
                for v in (full, packed, local):
                    if v == 0xFFFFFFFF:
                        (v,) = struct.unpack_from("<Q", extra, at)
                        at += 8
                    got.append(v)
                return got[1], got[0], got[2]
            at += 4 + n
        raise ValueError("no ZIP64 field")

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: no ranges")
        head = self.read_at(30, local)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        name_n, extra_n = struct.unpack_from("<HH", head, 26)
        return local + 30 + name_n + extra_n, size


def _open(uri: str):
    found, path = fs.FileSystem.from_uri(uri)
    return found, path


def write(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record a row of pages into archives under folder; gives (archive, records), already written as a table.

    Of rows with equal payloads of at least `least` bytes, those with the largest page_id are responses and the others revisits of it.
    A file gets a name of its own on each try, and only those of tries that ended well are listed, so lost tasks leave no trace in the result.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = own.where(F.octet_length("html") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("top")), F.col("top"))
    told = large.join(first, "digest", "left").select("page_id", "url", "html", "digest", other.alias("refers_to"))
    told = told.unionByName(own.where(F.octet_length("html") < least).withColumn("refers_to", F.lit(None).cast("long")))  # no other page can matter to these

    def run(batches):
        held, size = [], 0

        def put():
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            store, path = _open(uri)
            store.create_dir(os.path.dirname(path), recursive=True)
            with store.open_output_stream(path) as f:
                f.write(zipped(held))
            return pa.RecordBatch.from_pydict({"archive": [uri], "records": [len(held)]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                r = record(page, url, html.encode(), digest, refers)
                held.append((page, r))
                size += len(r)
                if size >= archive_bytes:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return written(told.mapInArrow(run, "archive string, records long"), "archives")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload) of each record of the archives listed in column archive.

    Records are found by the stored index and read by range. A response's payload is checked against its digest; a revisit tells the
    digest and length of the full payload. An archive without records gives no rows.
    """

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = _open(uri)
                with store.open_input_file(path) as f:
                    z = ZipReader(lambda n, at, f=f: f.read_at(n, at), f.size())
                    start, _ = z.stored(DATA)
                    at, n = z.stored(INDEX)
                    lines = [json.loads(x) for x in f.read_at(n, at).decode().split("\n") if x]
                    for k in range(0, len(lines), 256):
                        rows: list[tuple] = []
                        for x in lines[k : k + 256]:
                            got = parse(f.read_at(x["length"], start + x["offset"]))
                            v = got["fields"]
                            rows.append((_page(v["warc-record-id"]), got["size"], got["digest"], v["warc-type"], _page(v.get("warc-refers-to")), got["payload"]))
                        cols = [*zip(*rows)]
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + with_payload]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload])

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """write() to a new folder of the shared one, then read() of all its archives, one row a row of pages.

    A null html is an empty payload; a null url is recorded as urn:none. Rows with a null page_id are written and read with a null; among
    equal payloads they are revisits wherever some page_id is not null. Rows that repeat the largest page_id are all responses.
    """
    spark = pages.sparkSession
    archives = write(pages, new_path(spark, "wacz"))
    n = max(1, min(archives.count(), 100_000))
    return read(archives.repartition(n, F.xxhash64("archive")))


#: DuckDB: the rows that round_trip() gives.
SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM own),
tops AS (SELECT payload_digest, max(page_id) AS top FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM sized LEFT JOIN tops USING (payload_digest)"""
