"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges.

An archive is a ZIP file with two stored (uncompressed) members: a WARC file
whose records are compressed one by one, and an index with a line for each
record (record id, offset and length within the member). Sizes and offsets
are written as ZIP64 throughout. A task writes its pages as they stream by,
beginning a new archive every ``MAX_BYTES``; names are unique to the attempt,
and only archives in the manifest that the tasks return count, so a repeated
or lost attempt leaves no trace in the result.

Reading takes the end of the file, the (ZIP64) end-of-directory record and the
central directory to find the members; the index is read by its range, and its
lines are dealt out in blocks of records that lie next to each other, a block to
a range read. The number of tasks follows from the size of the archives in the
manifest. No archive is extracted or read whole. Files are opened through
``pyarrow.fs`` by the URI of the shared folder, so that any store it knows
will do.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: that with the
largest page_id is a response, the others are revisits without a payload
that refer to it and keep its digest and length.

Edge cases: null html is an empty payload; repeated rows of the largest
page_id are responses each; a page without an id is a response with an empty
id and comes back with a null id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import own_folder, stored

MIN_REVISIT = 1000
MAX_BYTES = 256 << 20
#: One range read covers this many records at most, and about this many bytes.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Bytes of archives that a task reads.
TASK_BYTES = 64 << 20
DATA, INDEX = b"archive/data.warc.gz", b"indexes/index.jsonl"
_TOP = 0xFFFFFFFF


class Member(NamedTuple):
    name: bytes
    method: int
    size: int
    header: int  # offset of the local header


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += ["WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Writer:
    """Writes one archive to an output stream, front to back."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.lines, self.crc = stream, 0, [], 0
        self.data_header = self._begin(DATA)
        self.data_start = self.at

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def _begin(self, name: bytes) -> int:
        at = self.at  # sizes and checksum follow the data (flag 8), as 64-bit values
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 8, 0, 0, 33, 0, _TOP, _TOP, len(name), len(extra)) + name + extra)
        return at

    def add(self, page_id: int | None, record: bytes) -> None:
        self.lines.append((page_id, self.at - self.data_start, len(record)))
        self.crc = zlib.crc32(record, self.crc)
        self._put(record)

    def close(self) -> None:
        size = self.at - self.data_start
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, size, size))
        found = [(DATA, self.data_header, self.crc, size)]
        index = "".join(json.dumps({"id": p, "offset": o, "length": n}) + "\n" for p, o, n in self.lines).encode()
        header = self._begin(INDEX)
        self._put(index)
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", zlib.crc32(index), len(index), len(index)))
        found.append((INDEX, header, zlib.crc32(index), len(index)))
        start = self.at
        for name, header, crc, size in found:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 8, 0, 0, 33, crc, _TOP, _TOP, len(name), len(extra), 0, 0, 0, 0, _TOP) + name + extra)
        size, end = self.at - start, self.at
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(found), len(found), size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, _TOP, _TOP, 0))
        self.stream.close()


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    raw = f.read(n)
    if len(raw) != n:
        raise ValueError(f"the archive ends within {n} bytes at {at}")
    return raw


def directory(f, size: int) -> list[Member]:
    """Members of a ZIP file, from its end: classic or ZIP64."""
    tail_at = max(0, size - 65557)
    tail = _range(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    where = tail_at + at
    if where >= 20 and (n == 0xFFFF or _TOP in (length, start)):
        mark, _, end64, _ = struct.unpack("<4sIQI", _range(f, where - 20, 20))
        if mark == b"PK\6\7":
            found = struct.unpack("<4sQHHIIQQQQ", _range(f, end64, 56))
            if found[0] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where its locator points")
            n, length, start = found[7], found[8], found[9]
    raw, members, at = _range(f, start, length), [], 0
    for _ in range(n):
        mark, *_, method, _, _, _, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
        if mark != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        name = raw[at + 46 : at + 46 + n_name]
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                plain = next(wide) if plain == _TOP else plain
                packed = next(wide) if packed == _TOP else packed
                header = next(wide) if header == _TOP else header
            k += 4 + m
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name!r} is not stored")
    head = _range(f, member.header, 30)
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def parse(record: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one compressed record.

    A response's digest and length are computed from its payload and held against its headers.
    """
    raw = zlib.decompress(record, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("a payload does not match its record")
    number = lambda x: int(x) if (x := x.removeprefix(b"<urn:page:").removesuffix(b">")) else None
    return number(fields[b"WARC-Record-ID"]), length, digest, kind, number(fields[b"WARC-Refers-To"]) if kind == "revisit" else None


def write(pages: DataFrame, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html, refers_to); returns their manifest (path, size, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, path = None, ""

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.record_batch([pa.array([f"{folder}/{path}"]), pa.array([writer.at]), pa.array([len(writer.lines)])], ["path", "size", "records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                if writer is None:
                    path = f"{uuid.uuid4().hex}.wacz"
                    writer = Writer(store.open_output_stream(f"{root}/{path}"))
                writer.add(page_id.as_py(), _record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                if writer.at >= max_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long, records long"))


def read(manifest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Records of the archives in ``manifest``: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, size in (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                found = {m.name: m for m in directory(f, size)}
                index = _range(f, data_start(f, found[INDEX]), found[INDEX].size)
                base = data_start(f, found[DATA])
            rows: list[tuple[str, int, list[int]]] = []
            held, end = 0, -1
            for x in map(json.loads, index.splitlines()):
                if not rows or x["offset"] != end or len(rows[-1][2]) >= block or held >= BLOCK_BYTES:
                    rows.append((path, base + x["offset"], []))
                    held = 0
                rows[-1][2].append(x["length"])
                held, end = held + x["length"], x["offset"] + x["length"]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64())))], ["path", "at", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, at, lengths in (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                raw = memoryview(_range(f, at, sum(lengths)))
            ends = list(accumulate(lengths))
            out = [parse(raw[b - n : b]) for n, b in zip(lengths, ends)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = manifest.select("path", "size").repartition("path").mapInArrow(locate, "path string, at long, lengths array<bigint>")
    held = manifest.agg(F.sum("size").alias("bytes"), F.sum(F.ceil(F.col("records") / block)).alias("blocks")).first()
    least = min(held["blocks"] or 1, manifest.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, least, -(-(held["bytes"] or 0) // TASK_BYTES))
    return ranges.repartition(tasks, "path", "at").mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: the page whose equal payload stands for this one.

    Payloads are told apart by digest, and only (page_id, digest) of the large ones meet by digest. What
    they refer to is joined back by page and digest, so that neither equal payloads, small ones nor rows
    without an id come together with their html.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first <> last").select("digest", "last")
    key = F.concat_ws("/", F.col("page_id").cast("string"), F.col("digest"))
    revisits = large.join(last, "digest").where("page_id <> last").select(key.alias("key"), F.col("last").alias("refers_to")).distinct()
    return rows.withColumn("key", key).join(revisits, "key", "left").select("page_id", "url", "html", "refers_to")


def query(pages: DataFrame) -> DataFrame:
    return read(write(with_revisits(pages), own_folder(pages.sparkSession, "warc")))


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""
