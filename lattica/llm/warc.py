"""WARC archives with a two-level capture index (operator 5).

Records are written as gzip members to archive files; equal payloads are stored
once and revisited. The index sorts captures by reversed-host URL key into files
of compressed blocks; each file ends with a sparse directory of its blocks' first
keys. A look-up finds the file by its key range, binary-searches the directory,
inflates one block, binary-searches that, and range-reads the records.

Archives and index lie under the shared folder (or any root that pyarrow's file
systems open). Every attempt of a task writes a file of its own name and reports
places in that file alone, so a lost executor leaves an orphan, never a mix.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, arrow_map, map_arrow

#: Lines of an index block, captures of an index file, bytes of an archive file.
BLOCK_LINES = 1000
PART_LINES = 100_000
ARCHIVE_BYTES = 1 << 30
_LEVEL = 4
_DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_MAGIC = b"LCDX0001"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: com,example,www)/path?query. Scheme and
    case of the host don't count; a url without `://` is its own key."""
    if not url:
        return ""
    _, found, rest = url.partition("://")
    if not found:
        return url
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|<>^`{}\\\""))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = (_HTTP + "\r\n").encode()
    else:
        block = f"{_HTTP}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", _LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _proof(payload: bytes) -> bytes:
    """A second digest: payloads can be made that share a SHA-1."""
    return hashlib.sha256(payload).digest()[:16]


def _digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size, proof) of each page's payload."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        bodies = [b.encode() if b else b"" for b in batch.column(1).to_pylist()]
        yield {"page_id": batch.column(0), "digest": [payload_digest(b) for b in bodies], "size": [len(b) for b in bodies], "proof": [_proof(b) for b in bodies]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), rows, "page_id long, digest string, size long, proof binary", 512)


def _encode(pages: DataFrame) -> DataFrame:
    """Each page with its key, digest and its record as a response."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, urls, bodies = (c.to_pylist() for c in batch.columns)
        bodies = [b.encode() if b else b"" for b in bodies]
        digests = [payload_digest(b) for b in bodies]
        yield {
            "page_id": ids, "url": urls, "key": [url_key(u) for u in urls], "digest": digests, "proof": [_proof(b) for b in bodies],
            "record": [_record("response", *r, None) for r in zip(ids, urls, digests, bodies)],
        }

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(some, rows, "page_id long, url string, key string, digest string, proof binary, record binary", 256)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def write_archives(space: Workspace, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) and return the
    captures: key, page_id, file, offset, length.

    Of records with equal payloads of at least `least_bytes` bytes the one with the
    largest page_id is a response, the others revisit it. Rows that repeat that
    page_id and payload are responses too. A null html is an empty payload, a null
    url gives a record without target and an empty key; a row with a null page_id
    revisits where another row of its payload has an id.
    """
    # Narrow rows decide what revisits what; payloads are read once more, and only their
    # compressed records are shuffled, by id and digest, which no hot payload crowds.
    narrow = _digests(pages)
    latest = narrow.where(F.col("size") >= least_bytes).groupBy("digest", "proof").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = narrow.join(latest, ["digest", "proof"]).where(F.col("size") >= least_bytes).where("not (page_id <=> refers_to)").select(F.col("page_id").alias("a_id"), F.col("digest").alias("a_digest"), F.col("proof").alias("a_proof"), "refers_to").distinct()
    encoded = _encode(pages)
    root = space.path("warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(root)
        system.create_dir(folder, recursive=True)
        task, out, number = TaskContext.get(), None, 0
        for batch in batches:
            keys, ids, files, offsets, lengths = [], [], [], [], []
            for page_id, url, key, digest, record, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if refers_to is not None:
                    record = _record("revisit", page_id, url, digest, b"", refers_to)
                if out is not None and out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    number += 1
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                keys.append(key), ids.append(page_id), files.append(name), offsets.append(out.tell()), lengths.append(len(record))
                out.write(record)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    revisits = (F.col("digest") == F.col("a_digest")) & (F.col("proof") == F.col("a_proof")) & F.col("page_id").eqNullSafe(F.col("a_id"))
    done = encoded.join(again, revisits, "left").select("page_id", "url", "key", "digest", "record", "refers_to")
    return space.table("captures", map_arrow(done, write, "key string, page_id long, file string, offset long, length long"))


def build_index(space: Workspace, captures: DataFrame) -> list[tuple[str, str, str]]:
    """Write the index and return (file, first key, last key) of each of its files,
    in order of keys: one entry for PART_LINES captures."""
    root = space.path("index")
    spark = space.spark

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, name, out, system = TaskContext.get(), None, None, None
        directory, lines, first, last = [], [], None, None

        def flush() -> None:
            nonlocal lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([json.loads(lines[0])[0], out.tell(), len(data)])
            out.write(data)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, folder = _open(root)
                    system.create_dir(folder, recursive=True)
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                first, last = row[0] if first is None else first, row[0]
                lines.append(json.dumps(row))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            at, data = out.tell(), zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + struct.pack("<QQ", at, len(data)) + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, first, last)], names=["file", "first", "last"])

    parts = max(1, ceil(captures.count() / PART_LINES), min(spark.sparkContext.defaultParallelism, captures.count() // BLOCK_LINES))
    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "file", "offset", "length")
    files = map_arrow(ordered, write, "file string, first string, last string")
    return sorted((r["first"], r["last"], r["file"]) for r in space.table("parts", files).collect())


class _Reader:
    """Files of one root, a few kept open, read by range."""

    def __init__(self, root: str, most: int = 32):
        self.system, self.folder = _open(root)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    def file(self, name: str) -> pa.NativeFile:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.system.open_input_file(f"{self.folder}/{name}")
        return self.open[name]

    def range(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)


class IndexFile:
    """One index file: its directory in memory, blocks read when asked for."""

    def __init__(self, reader: _Reader, name: str):
        self.reader, self.name = reader, name
        size = reader.file(name).size()
        tail = reader.range(name, size - 24, 24)
        if tail[16:] != _MAGIC:
            raise ValueError(f"not an index file: {name}")
        at, length = struct.unpack("<QQ", tail[:16])
        self.directory = json.loads(zlib.decompress(reader.range(name, at, length)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list[str], list[list]] = (-1, [], [])

    def _block(self, n: int) -> tuple[list[str], list[list]]:
        if self.held[0] != n:
            _, offset, length = self.directory[n]
            rows = [json.loads(line) for line in zlib.decompress(self.reader.range(self.name, offset, length)).decode().split("\n")]
            self.held = (n, [r[0] for r in rows], rows)
        return self.held[1:]

    def find(self, key: str) -> Iterator[list]:
        """Captures (key, file, offset, length) of a key; they may span blocks."""
        n = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while n < len(self.firsts) and self.firsts[n] <= key:
            keys, rows = self._block(n)
            yield from rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            n += 1


def look_up(space: Workspace, index: list[tuple[str, str, str]], urls: DataFrame) -> DataFrame:
    """Every capture of the distinct `urls` (url): page_id, url_key, record_type,
    payload_digest, payload_bytes, refers_to; from the records themselves, whose
    payloads are checked against their digests. payload_bytes of a revisit is null.

    A group is one index file's keys, PART_LINES at most. Groups are dealt out by number:
    their rows are tiny, but each stands for a payload that its task reads.
    """
    firsts, lasts = [x[0] for x in index], [x[1] for x in index]
    warc_root, index_root = space.path("warc"), space.path("index")

    def place(batch: pa.RecordBatch) -> Iterator[dict]:
        keys, parts = [], []
        for key in map(url_key, batch.column(0).to_pylist()):
            for part in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                keys.append(key), parts.append(part)
        yield {"key": keys, "part": parts}

    def search(group: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=["page_id", "url_key", "record_type", "payload_digest", "payload_bytes", "refers_to"])
        archives = _Reader(warc_root)
        file = IndexFile(_Reader(index_root), index[int(group["part"].iloc[0])][2])
        found = [capture for key in sorted(group["key"]) for capture in file.find(key)]
        found.sort(key=lambda c: (c[1], c[2]))
        out = []
        for key, name, offset, length in found:
            headers, payload = parse_record(archives.range(name, offset, length))
            digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
            if kind == "response" and payload_digest(payload) != digest:
                raise ValueError(f"{name} at {offset}: the payload is not the one that was written")
            page, refers = headers["warc-x-page-id"], headers.get("warc-refers-to")
            out.append((int(page) if page else None, key, kind, digest, len(payload) if kind == "response" else None, int(refers[len("<urn:capture:") : -1]) if refers else None))
        return pd.DataFrame(out, columns=["page_id", "url_key", "record_type", "payload_digest", "payload_bytes", "refers_to"]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    keys = arrow_map(urls.select(F.col("url").cast("string").alias("url")), place, "key string, part int", 4096).distinct()
    return keys.repartition(max(1, 2 * len(index)), "part").groupBy("part").applyInPandas(search, "page_id long, url_key string, record_type string, payload_digest string, payload_bytes long, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Write archives and index of every row of `pages`, look every url up again, and
    return per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A revisit takes its size from the response it refers to. Other columns of
    `pages` are ignored; an empty table gives an empty result. See write_archives
    for nulls, ties and repeated rows. Files stay below `root` if one is given."""
    space = Workspace(spark, "warc", root)
    index = build_index(space, write_archives(space, pages, least_bytes))
    read = space.table("read", look_up(space, index, pages.select("url").distinct()))
    sizes = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    return read.join(sizes, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Base32 of SHA-1: each five hexadecimal digits give four characters.
OP5_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * g, 5))::BIGINT >> s) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(max(page_id) OVER w, page_id) AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
