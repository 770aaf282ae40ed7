"""Web archives with a two-level capture index.

Writing: each task appends its pages as separately compressed WARC records to an archive of its own in a
shared folder, under a name no other attempt uses; only rows of attempts that succeeded are
indexed. Index: capture lines are sorted by reversed-host key and page across range partitions; each
partition writes its lines in compressed blocks, and a sparse directory with the first key of each block. Reading: a
key is searched among the first keys of the partitions (one row per partition), then in that partition's directory, then in
one block fetched by a range read; a last range read fetches the record itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.llm.words import slices
from gazeframe.session import scratch_path

LEAST_SHARED_BYTES = 100
LINES_PER_BLOCK = 1000
ARCHIVE_BYTES = 1 << 30
_LAST_ID = (1 << 63) - 1

Key = tuple[bytes, int]


def reversed_host(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query. Null and odd URLs keep their text."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = parts.path or "/"
    if parts.query:
        tail += "?" + parts.query
    named = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + named + ")" + tail


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Page, type, payload size and digest of a record; a response's are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", s or "")) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


_CAPTURE = "surt string, page bigint, file string, offset bigint, length bigint"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(folder)
    out = name = None
    size = 0
    try:
        for batch in slices(batches, "html"):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html or b"", digest, refers_to)) + packer.flush()
                out.write(member)
                rows.append((reversed_host(url), _LAST_ID if page_id is None else page_id, name, size, len(member)))
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in _CAPTURE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of ``pages`` (``page_id``, ``url``, ``html``) once; returns its capture lines, made durable.

    Of records with equal payloads of ``LEAST_SHARED_BYTES`` or more, that with the smallest page is a response and the
    others revisit it. Null html is an empty payload; a null page counts as the largest.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("digest")
    )
    shared = (
        hashed.where(F.octet_length("html") >= LEAST_SHARED_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    roles = hashed.join(shared, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to")
    )
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    path = f"{folder}/captures"
    roles.mapInArrow(partial(_write, folder=folder), _CAPTURE).write.parquet(path)
    return spark.read.parquet(path)


_MANIFEST = "name string, surt string, page bigint, directory bigint, size bigint"


def _index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One index file: compressed blocks, then the compressed directory, whose place the manifest holds."""
    store, root = _open(folder)
    name = f"index-{uuid.uuid4().hex}.bin"
    directory: list[tuple] = []
    held: list[tuple] = []
    out, size = None, 0

    def block():
        nonlocal size
        packed = zlib.compress(json.dumps(held, ensure_ascii=False).encode())
        out.write(packed)
        directory.append((held[0][0], held[0][1], size, len(packed)))
        size += len(packed)

    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            held.append(line)
            if len(held) == LINES_PER_BLOCK:
                block()
                held = []
    if out is not None:
        if held:
            block()
        packed = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
        out.write(packed)
        out.close()
        row = (name, directory[0][0], directory[0][1], size, len(packed))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _MANIFEST.split(", ")]
        )


def build_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Writes the index; returns its manifest, one row per written partition, in key order."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "surt", "page").sortWithinPartitions("surt", "page", "file", "offset")
    rows = ordered.mapInArrow(partial(_index, folder=folder), _MANIFEST).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[1].encode(), r[2]))


class Index:
    """Searches keys in an index; keeps the last few directories and blocks it has read."""

    def __init__(self, folder: str, manifest: list[tuple]):
        self.store, self.root = _open(folder)
        self.manifest = manifest
        self.firsts: list[Key] = [(r[1].encode(), r[2]) for r in manifest]
        self.cache: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.store.open_input_file(f"{self.root}/{name}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)

    def _lines(self, name: str, offset: int, length: int) -> tuple[list[Key], list]:
        at = (name, offset)
        if at not in self.cache:
            lines = json.loads(zlib.decompress(self.read(name, offset, length)))
            self.cache[at] = ([(x[0].encode(), x[1]) for x in lines], lines)
            if len(self.cache) > 8:
                self.cache.popitem(last=False)
        self.cache.move_to_end(at)
        return self.cache[at]

    def find(self, key: Key) -> Iterator[list]:
        """All capture lines of a key; they may go on in following blocks and partitions."""
        part = max(0, bisect_left(self.firsts, key) - 1)
        while part < len(self.firsts) and self.firsts[part] <= key:
            name, _, _, offset, length = self.manifest[part]
            firsts, directory = self._lines(name, offset, length)
            block = max(0, bisect_left(firsts, key) - 1)
            while block < len(firsts) and firsts[block] <= key:
                keys, lines = self._lines(name, directory[block][2], directory[block][3])
                yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]
                block += 1
            part += 1


_FOUND = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches: Iterator[pa.RecordBatch], folder: str, manifest: list[tuple]) -> Iterator[pa.RecordBatch]:
    index = Index(folder, manifest)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for batch in batches:
        rows = []
        for surt, page in zip(batch.column("surt").to_pylist(), batch.column("page").to_pylist(), strict=True):
            for _, _, file, offset, length in index.find((surt.encode(), page)):
                got = parse(zlib.decompress(index.read(file, offset, length), 31))
                rows.append(tuple(got[n] for n in names))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        surts = [reversed_host(u) for u in batch.column("url").to_pylist()]
        page = np.array([_LAST_ID if p is None else p for p in batch.column("page_id").to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(surts, pa.string()), pa.array(page)], names=["surt", "page"])


def lookup(pages: DataFrame, folder: str, manifest: list[tuple]) -> DataFrame:
    """Records of every (``url``, ``page_id``) in ``pages``, each key asked once, in key order for near reads."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pages.select("url", F.col("page_id").cast("bigint").alias("page_id")).mapInArrow(_keys, "surt string, page bigint")
    ordered = asked.distinct().repartitionByRange(n, "surt", "page").sortWithinPartitions("surt", "page")
    return ordered.mapInArrow(partial(_read, folder=folder, manifest=manifest), _FOUND)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes, indexes and reads back every page; one row per record read.

    Repeated rows are separate records and come back as often; an empty table gives an empty result.
    """
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder)
    return lookup(pages, folder, build_index(captures, folder))
