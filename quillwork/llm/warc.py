"""WARC archives: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own, so an archive may be read from any
member. The reader cuts archives into byte ranges; a task scans its range for
the gzip magic, accepts a candidate only if it decodes to a WARC header and to
as many bytes as the header says, and then walks from member to member. It owns
the records that start inside its range and reads past the end to finish the
last one. Archives are listed and opened with the file system their address
names, by ranges, never whole.

Writers give each archive a name of its own and return it as a row; only
archives named in the written list are read, so what a lost or repeated task
left behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import slices, store

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
           "payload binary")
SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with none."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest.hex()}')}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}/{digest.hex()}')}>",
                  f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address if "://" in address else f"file://{address.removeprefix('file:')}")


def _write_task(folder: str, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, count))
            out = None

        for batch in slices(batches, text=2):
            ids, urls, pages, refers = (batch.column(i).to_pylist() for i in range(4))
            for page_id, url, html, refers_to in zip(ids, urls, pages, refers):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                payload = (html or "").encode()
                data = gzip_member(record(page_id, url, payload, hashlib.sha1(payload).digest(), refers_to), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist([{"path": p, "bytes": s, "records": c} for p, s, c in done], pa.schema(
                [("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))
    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, level: int = 6,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages (page_id, url, html)``; the list of archives ``(path, bytes, records)``.

    A null html has an empty payload. Of rows with equal payloads of at least ``min_revisit`` bytes those with the
    largest id are responses and others revisit it. Repeated rows are a record each. A row without an id is a response
    that no other refers to. Other columns are not looked at. An empty table gives an empty list.
    """
    rows = pages.select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    keys = rows.filter("page_id IS NOT NULL").select("page_id", F.sha2(html, 256).alias("payload"), F.octet_length(html).alias("n")).filter(
        F.col("n") >= min_revisit).select("page_id", "payload")
    first = keys.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to")
    revisits = (keys.join(first, "payload").filter("page_id < refers_to")
                .select(F.col("page_id").alias("p"), F.xxhash64("payload").alias("k"), "refers_to").distinct())
    joined = rows.join(revisits, (F.col("page_id") == F.col("p")) & (F.xxhash64(F.sha2(html, 256)) == F.col("k")), "left")
    return store(joined.select("page_id", "url", "html", "refers_to").mapInArrow(
        _write_task(folder, level, archive_bytes), "path string, bytes bigint, records bigint"), "archives")


class _Bytes:
    """An archive as a growing buffer that starts at ``start``."""

    def __init__(self, source, start: int):
        self.source, self.buffer, self.start = source, bytearray(), start
        source.seek(start)

    def more(self) -> bool:
        got = self.source.read(READ_BYTES)
        self.buffer += got
        return bool(got)

    def drop(self, upto: int) -> None:
        del self.buffer[:upto - self.start]
        self.start = upto


def member_at(held: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and the place after it; null unless it holds a whole WARC record."""
    unpack, out, fed, size = zlib.decompressobj(31), [], at - held.start, 0
    try:
        while not unpack.eof:
            if fed >= len(held.buffer) and not held.more():
                return None
            chunk = bytes(held.buffer[fed:fed + 65536])
            fed += len(chunk)
            out.append(unpack.decompress(chunk))
            size += len(out[-1])
            if len(out) <= 2 and size >= 7 and not b"".join(out).startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    data = b"".join(out)
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not data.startswith(b"WARC/1."):
        return None
    length = headers(head).get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return data, held.start + fed - len(unpack.unused_data)


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def members(source, start: int, stop: int) -> Iterator[bytes]:
    """Records that start in ``[start, stop)``."""
    held, at, synced = _Bytes(source, start), start, False
    while at < stop:
        if not synced:
            found = held.buffer.find(MAGIC, at - held.start)
            if found < 0:
                at = max(at, held.start + len(held.buffer) - 2)
                held.drop(at)
                if not held.more():
                    return
                continue
            at = held.start + found
            if at >= stop:
                return
        got = member_at(held, at)
        if got is None:
            synced, at = False, at + 1
            continue
        yield got[0]
        synced, at = True, got[1]
        held.drop(at)


def parse(data: bytes) -> tuple[int | None, str, str, int | None, int | None, str | None, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    number = lambda name: int(fields[name]) if name in fields else None
    return (number("x-page-id"), fields.get("warc-target-uri", ""), fields.get("warc-type", ""),
            number("x-refers-to-page-id"), number("x-payload-length"), sha1_hex(fields.get("warc-payload-digest", "")),
            rest[:int(fields["content-length"])])


def sha1_hex(digest: str) -> str | None:
    kind, _, value = digest.partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" and len(value) == 32 else value.lower() or None


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, path = _open(row["path"])
            held, size = [], 0
            with files.open_input_file(path) as source:
                for data in members(source, row["start"], row["stop"]):
                    held.append(parse(data))
                    size += len(data)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of ``archives (path, bytes)``: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest`` (as recorded), ``payload``.

    Ranges are dealt out evenly, so one large archive is many tasks. Records that are not whole are passed over.
    """
    spark = archives.sparkSession
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.expr(
        f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start")).select(
        "path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(_read_task, RECORDS)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes)`` of existing archives, listed by Spark; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def digests(records: DataFrame) -> DataFrame:
    """Size and SHA-1 of each record's full payload: of the bytes read for a response, as recorded for a revisit."""
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "page_id", F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
