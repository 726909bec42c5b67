"""WARC archives: a writer, and a reader that splits compressed archives.

The writer puts one gzip member per record. Records with equal payload are found
by a shuffle on the payload digest; the one with the largest key is a response,
the others are revisits that name it and carry no payload. Archive names hold a
random part, and only files named in the returned table count, so a task that
runs twice leaves no second copy in what is read.

The reader cuts archives into byte ranges. A task looks for the gzip magic in
its range, tries each place by inflating the first bytes and parsing a WARC
header, and owns the records that start inside its range, reading past the end of
the range where the last one needs it. Its memory is bounded by the block size
and the longest record.

Files are reached by pyarrow's filesystems, in tasks only. Defined results: a
null or empty payload is a record of no bytes; equal payloads with equal keys
(repeated rows) are one response each; a row without a key is a response; an empty table writes no archive; a range
without a record start gives no rows; a truncated or damaged member raises
ValueError at its owner.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import map_arrow, written

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
HEAD_LIMIT = 1 << 16
ARCHIVE_BYTES = 64 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: object) -> str:
    """Header values hold no line breaks."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def record(key: object, uri: str | None, payload: bytes, refers_to: object = None, digest: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit without payload if refers_to is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{key}>",
        f"WARC-Target-URI: {one_line(uri)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest or base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives; returns a row (path, bytes, records) for each, from a written table."""
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    first = rows.groupBy("digest").agg(F.max("key").alias("newest"))
    slim = rows.select("key", "digest").join(first, "digest").where("key < newest").select("key", "digest", "newest").distinct()
    ready = rows.join(slim, ["key", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]):
        names, sizes, counts = [], [], []
        out = target = path = None

        def close():
            out.close()
            target.move(f"{path}.part", path)
            names.append(f"{scheme}{path}")

        for batch in batches:
            for k, u, p, d, n in zip(*(batch.column(c).to_pylist() for c in ("key", "uri", "payload", "digest", "newest")), strict=True):
                if out is None:
                    target, root = filesystem(folder)
                    scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
                    target.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = target.open_output_stream(f"{path}.part", compression=None)
                    sizes.append(0)
                    counts.append(0)
                data = record(k, u, p.encode("utf-8", "replace"), n, base64.b32encode(bytes.fromhex(d)).decode())
                out.write(data)
                sizes[-1] += len(data)
                counts[-1] += 1
                if sizes[-1] >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    columns = ["key", "uri", "payload", "digest", "newest"]
    return written(map_arrow(ready, columns, write, "path string, bytes long, records long", without=columns), "archives")


class Range:
    """Bytes of a file from a place on, read in blocks and let go once used."""

    def __init__(self, file, begin: int):
        self.file, self.begin, self.data, self.ended = file, begin, b"", False
        file.seek(begin)

    def more(self) -> bool:
        block = b"" if self.ended else self.file.read(BLOCK)
        self.ended |= not block
        self.data += block
        return bool(block)

    def drop(self, to: int) -> None:
        self.data, self.begin = self.data[to - self.begin :], to


def head_of(data: bytes) -> bool:
    """Whether a gzip member that begins here inflates to the start of a WARC record."""
    try:
        start = zlib.decompressobj(31).decompress(data[:4096], 64)
    except zlib.error:
        return False
    return start.startswith(b"WARC/1.") and b"\r\n" in start


def member(source: Range, at: int) -> tuple[bytes, int]:
    """The inflated member that begins at this place, and where it ends."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    while not inflate.eof:
        if place - source.begin >= len(source.data) and not source.more():
            raise ValueError(f"the record at byte {at} is cut off")
        chunk = source.data[place - source.begin : place - source.begin + BLOCK]
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as e:
            raise ValueError(f"the record at byte {at} is damaged: {e}") from e
        place += len(chunk) - len(inflate.unused_data)
    return b"".join(parts), place


def parse(data: bytes) -> dict:
    """Headers in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(out.get("content-length", "0"))
    if len(rest) < size:
        raise ValueError("a block is shorter than its Content-Length")
    return out | {"block": rest[:size]}


def records_of(file, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records whose first byte lies in [begin, end)."""
    source, at = Range(file, begin), begin
    while at < end:
        place = source.data.find(MAGIC, at - source.begin)
        if place < 0:
            at = max(at, source.begin + len(source.data) - len(MAGIC) + 1)
            source.drop(min(at, source.begin + len(source.data)))
            if not source.more():
                return
            continue
        at = source.begin + place
        if at >= end:
            return
        while source.begin + len(source.data) - at < 4096 and source.more():
            pass
        if not head_of(source.data[at - source.begin : at - source.begin + 4096]):
            at += 1
            continue
        data, after = member(source, at)
        yield at, parse(data)
        source.drop(after)
        at = after


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """A row per record of the archives (path, bytes): path, start, record_type, record_id, uri, refers_to, payload_digest, payload_bytes, payload.

    A revisit has no payload; its payload_bytes is the length that its HTTP header states.
    """
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("begin"))
    ranges = ranges.withColumn("end", F.least(F.col("begin") + range_bytes, F.col("bytes")))
    dealt = ranges.repartition(max(1, min(100_000, int(archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1))), "path", "begin")

    def run(batches):
        for batch in batches:
            for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                target, place = filesystem(path)
                rows: list[tuple] = []
                with target.open_input_file(place) as file:
                    for start, r in records_of(file, begin, end):
                        http, _, body = r["block"].partition(b"\r\n\r\n")
                        stated = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        revisit = r["warc-type"] == "revisit"
                        rows.append(
                            (
                                path,
                                start,
                                r["warc-type"],
                                r["warc-record-id"].strip("<>"),
                                r.get("warc-target-uri"),
                                r["warc-refers-to"].strip("<>") if "warc-refers-to" in r else None,
                                r.get("warc-payload-digest", "").removeprefix("sha1:"),
                                int(stated[1]) if revisit and stated else len(body),
                                None if revisit else body,
                            )
                        )
                        if len(rows[-1][-1] or b"") > BLOCK or len(rows) >= 200:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return map_arrow(dealt, ["path", "begin", "end"], run, SCHEMA, without=["begin", "end", "path"])


SCHEMA = "path string, start long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])
