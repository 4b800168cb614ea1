"""WARC records in ZIP-packaged archives: written once, and read by ranges without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdx``, one line of offset, length and type for each. The reader fetches the end of the file, finds the (ZIP64) central directory, from it the
two members, reads the index, and then only the byte ranges of records.
"""

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from querymill.session import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
LEAST_SHARED = 100  # bytes from which equal payloads are stored once
ARCHIVE_BYTES = 256 << 20  # an archive is closed beyond this
READ_BYTES = 1 << 20  # neighbouring records are fetched together up to this
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def mark_revisits(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, html and any others) with digest and first: the page whose record holds the payload, if that is another.

    Of equal payloads of at least LEAST_SHARED bytes the smallest page_id keeps its own; rows that repeat that id with that payload
    do so too. Rows without an id refer to it as well; if none has an id, all keep theirs. A null html is empty.
    """
    html = F.coalesce("html", F.lit(""))
    marked = pages.withColumn("digest", F.sha2(html, 256))
    large = marked.where(F.octet_length(html) >= LEAST_SHARED)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    shared = scratch.cut(shared.drop("copies"))  # a plain table, so that a payload of very many pages can be split
    return marked.join(shared, "digest", "left").withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def _line(value: str) -> str:
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record, compressed; ``first`` makes it a revisit, which holds no payload but its length and digest."""
    kind = "response" if first is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"] if first is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a shared path names, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records): the archives of ``pages`` (page_id, url, html, digest, first) below a folder that all tasks share.

    Each task streams its rows into archives of its own under fresh names. The rows returned name the archives of tasks
    that came to an end: keep them in a table; what a lost or repeated task wrote is in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(0, len(batch), 256) for row in batch.slice(i, 256).to_pylist())
        row = next(rows, None)
        system, root = _place(folder)
        if row is not None:
            system.create_dir(root)
        while row is not None:
            name, lines, at = f"{uuid.uuid4().hex}.zip", [], 0
            with system.open_output_stream(f"{root}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as member:
                    while row is not None and at < ARCHIVE_BYTES:
                        packed = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["first"])
                        member.write(packed)
                        lines.append(f"{at} {len(packed)} {'response' if row['first'] is None else 'revisit'}\n")
                        at += len(packed)
                        row = next(rows, None)
                archive.writestr(INDEX, "".join(lines))
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(lines)}])

    return pages.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "path string, records long")


class Member(NamedTuple):
    start: int
    size: int


def members(source) -> dict[str, Member]:
    """The stored members of an open archive, by name. Compressed ones cannot be read by ranges and are left out."""
    size = source.size()
    tail_at = max(0, size - 65_557 - 20)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10:end + 20])
    if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":  # ZIP64 locator
        source.seek(struct.unpack("<Q", tail[end - 12:end - 4])[0])
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, at = struct.unpack("<QQQ", wide[32:56])
    source.seek(at)
    directory, found, i = source.read(length), {}, 0
    for _ in range(count):
        method, = struct.unpack("<H", directory[i + 10:i + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[i + 20:i + 34])
        offset, = struct.unpack("<I", directory[i + 42:i + 46])
        name = directory[i + 46:i + 46 + n_name].decode()
        extra = directory[i + 46 + n_name:i + 46 + n_name + n_extra]
        full, packed, offset = _widened(extra, full, packed, offset)
        i += 46 + n_name + n_extra + n_comment
        if method == zipfile.ZIP_STORED:
            source.seek(offset)
            local = source.read(30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no member where the directory has {name}")
            skip, more = struct.unpack("<HH", local[26:30])
            found[name] = Member(offset + 30 + skip + more, packed)
    return found


def _widened(extra: bytes, *values: int) -> Iterator[int]:
    """Values that do not fit 32 bits are in the ZIP64 field, in order."""
    wide, i = b"", 0
    while i + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[i:i + 4])
        if kind == 1:
            wide = extra[i + 4:i + 4 + n]
        i += 4 + n
    for value in values:
        if value == 0xFFFFFFFF:
            value, = struct.unpack("<Q", wide[:8])
            wide = wide[8:]
        yield value


def ranges(archives: DataFrame) -> DataFrame:
    """(path, start, length): where in its archive each record of the tables (path) lies, by the archive's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = _place(path)
                with system.open_input_file(inside) as source:
                    held = members(source)
                    source.seek(held[INDEX].start)
                    lines = source.read(held[INDEX].size).decode().splitlines()
                fields = [line.split(" ") for line in lines]
                starts = [held[DATA].start + int(f[0]) for f in fields]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(starts, pa.int64()), pa.array([int(f[1]) for f in fields], pa.int64())], names=["path", "start", "length"])

    return archives.select("path").mapInArrow(run, "path string, start long, length long")


RECORD = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(found: DataFrame) -> DataFrame:
    """The records in the byte ranges (path, start, length). payload is null for revisits. A payload that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _together(sorted(zip(*[c.to_pylist() for c in batch.columns]))):
                path, low, high = group[0][0], group[0][1], max(r[1] + r[2] for r in group)
                system, inside = _place(path)
                with system.open_input_file(inside) as source:
                    source.seek(low)
                    data = source.read(high - low)
                rows = [parse(zlib.decompress(data[s - low:s - low + n], 31)) for _, s, n in group]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return found.select("path", "start", "length").mapInArrow(run, RECORD)


ARROW = pa.schema([
    ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _together(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def parse(data: bytes) -> dict:
    """One record, uncompressed."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return {
        "page_id": number("WARC-Record-ID"), "target_uri": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"), "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload,
    }


def archive_and_read(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html and any others) to archives in the shared folder, and read all records back from them."""
    archives = scratch.cut(write(mark_revisits(scratch, pages.select("page_id", "url", "html")), scratch.path("archives")))
    spread = archives.repartition(max(1, archives.count()), "path")
    return read(ranges(spread))
