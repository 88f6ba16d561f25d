"""WARC archives inside ZIP files: written whole, read by ranges without extraction.

An archive is a ZIP file of two stored members: ``archive/data.warc.gz``, one gzip member a record,
and ``indexes/index.cdxj``, a line a record with its offset and length in the former. The reader
parses the end record, the ZIP64 records where sizes call for them and the central directory, finds
where each stored member's bytes begin, reads the index, and then only the ranges of the records it
is asked for. ZIP members that are compressed or encrypted have no ranges and are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored, work_folder

#: Payloads below this many bytes are always stored in full.
LEAST_REVISIT = 1000
#: An archive is closed and the next begun beyond this many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: Records that one row of the manifest stands for.
SLICE = 4000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "path string, first long, records long"
_RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


# --- the ZIP directory ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int
    header: int  # where its local header begins


def zip_members(file, size: int) -> dict[str, Member]:
    """The central directory of a ZIP file that can seek and read; ``size`` is its length."""
    tail = min(size, 22 + 0xFFFF + 20)
    file.seek(size - tail)
    end = file.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(end):
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    # a ZIP64 locator right before the end record points to records with 64-bit numbers
    if at >= 20 and end[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", end, at - 12)
        file.seek(where)
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    file.seek(start)
    directory = file.read(length)
    members, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        raw = directory[at + 46 : at + 46 + n]
        extra = directory[at + 46 + n : at + 46 + n + m]
        packed, header = _wide_fields(extra, plain, packed, header)
        name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        members[name] = Member(name, method, flags, packed, header)
        at += 46 + n + m + k
    return members


def _wide_fields(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
    """Packed size and header offset, from the ZIP64 extra field where theirs are all ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            if plain == 0xFFFFFFFF:
                next(wide)
            packed = next(wide) if packed == 0xFFFFFFFF else packed
            header = next(wide) if header == 0xFFFFFFFF else header
            break
        at += 4 + length
    return packed, header


def stored_range(file, member: Member) -> tuple[int, int]:
    """Where a stored member's bytes begin in the ZIP file, and how many there are."""
    if member.method != 0 or member.flags & 1:
        raise ValueError(f"{member.name} is compressed or encrypted; it has no ranges")
    file.seek(member.header)
    local = file.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n, m = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n + m, member.size


# --- records -------------------------------------------------------------------------------------


def _plain(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page: int | None, row: str) -> str:
    return f"<urn:row:{row}>" if page is None else f"<urn:page:{page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool, row: str) -> bytes:
    """One gzip member that holds one WARC record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page, row)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip()
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its block")
    return headers, rest[:length]


class ArchiveWriter:
    """One ZIP file with its records and their index."""

    def __init__(self, path: str):
        from brokerlake.llm.files import create

        self.path, self.lines, self.bytes = path, [], 0
        self.stream = create(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, url: str | None, packed: bytes) -> None:
        place = json.dumps({"offset": self.bytes, "length": len(packed)})
        self.lines.append(f"{_plain(url or '-').replace(' ', '%20')} {DATE} {place}")
        self.data.write(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("\n".join(sorted(self.lines)).encode("utf-8", "replace"))
        self.zip.close()
        self.stream.close()


class ArchiveReader:
    """Range reads of a packaged archive."""

    def __init__(self, path: str):
        from brokerlake.llm.files import open_random

        self.file = open_random(path)
        members = zip_members(self.file, self.file.size())
        self.start, self.length = stored_range(self.file, members[DATA])
        at, size = stored_range(self.file, members[INDEX])
        self.file.seek(at)
        lines = self.file.read(size).decode("utf-8").split("\n")
        self.places = [json.loads(line.split(" ", 2)[2]) for line in lines if line]

    def records(self, first: int, count: int) -> Iterator[tuple[dict[str, str], bytes]]:
        for place in sorted(self.places[first : first + count], key=lambda p: p["offset"]):
            if place["offset"] + place["length"] > self.length:
                raise ValueError("the index points beyond the archive member")
            self.file.seek(self.start + place["offset"])
            yield parse_record(self.file.read(place["length"]))

    def close(self) -> None:
        self.file.close()


# --- tables --------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None,
                   least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); return the manifest.

    Of rows with equal payloads of at least ``least_revisit`` bytes those with the largest page_id
    are responses and all others revisits of it; rows with smaller payloads, and rows whose equals
    all lack a page_id, are responses. A NULL html is an empty payload; a NULL url has no target
    header; repeated rows are records of their own. Other columns are ignored.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or work_folder(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1("html"))
    # only payloads that occur twice; a digest of all pages is reduced before the shuffle
    repeated = stored(
        rows.where(F.octet_length("html") >= least_revisit).groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("_n"))
        .where("_n > 1 and original is not null").select("digest", "original"),
        "repeated",
    )
    known = rows.join(repeated.withColumnRenamed("digest", "_digest"),
                      F.col("digest") == F.col("_digest"), "left")
    typed = known.select("page_id", "url", "html", "digest", "original")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        writer, found = None, []

        def close() -> None:
            writer.close()
            total = len(writer.lines)
            found.extend((writer.path, k, min(SLICE, total - k)) for k in range(0, total, SLICE))

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in batch.schema.names)
            for page, url, html, digest, original in zip(*columns):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                revisit = original is not None and page != original
                payload = html.encode("utf-8", "replace")
                writer.add(url, record(page, url, payload, digest, original, revisit, uuid.uuid4().hex))
                if writer.bytes >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*found)], names=["path", "first", "records"]
            )

    return stored(typed.mapInArrow(write, _MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records behind a manifest; a response's size and digest come from its payload itself."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [part.split()[0] for part in _RECORDS.split(", ")]
        for batch in batches:
            for part in batch.to_pylist():
                reader = ArchiveReader(part["path"])
                rows = [_row(*one) for one in reader.records(part["first"], part["records"])]
                reader.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
                )

    prepare(manifest.sparkSession)
    spread = manifest.repartition(max(1, manifest.count()), "path", "first")
    return spread.mapInArrow(read, _RECORDS)


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page = headers["warc-type"], _number(headers["warc-record-id"])
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        return page, int(said[1]), digest, kind, _number(headers["warc-refers-to"])
    return page, len(payload), hashlib.sha1(payload).hexdigest(), kind, None


#: The same records as DuckDB SQL over ``pages``.
RECORDS_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT}
    THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS DISTINCT FROM page_id AND original IS NOT NULL
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM o
"""
