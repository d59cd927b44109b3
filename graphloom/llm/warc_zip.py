"""WARC records in ZIP packages, read by ranges without extraction.

Writing: each task packs its pages into archives of bounded size. An archive is a ZIP whose members are
stored: ``archive/data.warc.gz`` with one gzip stream per record, and ``indexes/index.cdx`` with a line of
place and length for each record. Reading: the end of the file leads to the (ZIP64) directory, the
directory to the members, the index to the records; each step reads its byte range only.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import checkpoint_root, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: An archive is closed at the first record beyond this size.
ARCHIVE_BYTES = 64 << 20
#: Equal payloads of this size are stored once.
REVISIT_BYTES = 1000
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS_DDL = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, record_offset long, record_length long"
)


class Member(NamedTuple):
    name: str
    offset: int
    size: int


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def header_value(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) holds the response's headers without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Target-URI: {header_value(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(text: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in text.decode("utf-8").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in rows}


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page id, payload bytes, digest, type, refers to, payload or None) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    digest = warc["warc-payload-digest"].partition(":")[2]
    page = record_page(warc["warc-record-id"])
    if warc["warc-type"] == "revisit":
        return page, size, digest, "revisit", record_page(warc["warc-refers-to"]), None
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record of page {page}")
    return page, size, digest, "response", None, payload


def _local_header(name: bytes, crc: int, size: int, zip64: bool) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
    short = LIMIT32 if zip64 else size
    return struct.pack("<4s5H3L2H", b"PK\3\4", 45 if zip64 else 20, 0, 0, 0, 33, crc, short, short, len(name), len(extra)) + name + extra


def write_zip(out, members: list[tuple[str, list[bytes]]], zip64: bool = False) -> None:
    """Write stored members; ZIP64 fields where a number needs them, or everywhere on request."""
    position, entries = 0, []
    for name, parts in members:
        crc = size = 0
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
        wide = zip64 or size >= LIMIT32
        head = _local_header(name.encode(), crc, size, wide)
        entries.append((name.encode(), crc, size, position))
        out.write(head)
        for part in parts:
            out.write(part)
        position += len(head) + size
    directory = position
    for name, crc, size, at in entries:
        wide = zip64 or size >= LIMIT32 or at >= LIMIT32
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        a, b = (LIMIT32, LIMIT32) if wide else (size, at)
        entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if wide else 20, 0, 0, 0, 33, crc, a, a, len(name), len(extra), 0, 0, 0, 0, b)
        out.write(entry + name + extra)
        position += len(entry) + len(name) + len(extra)
    length = position - directory
    if zip64 or directory >= LIMIT32 or len(entries) >= LIMIT16:
        n = len(entries)
        out.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, directory))
        out.write(struct.pack("<4sLQL", b"PK\6\7", 0, position, 1))
        out.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, LIMIT16, LIMIT16, LIMIT32, LIMIT32, 0))
    else:
        out.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(entries), len(entries), length, directory, 0))


def read_members(file, size: int) -> dict[str, Member]:
    """Stored members of a ZIP from its directory. ``file`` has ``read_at(length, offset)``."""
    tail_at = max(0, size - (LIMIT16 + 22))
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    # the same bytes in a comment are no end: a comment's length must lead to the end of the file
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<H2L", tail, end + 10)
    if LIMIT16 == count or LIMIT32 in (length, start):
        sign, _, at, _ = struct.unpack("<4sLQL", file.read_at(20, tail_at + end - 20))
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        _, count, length, start = struct.unpack_from("<4Q", file.read_at(56, at), 24)
    directory = file.read_at(length, start)
    out, p = {}, 0
    for _ in range(count):
        sign, method, packed, size_, n, e, c, at = struct.unpack_from("<4s6xH8x2L3H8xL", directory, p)
        if sign != b"PK\1\2":
            raise ValueError("damaged ZIP directory")
        name = directory[p + 46 : p + 46 + n].decode()
        extra = directory[p + 46 + n : p + 46 + n + e]
        q = 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<2H", extra, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                size_ = next(wide) if size_ == LIMIT32 else size_
                packed = next(wide) if packed == LIMIT32 else packed
                at = next(wide) if at == LIMIT32 else at
            q += 4 + width
        if method == 0 and packed == size_:
            # the local header may have other extra fields than the directory
            n_local, e_local = struct.unpack_from("<2H", file.read_at(30, at), 26)
            out[name] = Member(name, at + 30 + n_local + e_local, size_)
        p += 46 + n + e + c
    return out


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, payload) with their digest and, for a revisit, the page it refers to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    shared = (
        pages.select(F.col("page_id").cast("long"), payload.alias("payload"))
        .where(large)
        .groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND kept IS NOT NULL")
    )
    return (
        hashed.join(stage(shared.select("digest", "kept")).df, "digest", "left")
        .select("page_id", "url", "payload", "digest", F.when(large & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives under ``folder``; a staged table of those that count: (archive, bytes, records).

    Names are new in each attempt of a task. An archive counts once its task's row is committed, so
    those of lost or repeated tasks are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        parts: list[bytes] = []
        index: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{base}/{name}") as out:
                write_zip(out, [(DATA, parts), (INDEX, ["".join(index).encode()])])
            done = pa.RecordBatch.from_pydict(
                {"archive": [f"{folder}/{name}"], "bytes": [store.get_file_info(f"{base}/{name}").size], "records": [len(parts)]}
            )
            parts.clear()
            index.clear()
            return done

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c for c in batch.columns), strict=True):
                raw = warc_record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                packed = gzip.compress(raw, 3, mtime=0)
                index.append(f"{size} {len(packed)}\n")
                parts.append(packed)
                size += len(packed)
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if parts:
            yield close()

    return stage(pages.mapInArrow(run, "archive string, bytes long, records long")).df


def locate_records(archives: DataFrame) -> DataFrame:
    """Place and length of every record, from the directories and indexes of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_fs(name)
                with store.open_input_file(path) as file:
                    members = read_members(file, size)
                    lines = file.read_at(members[INDEX].size, members[INDEX].offset).decode().splitlines()
                places = [tuple(map(int, line.split())) for line in lines]
                base = members[DATA].offset
                yield pa.RecordBatch.from_pydict(
                    {
                        "archive": [name] * len(places),
                        "record_offset": [base + a for a, _ in places],
                        "record_length": [n for _, n in places],
                    }
                )

    return archives.select("archive", "bytes").mapInArrow(run, "archive string, record_offset long, record_length long")


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """Range-read records and check their payloads; with ``payloads`` each response's is returned too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, file, opened = [], None, None
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    if file:
                        file.close()
                    store, path = open_fs(name)
                    file, opened = store.open_input_file(path), name
                page, size, digest, kind, refers, payload = parse_record(gzip.decompress(file.read_at(n, at)))
                rows.append((page, size, digest, kind, refers, name, at, n) + ((payload,) if payloads else ()))
            if file:
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("archive", pa.string()),
            ("record_offset", pa.int64()),
            ("record_length", pa.int64()),
        ]
        + ([("payload", pa.binary())] if payloads else [])
    )
    return places.select("archive", "record_offset", "record_length").mapInArrow(
        run, RECORDS_DDL + (", payload binary" if payloads else "")
    )


def archive_round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write (page_id, url, html) to archives and read every record back.

    A null html is an empty payload, a null url an empty one. Of equal payloads of 1000 bytes or more the
    rows with the largest page_id are responses (all of them, where a row is repeated) and the others revisits;
    rows without a page_id refer to it too. An empty table gives no rows; other columns are not carried.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write_archives(with_revisits(pages), folder)
    places = stage(locate_records(archives)).df
    # neighbours in a file go to one task, as many tasks as the shuffle has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = places.repartitionByRange(parts, "archive", "record_offset").sortWithinPartitions("archive", "record_offset")
    return read_records(spread, payloads)
