"""WARC records in ZIP archives: a writer, and a reader that fetches records by range.

An archive is a ZIP file with two stored members: records.warc.gz, one gzip stream a record, and
records.cdx, a line with offset and length for each.  The reader parses the central directory at the
archive's end (with its ZIP64 forms), finds where the stored members begin, reads the index,
and then only the byte ranges of the records; nothing is extracted.  A path is where Hadoop takes it to be, also
without a scheme; archives are then read and written through pyarrow's file systems, and a store that these do not know is an error
before anything is written.

A response's record id follows from its page and payload digest, so that revisits can name it without
knowing where it is written.  Payloads stay in their partitions: only digests and page ids are
shuffled, and what repeats comes back by a join.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import storage

RECORDS, INDEX = "records.warc.gz", "records.cdx"
#: Bytes that one range request asks for, unless a record is longer.
SPAN_BYTES = 4_000_000
#: The fixed time in all records: the table has none.
DATE = "2024-01-01T00:00:00Z"
_ENTRY = re.compile(rb"\d+ \d+")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class Member:
    """A stored member of an archive: where its bytes are."""

    name: str
    start: int
    size: int


#: Schemes that pyarrow has under another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(uri: str) -> str:
    """A path with a scheme, as Hadoop writes it, in pyarrow's way."""
    scheme, _, rest = uri.partition(":")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it of a path with a scheme."""
    try:
        return pa.fs.FileSystem.from_uri(arrow_uri(uri))
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives cannot be in {uri}: {error}") from error


class _Range:
    """A file that is read by ranges."""

    def __init__(self, path: str):
        files, name = store(path)
        self.file = files.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError(f"the archive ends before byte {start + length}")
        return self.file.read_at(length, start)


def members(archive: _Range) -> list[Member]:
    """The archive's members by its central directory; all must be stored."""
    tail_start = max(0, archive.size - 65_557)  # the end record and the longest comment
    tail = archive.read(tail_start, archive.size - tail_start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no ZIP directory at the end of the archive")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        signature, _, at = struct.unpack("<4sIQ", archive.read(tail_start + end - 20, 16))
        if signature != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator before the end record")
        signature, count, size, start = struct.unpack("<4s28xQQQ", archive.read(at, 56))
        if signature != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
    directory, at, out = archive.read(start, size), 0, []
    for _ in range(count):
        signature, flags, method = struct.unpack_from("<4s4xHH", directory, at)
        if signature != b"PK\x01\x02":
            raise ValueError("broken entry in the ZIP directory")
        packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        packed, plain, offset = _zip64(directory[at + 46 + name_size : at + 46 + name_size + extra_size], packed, plain, offset)
        if method != 0 or packed != plain or flags & 1:
            raise ValueError(f"member {name} is not stored")
        signature, name_size_here, extra_here = struct.unpack("<4s22xHH", archive.read(offset, 30))
        if signature != b"PK\x03\x04":
            raise ValueError(f"no header where member {name} should begin")
        out.append(Member(name, offset + 30 + name_size_here + extra_here, plain))
        at += 46 + name_size + extra_size + comment_size
    return out


def _zip64(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset, from the ZIP64 field where the entry has all ones for them."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            plain = next(values) if plain == 0xFFFFFFFF else plain
            packed = next(values) if packed == 0xFFFFFFFF else packed
            offset = next(values) if offset == 0xFFFFFFFF else offset
        at += 4 + size
    return packed, plain, offset


def record_ranges(archive: _Range) -> Iterator[tuple[int, int]]:
    """Start and length of all records, by the indexes of the archive.

    An index has the name of its member with the ending cdx, and offset and length in each line; without one of this form the member
    is walked through.
    """
    found = members(archive)
    by_name = {m.name: m for m in found}
    for m in found:
        if m.name.endswith((".warc.gz", ".warc")):
            index = by_name.get(re.sub(r"\.warc(\.gz)?$", ".cdx", m.name))
            if index is None:
                yield from _walk(archive, m)
                continue
            lines = archive.read(index.start, index.size).splitlines()
            if not all(_ENTRY.fullmatch(line) for line in lines):  # an index of another form
                yield from _walk(archive, m)
                continue
            for offset, length in (map(int, line.split()) for line in lines):
                if offset + length > m.size:
                    raise ValueError("the index points beyond its member")
                yield m.start + offset, length


def _walk_plain(archive: _Range, m: Member) -> Iterator[tuple[int, int]]:
    """Records that are not compressed, by the lengths in their heads."""
    at, end = m.start, m.start + m.size
    while at < end:
        size, head = 4096, b""
        while b"\r\n\r\n" not in head:
            if len(head) == end - at:
                raise ValueError(f"member {m.name} ends in the head of a record")
            head, size = archive.read(at, min(size, end - at)), size * 4
        found = re.search(rb"(?im)^content-length:\s*(\d+)", head.partition(b"\r\n\r\n")[0])
        if not found:
            raise ValueError(f"a record of member {m.name} has no length")
        length = head.index(b"\r\n\r\n") + 4 + int(found[1]) + 4
        yield at, min(length, end - at)
        at += length


def _walk(archive: _Range, m: Member) -> Iterator[tuple[int, int]]:
    if not m.name.endswith(".gz"):
        yield from _walk_plain(archive, m)
        return
    at, begin = m.start, m.start
    stream = zlib.decompressobj(31)
    while at < m.start + m.size:
        chunk = archive.read(at, min(1_000_000, m.start + m.size - at))
        at += len(chunk)
        while chunk:
            stream.decompress(chunk)
            if not stream.eof:
                break
            chunk = stream.unused_data
            yield begin, at - len(chunk) - begin
            begin, stream = at - len(chunk), zlib.decompressobj(31)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The id of a page's record; that of a response which others refer to has no place."""
    return f"<urn:page:{page_id}:{digest}{':' * bool(place)}{place}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, place: str = "") -> bytes:
    """One WARC record, not compressed; with refers_to, a record id, a revisit that has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", "sha1:" + digest),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)] if refers_to is not None else ()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


_PAGE = re.compile(r"<?urn:page:(None|-?\d+):")
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _page_of(record_id: str | None) -> int | None:
    """The page in a record id of this writer; ids of others name none."""
    found = _PAGE.match(record_id or "")
    return int(found[1]) if found and found[1] != "None" else None


def parse(raw: bytes) -> tuple | None:
    """The fields of a response or revisit, in the order of read(), or None for a record of another type.

    A response whose SHA-1 digest is wrong ends the job; one without any gets it here.  A revisit's payload is as long as its HTTP
    head says, if it does.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind, name = fields.get("warc-type", "").lower(), fields.get("warc-record-id")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "application/http").startswith("application/http") else (b"", b"", block)
    label, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    known = digest.upper() if label.lower() == "sha1" else None
    refers, size = None, len(payload)
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, payload, refers = int(found[1]) if found else None, None, fields.get("warc-refers-to")
    else:
        own = base32_sha1(payload)
        if known not in (None, own):
            raise ValueError(f"the payload of record {name} does not have its digest")
        known = own
    return name, kind, fields.get("warc-target-uri"), fields.get("warc-date"), size, known, refers, _page_of(name), _page_of(refers), payload


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One archive a partition.  Its name is new in every attempt, and only the attempt that counts returns it."""
        files = archive = None
        index, offset, part = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for r in (row for at in range(0, batch.num_rows, 100) for row in batch.slice(at, 100).to_pylist()):
                if archive is None:
                    files, path = store(folder)
                    files.create_dir(path, recursive=True)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.zip"
                    sink = files.open_output_stream(f"{path}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(RECORDS, "w", force_zip64=True)
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                refers_to = None if r["response"] else record_id(r["first"], digest)
                plain = record(r["page_id"], r["url"], r["html"].encode(), digest, refers_to, "" if r["referred"] else f"{part}-{len(index)}")
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = pack.compress(plain) + pack.flush()
                member.write(data)
                index.append(f"{offset} {len(data)}\n")
                offset += len(data)
        if archive is not None:
            member.close()
            archive.writestr(INDEX, "".join(index))
            archive.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(index)]})

    return run


#: Repeated pages that are broadcast at most; more of them are joined by a shuffle of the pages.
BROADCAST_ROWS, SALTS = 200_000, 16


def write(pages: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns path and records of each archive.

    Of rows with equal payloads of at least least_bytes bytes, that with the largest page_id is a
    response and the others revisit it; all smaller ones are responses.  A null html is an empty
    payload.  A null page_id counts as smaller than all others.  Of repeated rows that have the largest
    page_id, one is the response.  Further columns are ignored and an empty table writes nothing.
    """
    folder = storage.qualified(pages.sparkSession, folder)
    store(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # Digests that several rows have, with the page that is their response.
    keys = storage.materialise(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("copies")), "digests")
    firsts = keys.groupBy("digest").agg(F.max("page_id").alias("first"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    repeated = storage.materialise(salted.join(firsts.select("*", every), ["digest", "salt"]).select("digest", "page_id", "first", "copies"), "repeated")
    known = repeated.select(F.col("digest").alias("its_digest"), F.col("page_id").alias("its_page"), "first", "copies", F.lit(True).alias("several"))
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(known) if few else known, (F.col("digest") == F.col("its_digest")) & F.col("page_id").eqNullSafe(F.col("its_page")), "left")
    joined = joined.withColumns({"several": F.coalesce("several", F.lit(False)), "leads": F.col("page_id").eqNullSafe(F.col("first"))})
    columns = ["page_id", "url", "html", "digest", "first", (~F.col("several") | F.col("leads")).alias("response"), (F.col("several") & F.col("leads")).alias("referred")]
    if repeated.where((F.col("copies") > 1) & F.col("page_id").eqNullSafe(F.col("first"))).isEmpty():
        written = joined.select(*columns)
    else:  # rows that repeat both page and payload of a response need an order among them
        twice = F.col("several") & F.col("leads") & (F.col("copies") > 1)
        ordered = joined.where(twice).withColumn("leads", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) == 1)
        written = joined.where(~twice).select(*columns).unionByName(ordered.select(*columns))
    return storage.materialise(written.mapInArrow(_write(folder), "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The responses and revisits of all archives (path), of this writer and of others.

    Returns record_id, record_type, target_uri, date, payload_bytes, payload_digest (base32 SHA-1), refers_to_id, payload (null
    for a revisit), and page_id and refers_to, the pages that this writer's ids name.  Records of other types are passed over.
    Directories are read where their rows are; what the ranges hold is dealt out over all tasks.
    A broken archive, or a payload with a wrong digest, ends the job.  A path without scheme is in Hadoop's default store.
    """
    default = storage.qualified(archives.sparkSession, "/").rstrip("/")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            out: list[tuple[str, int, list[int]]] = []
            end = held = 0
            path = path if ":" in path.split("/")[0] else default + path
            for at, length in record_ranges(_Range(path)):
                if not out or at != end or held >= SPAN_BYTES:
                    out.append((path, at, []))
                    held = 0
                out[-1][2].append(length)
                end, held = at + length, held + length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["path", "start", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (row for b in batches for row in b.to_pylist()):
            data, at, out = _Range(r["path"]).read(r["start"], sum(r["lengths"])), 0, []
            for length in r["lengths"]:
                raw = data[at : at + length]
                if found := parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw):
                    out.append(found)
                at += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    listed = archives.select("path").repartition("path").mapInArrow(spans, "path string, start long, lengths array<long>")
    return listed.repartition("path", "start").mapInArrow(fetch, "record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to_id string, page_id long, refers_to long, payload binary")
