r"""Legacy ARC archives, and their conversion to WARC 1.1.

An ARC file begins with a ``filedesc:`` record whose block names the version (1 or 2) and the fields of the header
lines that follow. A header line is read from the right, because a URL may hold blanks, and its last field declares the
length of the block. The converter splits HTTP responses into head and payload and makes up what WARC asks for: record
ids from archive name and offset, ISO timestamps from (possibly shortened) 14-digit dates, types from scheme and block,
and SHA-1 digests of block and payload. A payload seen before becomes a ``revisit`` of the record with the smallest key.

Both kinds of files are written by Spark's text writer, one gzip member for each record. The last byte of a member is the
highest byte of its length, which is zero below 16 MiB; that zero is the writer's line separator. A longer record is
followed by an empty member, which ends in zero as well. So the files are plain record-compressed archives, and any
reader of the format opens them. A file is as large as its partition of the input.

Defined cases: a null payload is empty; a null URL is written as ``unknown:``; null keys come last when the response is
chosen and ties go to the first place in the archives; repeated rows are records of their own; an empty table gives no
files and no rows. Damage never stops a file: a header line that cannot be read is skipped up to the next that can, a
corrupt or cut member up to the next gzip opening, a WARC record without a head or whole block up to the next line that
opens one, and a version block that cannot be read leaves the fields as they were. ``damaged_lines`` and ``damaged_warc``
give one row for each, with its place; bytes skipped to reach the next record belong to the row before.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import new_path, stage, table

#: Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The key of a page in an HTTP head and in a WARC head.
KEY_FIELD, REFERS_FIELD = "X-Page-Id", "X-Refers-To-Page-Id"
#: Date of all records that the query writes; the pages carry none.
CRAWL_DATE = "20200101000000"
SMALL = 1 << 24
#: Bytes of an archive that are unpacked at once.
READ = 1 << 14
#: Fixed value of the format: the opening of a deflated gzip member.
GZIP = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()

ARC_SCHEMA = "archive string, offset long, version int, url string, ip string, date string, mime string, damaged boolean, block binary"
HEAD_SCHEMA = "archive string, offset long, url string, ip string, date string, mime string, key long, digest string, size long"
WARC_SCHEMA = "archive string, offset long, type string, id string, url string, date string, key long, refers_key long, digest string, size long, intact boolean"


def member(record: bytes) -> bytes:
    """A gzip member for the text writer: without the last zero, which the writer adds."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    return (data if len(record) < SMALL else data + EMPTY_MEMBER)[:-1]


def members(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """Place and content of each gzip member; None for one that is corrupt or cut, after which the next gzip opening is tried."""
    at, view = 0, memoryview(data)
    while at < len(data):
        opener, parts, upto = zlib.decompressobj(31), [], at
        try:
            while not opener.eof and upto < len(data):
                parts.append(opener.decompress(view[upto:upto + READ]))
                upto += READ
        except zlib.error:
            parts = []
        if opener.eof:
            if any(parts):
                yield at, b"".join(parts)
            at = min(upto, len(data)) - len(opener.unused_data)
            continue
        # A chance opening inside packed bytes fails as well and is part of the same damage.
        bad, at = at, data.find(GZIP, at + 1)
        while at >= 0 and not _opens_member(view, at):
            at = data.find(GZIP, at + 1)
        yield bad, None
        if at < 0:
            return


def _opens_member(view: memoryview, at: int) -> bool:
    """Whether the bytes from here on unpack: the whole member, or all of it that fits in one read."""
    opener = zlib.decompressobj(31)
    try:
        return bool(opener.decompress(view[at:at + READ])) or opener.eof
    except zlib.error:
        return False


def write_members(records: DataFrame, path: str) -> None:
    """Write a column ``member`` as ``*.gz``-style files of gzip members."""
    records.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, name: str, offset: int = 0) -> bytes:
    """A header line; blanks in the URL are escaped."""
    more = ["200", "-", "-", str(offset), name] if version == 2 else []
    return (" ".join([re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url), ip, date, mime, *more, str(length)]) + "\n").encode()


def arc_opening(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 crawl\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), name) + block


def http_block(payload: bytes, key: int | None, mime: str) -> bytes:
    own = "" if key is None else f"{KEY_FIELD}: {key}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def _arc_members(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, opened = 1 + part % 2, f"pages-{part:05d}.arc.gz", False
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                out = [] if opened else [member(arc_opening(version, name, date))]
                opened = True
                for url, key, payload in zip(*(rows.column(c).to_pylist() for c in ("url", "key", "payload"))):
                    block = http_block(payload or b"", key, "text/html")
                    out.append(member(arc_header(version, url or "unknown:", "0.0.0.0", date, "text/html", len(block), name) + block + b"\n"))
                yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})

    return run


def write_arc(pages: DataFrame, path: str, date: str = CRAWL_DATE) -> None:
    """One ARC file for each partition of ``pages`` (url, key, payload); even partitions use version 1, odd ones 2."""
    write_members(pages.select("url", F.col("key").cast("long"), F.col("payload").cast("binary")).mapInArrow(_arc_members(date), "member binary"), path)


def _version_block(block: bytes) -> tuple[int, list[str]] | None:
    """Version and field names of the block of a ``filedesc:`` record; None if it does not name them."""
    lines = block.decode("utf-8", "replace").split("\n")
    number, names = lines[0].split(" ")[0], lines[1].split() if len(lines) > 1 else []
    if not re.fullmatch(r"[0-9]{1,9}", number) or not set(ARC_FIELDS[1]) <= set(names) or names[-1] != ARC_FIELDS[1][-1]:
        return None
    return int(number), names


def parse_arc(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """Offset, version, header fields, block and damage of each record of one ARC file, packed or not."""
    version, fields = 1, ARC_FIELDS[1]
    for at, data in members(content) if content[:2] == GZIP[:2] else [(0, content)]:
        if data is None:
            yield at, version, {}, b"", True
            continue
        place = 0
        while place < len(data):
            line_end = data.find(b"\n", place)
            if line_end < 0:
                line_end = len(data)
            line = data[place:line_end]
            if not line.strip():
                place = line_end + 1
                continue
            text = line.decode("utf-8", "replace").rstrip("\r")
            count = len(fields) if not text.startswith("filedesc:") else len(text.split(" "))
            parts = text.rsplit(" ", count - 1)
            if len(parts) != count or count < 5 or not re.fullmatch(r"\d+", parts[-1]) or line_end + 1 + int(parts[-1]) > len(data):
                yield at + place, version, {}, line, True
                place = line_end + 1
                continue
            block = data[line_end + 1:line_end + 1 + int(parts[-1])]
            if text.startswith("filedesc:"):
                named = _version_block(block)
                if named:
                    version, fields = named
                else:
                    yield at + place, version, {}, line, True
            else:
                yield at + place, version, dict(zip(fields, parts)), block, False
            place = line_end + 1 + len(block)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def iso_date(date: str) -> str:
    """A WARC timestamp from the digits that a legacy date has; missing parts are the first of their kind."""
    digits = re.sub(r"\D", "", date)[:14]
    d = digits + "00000101000000"[len(digits):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[:at + 4], block[at + 4:])


def field_of(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def _number(text: str | None) -> int | None:
    """A field that holds a whole number of 64 bits; anything else is null."""
    found = int(text) if text and re.fullmatch(r"[+-]?[0-9]{1,19}", text.strip()) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def _arc_rows(full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parsed heads; ``full`` adds the packed block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for offset, _, fields, block, damaged in parse_arc(content.as_buffer().to_pybytes()):
                    if damaged:
                        continue
                    head, payload = split_block(block)
                    key = field_of(head, KEY_FIELD)
                    rows.append({
                        "archive": _name(path), "offset": offset, "url": fields["URL"], "ip": fields["IP-address"], "date": fields["Archive-date"], "mime": fields["Content-type"],
                        "key": _number(key), "digest": sha1_base32(payload), "size": len(payload), **({"block": zlib.compress(block, 6)} if full else {})})
                    if len(rows) == 500:
                        yield _batch(rows, full)
                        rows = []
                yield _batch(rows, full)

    return run


_HEAD_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("key", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])


def _batch(rows: list[dict], full: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_HEAD_ARROW.append(pa.field("block", pa.binary())) if full else _HEAD_ARROW)


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = [{"archive": _name(path), "offset": o, "line": b} for o, _, _, b, bad in parse_arc(content.as_buffer().to_pybytes()) if bad]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("line", pa.binary())]))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, full: bool = True) -> DataFrame:
    """The readable records of all ARC files in a folder; ``block`` is deflated."""
    return _files(spark, path).mapInArrow(_arc_rows(full), HEAD_SCHEMA + (", block binary" if full else ""))


def damaged_lines(spark: SparkSession, path: str) -> DataFrame:
    """What could not be read: archive, offset and header line (empty for a corrupt member), a row for each."""
    return _files(spark, path).mapInArrow(_damage, "archive string, offset long, line binary")


def _warc_damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = [{"archive": _name(path), "offset": o, "head": h} for o, h, b in parse_warc(content.as_buffer().to_pybytes()) if b is None]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("head", pa.binary())]))


def damaged_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records without a readable head, length or whole block, and corrupt members: archive, offset, head."""
    return _files(spark, path).mapInArrow(_warc_damage, "archive string, offset long, head binary")


def warc_type(url: str, head: bytes) -> tuple[str, str]:
    """Record type and content type that an ARC record gets."""
    if head:
        return "response", "application/http; msgtype=response"
    return "resource", "text/dns" if url.startswith("dns:") else ""


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v not in (None, ""))
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _warc_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, opened = f"pages-{TaskContext.get().partitionId():05d}.warc.gz", False
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            out = []
            if not opened:
                about = b"format: WARC File Format 1.1\r\nsoftware: ARC conversion\r\n"
                out.append(member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", iso_date(CRAWL_DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], about)))
                opened = True
            for r in batch.slice(first, 500).to_pylist():
                block = zlib.decompress(r["block"])
                head, payload = split_block(block)
                kind, content = warc_type(r["url"], head)
                again = r["refers_archive"] is not None
                if again:
                    block = head
                fields = [
                    ("WARC-Type", "revisit" if again else kind), ("WARC-Record-ID", record_id(r["archive"], r["offset"])), ("WARC-Date", iso_date(r["date"])), ("WARC-Target-URI", r["url"]),
                    ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", content or r["mime"]), (KEY_FIELD, r["key"])]
                if again:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["refers_archive"], r["refers_offset"])), ("WARC-Refers-To-Target-URI", r["refers_url"]), ("WARC-Refers-To-Date", iso_date(r["refers_date"])), (REFERS_FIELD, r["refers_key"])]
                out.append(member(warc_record(fields, block)))
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Convert all ARC files of a folder. Payloads of at least ``least`` bytes that occur again become revisits.

    Which record answers for a payload is settled on heads alone; blocks move once, packed, to meet their decision.
    """
    heads = stage(read_arc(spark, arc_path, full=False), "arc-heads")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "archive", "offset", "url", "date")
    first = heads.where(F.col("size") >= least).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min(place).alias("to"), F.count("*").alias("n")).where("n > 1")
    again = heads.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))).where((F.col("archive") != F.col("to.archive")) | (F.col("offset") != F.col("to.offset")))
    again = again.select(F.col("archive").alias("a"), F.col("offset").alias("o"), *[F.col(f"to.{c}").alias(f"refers_{c}") for c in ("archive", "offset", "url", "date", "key")])
    rows = read_arc(spark, arc_path).join(again, (F.col("archive") == F.col("a")) & (F.col("offset") == F.col("o")), "left").drop("a", "o")
    write_members(rows.mapInArrow(_warc_members, "member binary"), warc_path)


def parse_warc(content: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Offset, head and block of each record of one WARC file, packed or not; a damaged record has no block."""
    for at, data in members(content) if content[:2] == GZIP[:2] else [(0, content)]:
        if data is None:
            yield at, b"", None
            continue
        place = 0
        while place < len(data):
            head_end = data.find(b"\r\n\r\n", place)
            head = data[place:head_end + 2] if data.startswith(b"WARC/", place) and head_end >= 0 else b""
            size = field_of(head, "Content-Length") or ""
            last = head_end + 4 + int(size) if re.fullmatch(r"[0-9]{1,18}", size) else len(data) + 1
            if last <= len(data):
                yield at + place, head, data[head_end + 4:last]
                place = last
                while data.startswith(b"\r\n", place):
                    place += 2
                continue
            yield at + place, head, None
            place = data.find(b"\nWARC/", place) + 1 or len(data)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("refers_key", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("intact", pa.bool_())])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for offset, head, block in parse_warc(content.as_buffer().to_pybytes()):
                kind = field_of(head, "WARC-Type")
                if kind == "warcinfo" or block is None:
                    continue
                http, payload = split_block(block)
                digest = (field_of(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                size = _number(field_of(http, "Content-Length")) or 0 if kind == "revisit" else len(payload)
                key, refers = field_of(head, KEY_FIELD), field_of(head, REFERS_FIELD)
                intact = field_of(head, "WARC-Block-Digest") == f"sha1:{sha1_base32(block)}" and (kind == "revisit" or digest == sha1_base32(payload))
                rows.append((_name(path), offset, kind, field_of(head, "WARC-Record-ID"), field_of(head, "WARC-Target-URI"), field_of(head, "WARC-Date"), _number(key), _number(refers), digest, size, intact))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record but the files' own; ``size`` and ``digest`` are the full payload's, ``intact`` checks the digests."""
    return _files(spark, path).mapInArrow(_warc_rows, WARC_SCHEMA)


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("url", F.col("page_id").alias("key"), F.col("html").cast("binary").alias("payload"))
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS digest,
    min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""
