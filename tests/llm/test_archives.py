"""Archives written, converted and read back, and legacy headers read by hand."""

import base64
import gzip
import hashlib
import io
import pathlib

import pytest

from skyledger.llm import archives
from skyledger.llm.common import new_path


def pages(spark, rows):
    return spark.createDataFrame([(k, u, None if p is None else bytearray(p)) for k, u, p in rows], "key long, url string, payload binary")


ROWS = [
    (7, "http://a.example/x y", b"same"), (3, "http://b.example/", b"same"), (9, None, b"same"), (4, "http://c.example/", None), (5, "http://d.example/", b""),
    (6, "dns:e.example", "Ärger\r\n\r\n\0".encode()), (None, "http://f.example/", b"alone"), (None, "http://f.example/", b"alone"), (8, "http://g.example/", bytes(range(256)) * 80_000),
]


@pytest.fixture(scope="module")
def folders(spark):
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    archives.write_arc(pages(spark, ROWS).repartition(3), arc)
    archives.convert(spark, arc, warc)
    return arc, warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload or b"").digest()).decode()


def test_round_trip(spark, folders):
    rows = archives.read_warc(spark, folders[1]).collect()
    assert all(r["intact"] for r in rows) and len({r["id"] for r in rows}) == len(rows)
    got = sorted((r["key"] or 0, r["size"], r["digest"], r["type"], r["refers_key"]) for r in rows)
    first = {}
    for key, _, payload in ROWS:
        if key is not None:
            first[payload or b""] = min(key, first.get(payload or b"", key))
    want = []
    alone = ["response", "revisit"]
    for key, _, payload in ROWS:
        kind = alone.pop() if key is None else "response" if first[payload or b""] == key else "revisit"
        want.append((key or 0, len(payload or b""), digest(payload), kind, first[payload or b""] if key is not None and kind == "revisit" else None))
    assert got == sorted(want, key=lambda r: (r[:4], r[4] or 0))


def test_files_are_plain_gzip_archives(folders):
    for folder, opening in ((folders[0], b"filedesc://"), (folders[1], b"WARC/1.1\r\nWARC-Type: warcinfo")):
        files = list(pathlib.Path(folder.removeprefix("file:")).glob("part-*"))
        assert files
        for file in files:
            assert gzip.GzipFile(fileobj=io.BytesIO(file.read_bytes())).read().startswith(opening)


def test_smallest_size_and_payloads(spark, folders):
    warc = new_path(spark, "warc")
    archives.convert(spark, folders[0], warc, least=5)
    assert {r["key"] for r in archives.read_warc(spark, warc).where("type = 'revisit'").collect()} == {None}
    blocks = archives.read_arc(spark, folders[0]).where("key = 6").collect()
    assert archives.split_block(archives.zlib.decompress(blocks[0]["block"]))[1] == ROWS[5][2]


def test_legacy_headers():
    one = archives.arc_opening(1, "n", "20010203040506")
    body = b"HTTP/1.0 404 Gone\r\nA: b\r\n\r\nhi"
    data = one + b"http://x/a b 1.2.3.4 200102 text/html %d\n" % len(body) + body + b"\n" + b"no header\n" + b"dns:x 1.2.3.4 20010203040506 text/dns 3\nabc\n"
    found = list(archives.parse_arc(data))
    assert [(f.get("URL"), bad) for _, _, f, _, bad in found] == [("http://x/a b", False), (None, True), ("dns:x", False)]
    assert archives.split_block(found[0][3]) == (body[:-2], b"hi") and found[2][3] == b"abc"
    two = archives.arc_opening(2, "n", "20010203040506") + archives.arc_header(2, "http://y/ z", "::1", "2001", "text/html", 2, "n") + b"ok\n"
    (_, version, fields, block, _), = archives.parse_arc(two)
    assert version == 2 and fields["URL"] == "http://y/%20z" and fields["Result-code"] == "200" and block == b"ok"
    assert archives.iso_date("200102") == "2001-02-01T00:00:00Z" and archives.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert archives.warc_type("dns:x", b"") == ("resource", "text/dns")


def test_empty(spark):
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    archives.write_arc(pages(spark, []), arc)
    archives.convert(spark, arc, warc)
    assert archives.read_warc(spark, warc).count() == 0 and archives.damaged_lines(spark, arc).count() == 0


def _put(folder, name, data):
    at = pathlib.Path(folder.removeprefix("file:"))
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_bytes(data)


def test_damaged_arc_members_and_version_blocks(spark):
    records = [archives.arc_opening(1, "n", "2001")] + [b"http://%c/ 1.2.3.4 2001 text/html 3\nab%c\n" % (c, c) for c in b"stuvw"]
    packed = [gzip.compress(r) for r in records]
    torn = bytearray(packed[2])
    torn[12:-8] = b"\xff" * (len(torn) - 20)
    wrong_sum = packed[4][:-8] + bytes(4) + packed[4][-4:]
    good, places = b"", []
    for part in (packed[0], packed[1], bytes(torn), packed[3], wrong_sum, packed[5], packed[1][:-6]):
        places.append(len(good))
        good += part
    found = list(archives.parse_arc(good))
    assert [(o, f.get("URL"), b, bad) for o, _, f, b, bad in found] == [
        (places[1], "http://s/", b"abs", False), (places[2], None, b"", True), (places[3], "http://u/", b"abu", False), (places[4], None, b"", True),
        (places[5], "http://w/", b"abw", False), (places[6], None, b"", True)]
    for block in (b"one 0 crawl\nURL IP-address Archive-date Content-type Archive-length\n", b"1 0 crawl", b"", b"1 0 c\nURL Archive-length\n", b"2 0 c\nURL IP-address Archive-date Archive-length Content-type\n"):
        data = archives.arc_header(1, "filedesc://n", "0.0.0.0", "2001", "text/plain", len(block), "n") + block + b"\n" + records[1]
        assert [(f.get("URL"), bad) for _, _, f, _, bad in archives.parse_arc(data)] == [(None, True), ("http://s/", False)]
    folder = new_path(spark, "arc")
    _put(folder, "a.arc.gz", good)
    assert sorted(r["url"] for r in archives.read_arc(spark, folder).collect()) == ["http://s/", "http://u/", "http://w/"]
    assert sorted(r["offset"] for r in archives.damaged_lines(spark, folder).collect()) == [places[2], places[4], places[6]]
    warc = new_path(spark, "warc")
    archives.convert(spark, folder, warc)
    assert archives.read_warc(spark, warc).where("intact").count() == 3 and archives.damaged_warc(spark, warc).count() == 0


def test_damaged_warc_records(spark):
    def record(key, block):
        return archives.warc_record([("WARC-Type", "resource"), ("WARC-Target-URI", f"http://{key}/"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{digest(block)}"), (archives.KEY_FIELD, key)], block)

    whole = record(1, b"one")
    lost = [b"garbage\r\n\r\n", record(2, b"two").replace(b"Content-Length: 3", b"Content-Length: x"), record(3, b"three").replace(b"Content-Length: 5", b"Content-Length: 5000")]
    for bad in lost:
        found = list(archives.parse_warc(whole + bad + record(4, b"four")))
        assert [(o, b) for o, _, b in found] == [(0, b"one"), (len(whole), None), (len(whole + bad), b"four")]
    assert [b for _, _, b in archives.parse_warc(whole + whole[:20])] == [b"one", None]
    odd = record(1, b"five").replace(b"X-Page-Id: 1", b"X-Page-Id: nine")
    folder = new_path(spark, "warc")
    _put(folder, "a.warc", whole + lost[1] + odd)
    _put(folder, "b.warc.gz", gzip.compress(whole) + gzip.compress(lost[0])[:-9] + gzip.compress(record(4, b"four")))
    rows = sorted((r["archive"], r["key"] or 0, r["size"], r["intact"]) for r in archives.read_warc(spark, folder).collect())
    assert rows == [("a.warc", 0, 4, True), ("a.warc", 1, 3, True), ("b.warc.gz", 1, 3, True), ("b.warc.gz", 4, 4, True)]
    assert sorted((r["archive"], r["offset"]) for r in archives.damaged_warc(spark, folder).collect()) == [("a.warc", len(whole)), ("b.warc.gz", len(gzip.compress(whole)))]


def test_gzip_opening_inside_packed_bytes():
    """Stored (not deflated) members hold their bytes as they are, chance openings too."""
    import zlib
    def stored(data):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    one, two = stored(b"x" * 50 + archives.GZIP + bytes(3) + b"y" * 50), stored(b"tail")
    broken = bytearray(one)
    broken[10] ^= 0x06
    assert list(archives.members(bytes(broken) + two)) == [(0, None), (len(one), b"tail")]
    assert list(archives.members(one + two))[0][0] == 0
