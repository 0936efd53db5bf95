import base64
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from talweg.llm import warc as W
from talweg.llm.queries import op1_warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/1", "<p>é</p>"),
    (2, None, None),
    (3, "http://a.example/\r\nX: 1", ""),
    (4, "u", "<p>é</p>"),
    (None, "u", "<p>é</p>"),
    (9, "u", "x\r\n\r\ny" * 50_000),
    (7, "u", "x\r\n\r\ny" * 50_000),
    (8, "u", "alone"),
    (8, "u", "alone"),
    (None, "u", "nobody"),
]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages, least=0):
    best = {}
    for page_id, _, html in pages:
        best.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        top = max((p for p in best[html or ""] if p is not None), default=None)
        again = page_id != top and len(body) >= least
        out.append((page_id, len(body), digest(body), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages, **options):
    packages = W.write_packages(pages, **options)
    return packages, W.read_records(W.list_records(spark, packages))


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(2)).repartition(3)
    for least, size in ((0, 64), (0, 1 << 20), (7, 1 << 20)):
        packages, records = round_trip(spark, pages, least_bytes=least, package_bytes=size)
        rows = records.collect()
        number = lambda u: None if u in (None, "urn:page:") else int(u[9:])
        got = sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.warc_type, number(r.refers_to)) for r in rows), key=str)
        assert got == brute(PAGES, least)
        assert all(digest(bytes(r.payload)) == r.payload_digest for r in rows if r.warc_type == "response")
        assert {r.target_uri for r in rows} >= {"http://a.example/1", "http://a.example/%0D%0AX: 1", None}
        if size == 64:
            assert packages.count() > 3


def test_empty_table(spark):
    _, records = round_trip(spark, spark.createDataFrame([], SCHEMA))
    assert records.count() == 0


def zip64(members):
    """A package whose directory keeps every size and offset in ZIP64 fields, with bytes before it."""
    out, directory = io.BytesIO(), b""
    for name, data in members:
        at, crc, n = out.tell(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, n, n)
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name.encode() + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at)
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    at = out.tell()
    out.write(directory)
    end = out.tell()
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end")
    return out.getvalue()


def test_foreign_packages(spark, tmp_path):
    records = [gzip.compress(W.build_record(k, f"u{k}", b"<p>%d</p>" % k * 9, digest(b"<p>%d</p>" % k * 9), None)) for k in range(5)]
    body = b"".join(records)
    (tmp_path / "a.wacz").write_bytes(zip64([("pages/pages.jsonl", b"{}"), ("archive/other.warc.gz", body)]))
    with zipfile.ZipFile(tmp_path / "b.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", body)
        z.comment = b"with a comment"
    (tmp_path / "c.wacz").write_bytes(b"before" * 9 + (tmp_path / "b.wacz").read_bytes())
    with zipfile.ZipFile(tmp_path / "d.wacz", "w"):
        pass
    packages = spark.createDataFrame([(f"file://{tmp_path}/{x}.wacz",) for x in "abcd"], "path string")
    rows = W.read_records(W.list_records(spark, packages)).collect()
    assert sorted(r.target_uri for r in rows) == sorted([f"u{k}" for k in range(5)] * 3)
    assert all(bytes(r.payload) == b"<p>%s</p>" % r.target_uri[1:].encode() * 9 for r in rows)


def test_query_on_driver_table(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op1_warc(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == brute(pages)
