"""WARC records in ZIP packages: a writer, and a reader that takes ranges out of the stored members.

``write_packages`` writes one WARC record per page. Every task writes its own packages in the shared folder, each
of about ``package_bytes``: a ZIP file with the stored members ``archive/data.warc.gz`` (one gzip member per record)
and ``indexes/index.cdx`` (one line per record: offset, length). ``list_records`` parses the packages' central
directories, ZIP64 included, finds the stored archive members and reads the index, or where there is none, walks
the archive. ``read_records`` reads each record's byte range; nothing is extracted.

A payload that occurs more than once is stored once: the record of the largest page_id is a response, the others
are revisits that name its digest and record. Payloads of fewer than ``least_bytes`` bytes are always stored.

Defined cases: a null html is an empty payload; a null url leaves out the target; a page without an id is the
record ``urn:page:`` and sorts below all others; repeated rows give one record each, and those with the largest
page_id of their payload are all responses. Other columns are not read. Attempts of a task write files of
different names; only those that a finished attempt reports are read, so a lost executor leaves no half package.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.session import cut, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 32 << 20
#: Rows of the table of revisits that may be broadcast; a row has two numbers and a digest.
BROADCAST_ROWS = 200_000
BATCH_BYTES = 8 << 20


# --- records -------------------------------------------------------------------------------------------------


def _header(value: str) -> str:
    """A header value without control characters, which would end the line."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record, not yet compressed. With ``refers_to`` a revisit, which has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers, names in lower case, and the payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", len(rest)))]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP directories -----------------------------------------------------------------------------------------


class Member:
    """A member of a ZIP file: its name, method, sizes and where its data begins."""

    __slots__ = ("local", "method", "name", "size", "stored")

    def __init__(self, name: str, method: int, stored: int, size: int, local: int):
        self.name, self.method, self.stored, self.size, self.local = name, method, stored, size, local


Ranged = Callable[[int, int], bytes]


def directory(read: Ranged, size: int) -> list[Member]:
    """The members that the central directory lists; ``read(offset, length)`` gives bytes of the file."""
    tail_at = max(0, size - (22 + 0xFFFF + 20))
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<10xHII", tail, end)
    before = tail_at + end - length  # where the directory lies if nothing precedes the package
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<8xQ", tail, locator)
        record = read(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<32xQQQ", record)
        before = at - length
    shift = max(0, before - start)  # bytes put before the package move every offset
    data, at, members = read(start + shift, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method, stored, full, n_name, n_extra, n_comment, local = struct.unpack_from("<8xHH8xIIHHH8xI", data, at)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the ZIP64 field has only the values that do not fit, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        members.append(Member(name, method, stored, full, local + shift))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_offset(read: Ranged, member: Member) -> int:
    """Where a member's data begins: its local header may have another extra field than the directory has."""
    head = read(member.local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<26xHH", head)
    return member.local + 30 + n_name + n_extra


def walk_archive(read: Ranged, start: int, length: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member of an archive without an index."""
    at, stop = start, start + length
    while at < stop:
        inflate, pos = zlib.decompressobj(31), at
        while not inflate.eof and pos < stop:
            block = read(pos, min(step, stop - pos))
            inflate.decompress(block)
            pos += len(block)
        end = pos - len(inflate.unused_data)
        yield at, end - at
        at = end


@contextlib.contextmanager
def opened(path: str):
    """``read(offset, length)`` and the size of a file that the executors share."""
    system, inside = fs.FileSystem.from_uri(path)
    with system.open_input_file(inside) as f:
        yield (lambda offset, length: f.read_at(length, offset)), f.size()


# --- Spark ---------------------------------------------------------------------------------------------------


def _with_digest(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload a larger page_id stores."""
    known = _with_digest(pages).filter(F.octet_length("payload") >= least_bytes).select("page_id", "sha1")
    known = known.groupBy("page_id", "sha1").count().drop("count")
    shared = known.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return known.join(shared, "sha1").filter("NOT page_id <=> refers_to").select("page_id", "sha1", "refers_to")


def write_packages(pages: DataFrame, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages; returns (path, bytes, records) of each."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    again = cut(revisits(pages, least_bytes))
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    side = side.toDF("again_id", "again_sha1", "refers_to")
    given = _with_digest(pages)
    records = given.join(side, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")
    records = records.select("page_id", "url", "payload", "sha1", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = fs.FileSystem.from_uri(folder)
        system.create_dir(inside, recursive=True)
        packages: list[tuple[str, int, int]] = []
        body, index = io.BytesIO(), []

        def close() -> None:
            if not index:
                return
            name, out = f"{uuid.uuid4().hex}.wacz", io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(ARCHIVE, body.getvalue())
                z.writestr(INDEX, "".join(f"{at} {n}\n" for at, n in index))
            with system.open_output_stream(f"{inside}/{name}") as f:
                f.write(out.getbuffer())
            packages.append((f"{folder}/{name}", out.getbuffer().nbytes, len(index)))
            body.seek(0)
            body.truncate()
            index.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                record = build_record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to)
                packed = gzip.compress(record, 6, mtime=0)
                index.append((body.tell(), len(packed)))
                body.write(packed)
                if body.tell() >= package_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "bytes": b, "records": n} for p, b, n in packages], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return cut(records.mapInArrow(write, "path string, bytes long, records long"))


def list_records(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(path, offset, length) of every record in the stored archive members of ``packages`` (path)."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as (read, size):
                    members = {m.name: m for m in directory(read, size)}
                    ranges: list[tuple[int, int]] = []
                    for name, member in members.items():
                        if not re.fullmatch(r"archive/.*\.warc\.gz", name) or member.method != zipfile.ZIP_STORED:
                            continue
                        start = data_offset(read, member)
                        index = members.get(INDEX) if name == ARCHIVE else None
                        if index is not None and index.method == zipfile.ZIP_STORED:
                            lines = read(data_offset(read, index), index.size).decode().splitlines()
                            ranges += [(start + int(at), int(n)) for at, n in map(str.split, lines)]
                        else:
                            ranges += walk_archive(read, start, member.size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array([a for a, _ in ranges], pa.int64()), pa.array([n for _, n in ranges], pa.int64())], schema=schema)

    parts = max(1, min(packages.count(), 10 * spark.sparkContext.defaultParallelism))
    return packages.select("path").repartition(parts).mapInArrow(listed, "path string, offset long, length long")


RECORD = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"


def read_records(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the ranges (path, offset, length): headers, digest and, if asked for, the payload.

    A response's digest and size are those of the payload read, and must be those that its headers name; a
    revisit's are those of the response that it stands for, as its headers name them.
    """
    schema = pa.schema(
        [("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
        + ([("payload", pa.binary())] if with_payload else [])
    )

    def one(data: bytes) -> dict:
        headers, http, payload = parse_record(gzip.decompress(data))
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        own = {"record_id": headers["warc-record-id"].strip("<>"), "warc_type": headers["warc-type"], "target_uri": headers.get("warc-target-uri"), "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None}
        if headers["warc-type"] == "revisit":
            return own | {"payload_digest": named, "payload_bytes": int(http["content-length"]), "payload": None}
        digest = base32_sha1(payload)
        if named and named != digest:
            raise ValueError(f"{own['record_id']}: the payload's digest is {digest}, not {named}")
        return own | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}

    def read_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out, held, at = [], 0, 0
            while at < len(rows):
                with opened(rows[at][0]) as (read, _):
                    path = rows[at][0]
                    while at < len(rows) and rows[at][0] == path:
                        out.append(one(read(rows[at][1], rows[at][2])))
                        held += out[-1]["payload_bytes"]
                        at += 1
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    return records.select("path", "offset", "length").mapInArrow(read_all, RECORD + (", payload binary" if with_payload else ""))
