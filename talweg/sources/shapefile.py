"""Shapefiles as a Spark data source: records are found by the index, so one file is read by many tasks.

A partition is a range of records: their places are a byte range of the ``.shx``, their shapes of the ``.shp``, their
attributes of the ``.dbf``. Options: ``path`` (a ``.shp``, a folder or a pattern), ``records`` (a partition, 50,000 unless set) and
``box`` (``west,south,east,north``: only shapes whose own box meets it). Read are points, point sets, lines and polygons, with or
without heights and measures, which are left out. A layer in another projection than degrees is an error.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from talweg.sources import files

SCHEMA = "record long, kind string, parts array<array<struct<lon: double, lat: double>>>, properties map<string, string>"
# Fixed values of the format: kinds of shapes; ten and twenty more are the same with heights or measures.
POINT, LINE, POLYGON, POINTS = 1, 3, 5, 8
HEAD = 100


@dataclass
class Records(InputPartition):
    uri: str
    first: int
    stop: int


@dataclass(frozen=True)
class Fields:
    """What the head of a ``.dbf`` says."""

    records: int
    head: int
    width: int
    columns: tuple[tuple[str, str, int, int], ...]
    encoding: str


def _beside(uri: str, ending: str) -> str:
    return uri[:-4] + ending


def _fields(uri: str) -> Fields | None:
    try:
        with files.Ranges(_beside(uri, ".dbf")) as read:
            records, head, width = struct.unpack("<IHH", read(4, 8))
            body = read(32, head - 32)
    except FileNotFoundError:
        return None
    columns, at = [], 1
    for k in range(0, len(body) - 31, 32):
        if body[k] == 13:
            break
        size = body[k + 16]
        columns.append((body[k : k + 11].split(b"\0")[0].decode("latin-1").strip(), chr(body[k + 11]), at, size))
        at += size
    try:
        with files.Ranges(_beside(uri, ".cpg")) as read:
            encoding = read(0, read.size()).decode("ascii", "ignore").strip().lower()
        "".encode(encoding)
    except (FileNotFoundError, LookupError):
        encoding = "utf-8"
    return Fields(records, head, width, tuple(columns), encoding)


def _in_degrees(uri: str) -> bool:
    try:
        with files.Ranges(_beside(uri, ".prj")) as read:
            return not read(0, read.size()).lstrip().upper().startswith((b"PROJCS", b"PROJCRS"))
    except FileNotFoundError:
        return True


def _attributes(data: bytes, fields: Fields) -> list[tuple[str, str]]:
    out = []
    for name, kind, at, size in fields.columns:
        raw = data[at : at + size]
        try:
            text = raw.decode(fields.encoding)
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        text = text.strip(" \0")
        if text and not (kind in "NF" and set(text) == {"*"}):
            out.append((name, text))
    return out


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", 50_000))
        self.box = tuple(map(float, options["box"].split(","))) if "box" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for uri, _ in files.listed(self.path, (".shp",)):
            if not _in_degrees(uri):
                raise ValueError(f"{uri} is projected; only layers in degrees are read")
            with files.Ranges(_beside(uri, ".shx")) as read:
                n = (read.size() - HEAD) // 8
            out += [Records(uri, k, min(n, k + self.records)) for k in range(0, n, self.records)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        n = partition.stop - partition.first
        if not n:
            return
        with files.Ranges(_beside(partition.uri, ".shx")) as read:
            places = np.frombuffer(read(HEAD + 8 * partition.first, 8 * n), ">i4").reshape(n, 2).astype(np.int64) * 2
        fields = _fields(partition.uri)
        rows = b""
        if fields is not None:
            with files.Ranges(_beside(partition.uri, ".dbf")) as read:
                have = max(0, min(n, fields.records - partition.first))
                rows = read(fields.head + fields.width * partition.first, fields.width * have)
        with files.Ranges(partition.uri) as read:
            for a in range(0, n, 2_000):  # neighbouring records in one read, if they are neighbours in the file too
                own = places[a : a + 2_000]
                low, high = int(own[:, 0].min()), int((own[:, 0] + own[:, 1]).max()) + 8
                together = high - low <= 2 * int(own[:, 1].sum()) + (1 << 16)
                data = read(low, high - low) if together else b""
                kinds, shapes, numbers, attributes = [], [], [], []
                for k, (at, size) in enumerate(own.tolist()):
                    body = data[at - low + 8 : at - low + 8 + size] if together else read(at + 8, size)
                    kind, parts, box = shape_of(body)
                    if self.box is not None and (box is None or box[0] > self.box[2] or box[2] < self.box[0] or box[1] > self.box[3] or box[3] < self.box[1]):
                        continue
                    kinds.append(kind)
                    shapes.append(parts)
                    numbers.append(partition.first + a + k)
                    row = rows[(a + k) * fields.width : (a + k + 1) * fields.width] if fields is not None else b""
                    attributes.append(_attributes(row, fields) if row else [])
                yield _batch(numbers, kinds, shapes, attributes)


def shape_of(body: bytes) -> tuple[str | None, list[np.ndarray] | None, tuple[float, ...] | None]:
    """(kind, parts as (n, 2) arrays, box) of a record; all None for a null shape."""
    number = struct.unpack_from("<i", body)[0]
    kind = number % 10
    if number == 0:
        return None, None, None
    if kind == POINT:
        xy = np.frombuffer(body, "<f8", 2, 4)
        return "Point", [xy.reshape(1, 2)], (*xy.tolist(), *xy.tolist())
    box = struct.unpack_from("<4d", body, 4)
    if kind == POINTS:
        n = struct.unpack_from("<i", body, 36)[0]
        return "MultiPoint", [np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2)], box
    if kind not in (LINE, POLYGON):
        raise ValueError(f"shapes of kind {number} are not read")
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = np.frombuffer(body, "<i4", parts, 44)
    points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    cut = np.split(points, starts[1:])
    return ("Polygon" if kind == POLYGON else "LineString" if parts == 1 else "MultiLineString"), cut, box


def _batch(numbers: list[int], kinds: list[str | None], shapes: list[list[np.ndarray] | None], attributes: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    flat = [p for s in shapes for p in s or []]
    xy = np.concatenate(flat) if flat else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["lon", "lat"])
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in flat])]).astype(np.int32)), points)
    ends = np.concatenate([[0], np.cumsum([len(s or []) for s in shapes])]).astype(np.int32)
    missing = np.array([s is None for s in shapes] + [False])
    outer = pa.ListArray.from_arrays(pa.array(ends, mask=missing if missing.any() else None), inner)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(kinds, pa.string()), outer, pa.array(attributes, pa.map_(pa.string(), pa.string()))], ["record", "kind", "parts", "properties"])


# --- writing -----------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


def layer_bytes(rows: list[tuple[list[list[tuple[float, float]]], list[str]]], kind: int, columns: list[str]) -> dict[str, bytes]:
    """The files of a layer of (parts, attributes), by ending."""
    shapes, index, at = [], [], HEAD // 2
    low, high = [np.inf, np.inf], [-np.inf, -np.inf]
    for k, (parts, _) in enumerate(rows):
        xy = np.array([p for part in parts for p in part], "<f8").reshape(-1, 2)
        if len(xy):
            low, high = np.minimum(low, xy.min(0)), np.maximum(high, xy.max(0))
        if kind == POINT:
            body = struct.pack("<i", POINT) + xy[:1].tobytes() if len(xy) else struct.pack("<i", 0)
        else:
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1].astype("<i4")
            body = struct.pack("<i4d2i", kind, *(xy.min(0) if len(xy) else (0, 0)), *(xy.max(0) if len(xy) else (0, 0)), len(parts), len(xy)) + starts.tobytes() + xy.tobytes()
        shapes.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    box = (*low, *high) if np.isfinite(low).all() else (0.0,) * 4
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)
    sizes = [min(254, max([1, *(len(a[k].encode()) for _, a in rows)])) for k in range(len(columns))]
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([n, 0]) + bytes(14) for c, n in zip(columns, sizes, strict=True))
    table = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(rows), 33 + len(fields), 1 + sum(sizes)) + fields + b"\r"
    table += b"".join(b" " + b"".join(v.encode()[:n].ljust(n) for v, n in zip(a, sizes, strict=True)) for _, a in rows) + b"\x1a"
    shx = b"".join(index)
    return {".shp": head(at) + b"".join(shapes), ".shx": head((HEAD + len(shx)) // 2) + shx, ".dbf": table, ".cpg": b"UTF-8", ".prj": b'GEOGCS["WGS 84"]'}


class ShapefileWriter(DataSourceWriter):
    """One layer for each task (parts, properties): files with temporary names until all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.kind, self.columns = options["path"], int(options["kind"]), options["columns"].split(",")

    def write(self, rows: Iterator) -> Written:
        own = [([[(p["lon"], p["lat"]) for p in part] for part in r["parts"] or []], [(r["properties"] or {}).get(c) or "" for c in self.columns]) for r in rows]
        if not own:
            return Written([])
        files.make_folder(self.path)
        name, moves = uuid.uuid4().hex, []
        for ending, data in layer_bytes(own, self.kind, self.columns).items():
            temporary = f"{self.path}/.{name}{ending}"
            files.put(temporary, data)
            moves.append((temporary, f"{self.path}/part-{name}{ending}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        # the shapes last: what is listed is whole
        for temporary, final in sorted((m for w in messages if w is not None for m in w.moves), key=lambda m: m[1].endswith(".shp")):
            files.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        for w in messages:
            for temporary, _ in w.moves if w is not None else []:
                files.remove(temporary)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options)


def read_shapefile(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = 50_000) -> DataFrame:
    """(record, kind, parts, properties) of a layer; ``records`` a partition."""
    spark.dataSource.register(Shapefile)
    found = spark.read.format("shapefile").option("records", records)
    return (found.option("box", ",".join(map(repr, box))) if box is not None else found).load(path)


def write_shapefile(shapes: DataFrame, path: str, kind: int, columns: list[str]) -> None:
    """Adds ``shapes`` (parts, properties) to the folder ``path`` as layers of one ``kind``, a layer for each partition."""
    shapes.sparkSession.dataSource.register(Shapefile)
    rows = shapes.select("parts", "properties")
    rows.write.format("shapefile").mode("append").options(kind=kind, columns=",".join(columns)).save(path)


def shape_vertices(parts: str | Column = "parts") -> Column:
    """All vertices of a shape."""
    return F.flatten(parts)
