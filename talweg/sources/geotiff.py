"""GeoTIFF as a Spark data source: ``spark.read.format("geotiff")`` and grids written as GeoTIFF files.

A file's directory says where its strips or tiles are, so each partition reads the byte ranges of its own blocks and
no others. Options: ``path`` (a file, a folder or a pattern; several files are one grid by their transforms), ``rows``
(``first:stop``, only blocks that reach into these rows are read), ``blocks`` (a partition, 1 unless set). With
``spark.sql.python.filterPushdown.enabled`` conditions on ``row`` do the same (``read_geotiff`` asks for it). Read are classic and big files of either byte
order, strips and tiles, any number of bands in either layout, integers and floats, without compression, with deflate
or LZW, and all three predictors. Nodata and NaN are NULL; blocks that a sparse file leaves out are all NULL.

A grid is written as one file for each ``rows_a_file`` rows, encoded in its task; a file has a temporary name until
all tasks are done, so readers see the old file or the whole new one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from talweg.functions.gridding import Grid
from talweg.sources import files

ENDINGS = (".tif", ".tiff")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "row int, col int, band int, value double"
# Fixed values of the format: sizes of field types, tags, compressions, sample formats, geographic keys.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, BANDS, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072
DEGREES = 4326


@dataclass(frozen=True)
class Profile:
    """What a file's directory says. ``transform`` is (column step, 0, west, 0, row step, north) of an upright grid."""

    width: int
    height: int
    bands: int
    dtype: str
    nodata: float | None
    transform: tuple[float, ...]
    epsg: int | None
    compression: int
    predictor: int
    chunky: bool
    block: tuple[int, int]
    places: tuple[tuple[int, int], ...]
    order: str

    def matches(self, grid: Grid, tolerance: float = 1e-9) -> bool:
        """Whether the file is on exactly this grid."""
        wanted = (grid.res, 0.0, grid.west, 0.0, -grid.res, grid.north)
        return (self.width, self.height) == (grid.width, grid.height) and all(abs(a - b) <= tolerance for a, b in zip(self.transform, wanted, strict=True))


def profile(uri: str) -> Profile:
    with files.Ranges(uri) as read:
        return _directory(read)


def _directory(read: files.Ranges) -> Profile:
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    count_kind, entry, inline, at_kind = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    at = struct.unpack(f"{order}Q", read(8, 8))[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    width = struct.calcsize(f"{order}{count_kind}")
    n = struct.unpack(f"{order}{count_kind}", read(at, width))[0]
    rows = read(at + width, n * entry)
    tags: dict[int, tuple] = {}
    for k in range(n):
        own = rows[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(f"{order}HH", own[:4])
        count = struct.unpack(f"{order}{at_kind}", own[4 : 4 + inline])[0]
        if kind not in FIELD:
            continue
        size = FIELD_BYTES[kind] * count
        data = own[4 + inline : 4 + inline + size] if size <= inline else read(struct.unpack(f"{order}{at_kind}", own[4 + inline :])[0], size)
        tags[tag] = struct.unpack(f"{order}{count}{FIELD[kind]}", data)
    get = lambda tag, default=None: tags.get(tag, (default,))[0]
    bands = get(BANDS, 1)
    if len(set(tags.get(BITS, (1,)))) > 1 or get(FORMAT, 1) not in KINDS or get(BITS, 1) % 8:
        raise ValueError("samples of unlike or odd sizes are not read")
    if get(COMPRESSION, 1) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {get(COMPRESSION)} is not read")
    tiled = TILE_AT in tags
    block = (get(TILE_HEIGHT), get(TILE_WIDTH)) if tiled else (min(get(STRIP_ROWS, get(HEIGHT)), get(HEIGHT)), get(WIDTH))
    places = tuple(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    nodata = get(NODATA, b"").split(b"\0")[0].strip()
    keys = tags.get(GEO_KEYS, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (GEOGRAPHIC_KEY, PROJECTED_KEY) and keys[k + 1] == 0), None)
    return Profile(get(WIDTH), get(HEIGHT), bands, f"{KINDS[get(FORMAT, 1)]}{get(BITS) // 8}", float(nodata) if nodata else None, _transform(tags), epsg, get(COMPRESSION, 1), get(PREDICTOR, 1), get(PLANAR, 1) == 1, block, places, order)


def _transform(tags: dict[int, tuple]) -> tuple[float, ...]:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        return m[0], m[1], m[3], m[4], m[5], m[7]
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    return 1.0, 0.0, 0.0, 0.0, -1.0, 0.0


# --- blocks ------------------------------------------------------------------------------------------------------


def lzw(data: bytes) -> bytes:
    """Decodes the format's LZW: codes of 9 to 12 bits, highest bit first, one wider a code early."""
    known = [bytes([k]) for k in range(256)] + [b"", b""]
    out, table, width, held, bits = [], known.copy(), 9, 0, 0
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, width, last = known.copy(), 9, b""
            continue
        if code == 257:
            break
        if not last:
            last = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
        out.append(last)
        width = max(width, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def decoded(data: bytes, p: Profile, samples: int) -> np.ndarray:
    """A block's values (rows, columns, samples); the last strip may have fewer rows than the others."""
    data = zlib.decompress(data) if p.compression in (DEFLATE, OLD_DEFLATE) else lzw(data) if p.compression == LZW else data
    cols, size = p.block[1], int(p.dtype[1:])
    rows = min(p.block[0], len(data) // (cols * samples * size))
    data = data[: rows * cols * samples * size]
    if p.predictor == 3:  # the planes of the values' bytes, highest first, each byte less the one before
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{p.dtype}").reshape(rows, cols, samples)
    if p.predictor == 2:  # each value less the one before, as whole numbers
        whole = np.frombuffer(data, f"{p.order}u{size}").reshape(rows, cols, samples).astype(f"u{size}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(p.dtype)
    return np.frombuffer(data, f"{p.order}{p.dtype}").reshape(rows, cols, samples)


def encoded(values: np.ndarray, predictor: int) -> bytes:
    """Deflated rows of one band, little-endian; the inverse of ``decoded``."""
    rows, size = len(values), values.dtype.itemsize
    if predictor == 3:
        planes = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, -1, size).transpose(0, 2, 1).reshape(rows, -1)
        data = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
    elif predictor == 2:
        data = np.diff(np.ascontiguousarray(values).view(f"<u{size}"), axis=1, prepend=np.array(0, f"<u{size}")).tobytes()
    else:
        data = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()
    return zlib.compress(data, 6)


@dataclass
class Blocks(InputPartition):
    """Blocks (number in the file, first row, first column) of one file, whose first cell is at ``origin`` of the grid."""

    uri: str
    origin: tuple[int, int]
    blocks: tuple[tuple[int, int, int], ...]
    rows: tuple[int, int]


def _origins(profiles: list[Profile]) -> list[tuple[int, int]]:
    """Where each file's first cell is on the grid of all."""
    dx, dy = profiles[0].transform[0], profiles[0].transform[4]
    if any(abs(p.transform[0] - dx) > 1e-9 or abs(p.transform[4] - dy) > 1e-9 for p in profiles):
        raise ValueError("the files' cells are of unlike sizes")
    west, north = min(p.transform[2] for p in profiles), max(p.transform[5] for p in profiles) if dy < 0 else min(p.transform[5] for p in profiles)
    return [(round((p.transform[5] - north) / dy), round((p.transform[2] - west) / dx)) for p in profiles]


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.blocks = options["path"], int(options.get("blocks", 1))
        first, _, stop = options.get("rows", ":").partition(":")
        self.rows = (int(first or 0), int(stop or 1 << 31))

    def partitions(self) -> list[InputPartition]:
        uris = [uri for uri, _ in files.listed(self.path, ENDINGS)]
        profiles = [profile(uri) for uri in uris]
        out: list[InputPartition] = []
        for uri, p, origin in zip(uris, profiles, _origins(profiles) if profiles else [], strict=True):
            across = -(-p.width // p.block[1])
            down = -(-p.height // p.block[0])
            wanted = []
            for k in range(len(p.places)):
                at = k % (across * down)
                row, col = at // across * p.block[0], at % across * p.block[1]
                if self.rows[0] < origin[0] + row + p.block[0] and origin[0] + row < self.rows[1]:
                    wanted.append((k, row, col))
            out += [Blocks(uri, origin, tuple(wanted[i : i + self.blocks]), self.rows) for i in range(0, len(wanted), self.blocks)]
        return out or [Blocks("", (0, 0), (), self.rows)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        with files.Ranges(partition.uri) as read:
            p = _directory(read)
            across, down = -(-p.width // p.block[1]), -(-p.height // p.block[0])
            samples = p.bands if p.chunky else 1
            for k, row, col in partition.blocks:
                shown = (min(p.block[0], p.height - row), min(p.block[1], p.width - col))
                at, size = p.places[k]
                values = decoded(read(at, size), p, samples)[: shown[0], : shown[1]] if size else np.full((*shown, samples), np.nan)
                first = k // (across * down) if not p.chunky else 0
                r = np.repeat(np.arange(shown[0]) + row + partition.origin[0], shown[1]).astype(np.int32)
                c = np.tile(np.arange(shown[1]) + col + partition.origin[1], shown[0]).astype(np.int32)
                inside = (r >= partition.rows[0]) & (r < partition.rows[1])
                for band in range(samples):
                    own = values[:, :, band].ravel()
                    missing = np.isnan(own) if own.dtype.kind == "f" else np.zeros(len(own), bool)
                    if p.nodata is not None:
                        missing |= own == (own.dtype.type(p.nodata) if own.dtype.kind == "f" else p.nodata)
                    number = np.full(int(inside.sum()), first + band + 1, np.int32)
                    value = pa.array(own.astype(np.float64)[inside], mask=missing[inside])
                    yield pa.RecordBatch.from_arrays([pa.array(r[inside]), pa.array(c[inside]), pa.array(number), value], ["row", "col", "band", "value"])


class PushingReader(GeoTiffReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on rows choose blocks; Spark applies all of them to the cells."""
        first, stop = self.rows
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    first = max(first, f.value)
                if isinstance(f, GreaterThan):
                    first = max(first, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    stop = min(stop, f.value + 1)
                if isinstance(f, LessThan):
                    stop = min(stop, f.value)
            yield f
        self.rows = (first, stop)


# --- writing -----------------------------------------------------------------------------------------------------


def file_bytes(strips: list[bytes], width: int, height: int, strip_rows: int, dtype: np.dtype, nodata: float, west: float, north: float, res: tuple[float, float], predictor: int, epsg: int = DEGREES) -> bytes:
    """A file of one band: header, directory, strips."""
    big = sum(map(len, strips)) > (1 << 31)
    at_kind, header, entry, count_bytes = ("Q", 16, 20, 8) if big else ("I", 8, 12, 2)
    keys = [1, 1, 0, 3, MODEL_KEY, 0, 1, 2 if epsg == DEGREES else 1, RASTER_KEY, 0, 1, 1, GEOGRAPHIC_KEY if epsg == DEGREES else PROJECTED_KEY, 0, 1, epsg]
    text = (repr(float(nodata)) if dtype.kind == "f" else str(int(nodata))).encode() + b"\0"
    wide = 16 if big else 4
    fields: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [dtype.itemsize * 8]), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]),
        (STRIP_AT, wide, [0] * len(strips)), (BANDS, 3, [1]), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, wide, [len(s) for s in strips]), (PLANAR, 3, [1]),
        (PREDICTOR, 3, [predictor]), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]),
        (PIXEL_SCALE, 12, [res[0], res[1], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, 3, keys), (NODATA, 2, text),
    ]
    inline = 8 if big else 4
    beyond = header + count_bytes + entry * len(fields) + (8 if big else 4)
    total = beyond + sum(n for _, kind, v in fields if (n := FIELD_BYTES[kind] * len(v)) > inline)
    places = np.cumsum([total] + [len(s) for s in strips])[:-1].tolist()
    fields[5] = (STRIP_AT, wide, places)
    rows, extra = [], b""
    for tag, kind, values in fields:
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
        own = struct.pack(f"<HH{at_kind}", tag, kind, len(values))
        if len(data) > inline:
            own += struct.pack(f"<{at_kind}", beyond + len(extra))
            extra += data
        else:
            own += data.ljust(inline, b"\0")
        rows.append(own)
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
    directory = struct.pack("<Q" if big else "<H", len(fields)) + b"".join(rows) + struct.pack(f"<{at_kind}", 0)
    return b"".join([head, directory, extra, *strips])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class GeoTiffWriter(DataSourceArrowWriter):
    """Takes cells (row, col, value) in the order of rows; a file is whole when the next one begins."""

    def __init__(self, options: dict, overwrite: bool):
        self.o, self.overwrite = options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        o = self.o
        width, height, a_file, a_strip = (int(o[k]) for k in ("width", "height", "rows_a_file", "rows_a_strip"))
        dtype, nodata, predictor = np.dtype(o["dtype"]), float(o["nodata"]), int(o.get("predictor", 2))
        moves: list[tuple[str, str]] = []
        number, grid = -1, None

        def close() -> None:
            if grid is None:
                return
            first = number * a_file
            strips = [encoded(grid[k : k + a_strip], predictor) for k in range(0, len(grid), a_strip)]
            north = float(o["north"]) - first * float(o["res_y"])
            data = file_bytes(strips, width, len(grid), a_strip, dtype, nodata, float(o["west"]), north, (float(o["res_x"]), float(o["res_y"])), predictor, int(o.get("epsg", DEGREES)))
            name = f"rows-{first:09d}.tif"
            temporary = f"{o['path']}/.{name}.{uuid.uuid4().hex}"
            files.put(temporary, data)
            moves.append((temporary, f"{o['path']}/{name}"))

        files.make_folder(o["path"])
        for batch in batches:
            row, col = batch.column("row").to_numpy(), batch.column("col").to_numpy()
            value = np.asarray(batch.column("value").to_numpy(zero_copy_only=False), np.float64)
            value = np.where(np.isfinite(value), value, nodata)
            own = row // a_file
            for k in np.unique(own).tolist():
                if k != number:
                    close()
                    number = k
                    grid = np.full((min(a_file, height - k * a_file), width), nodata, dtype)
                here = own == k
                grid[row[here] - k * a_file, col[here]] = value[here].astype(dtype)
        close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [m for w in messages if w is not None for m in w.moves]
        old = {uri for uri, _ in files.listed(self.o["path"], ENDINGS)} if self.overwrite and moves else set()
        for temporary, final in moves:
            files.move(temporary, final)
        kept = {files.located(final)[1] for _, final in moves}
        for uri in old:
            if files.located(uri)[1] not in kept:
                files.remove(uri)

    def abort(self, messages: list[Written | None]) -> None:
        for w in messages:
            for temporary, _ in w.moves if w is not None else []:
                files.remove(temporary)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return PushingReader(self.options) if self.options.get("pushdown") == "true" else GeoTiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options, overwrite)


def read_geotiff(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, blocks: int = 1) -> DataFrame:
    """(row, col, band, value) of the grid at ``path``; rows count from the top of all files, bands from 1."""
    spark.dataSource.register(GeoTiff)
    pushdown = spark.conf.get(PUSHDOWN, "false").lower()
    found = spark.read.format("geotiff").option("blocks", blocks).option("pushdown", pushdown)
    if rows is not None:
        found = found.option("rows", f"{rows[0]}:{rows[1]}")
    return found.load(path)


def write_geotiff(cells: DataFrame, path: str, grid: Grid, value: str = "value", dtype: str = "float32", nodata: float = -9999.0, rows_a_file: int | None = None, rows_a_strip: int = 64, predictor: int = 2) -> None:
    """Writes ``cells`` (row, col, ``value``) of ``grid`` into the folder ``path``; cells that are not there are nodata.

    A file has at most 64 MB of values unless ``rows_a_file`` says otherwise, and is made by one task.
    """
    cells.sparkSession.dataSource.register(GeoTiff)
    most = max(1, (64 << 20) // (grid.width * np.dtype(dtype).itemsize))
    a_file = min(rows_a_file or most, grid.height)
    placed = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("value"))
    number = F.expr(f"row div {a_file}")
    laid = placed.repartition(number).sortWithinPartitions("row", "col")
    options = {"width": grid.width, "height": grid.height, "west": repr(grid.west), "north": repr(grid.north), "res_x": repr(grid.res), "res_y": repr(grid.res), "rows_a_file": a_file, "rows_a_strip": min(rows_a_strip, a_file), "dtype": dtype, "nodata": repr(nodata), "predictor": predictor}
    laid.write.format("geotiff").mode("overwrite").options(**options).save(path)
