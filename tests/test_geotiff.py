"""GeoTIFF files, read and written, against files that the tests encode by themselves."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid
from talweg.sources import files
from talweg.sources import geotiff as G


def lzw_encoded(data):
    """The format's LZW, by a dictionary of byte strings."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, known = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for byte in data:
        longer = known + bytes([byte])
        if longer in table:
            known = longer
            continue
        put(table[known], width)
        table[longer] = len(table) + 2
        known = bytes([byte])
        if len(table) + 2 >= 4094:
            put(table[known], 12)  # the code that the last string ends in, then a new table
            put(256, 12)
            table, width, known = {bytes([k]): k for k in range(256)}, 9, b""
        elif len(table) + 3 > (1 << width):
            width += 1
    if known:
        put(table[known], width)
        if len(table) + 4 > (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def tiff(blocks, tags, order="<", big=False):
    """A file of ``blocks`` (compressed) with ``tags`` {number: (kind, values)}; strips or tiles by the tags given."""
    at, count = (324, 325) if 322 in tags else (273, 278 + 1)
    head = 16 if big else 8
    places = np.cumsum([head] + [len(b) for b in blocks])[:-1].tolist()
    places = [p if b else 0 for p, b in zip(places, blocks, strict=True)]
    tags = tags | {at: (16 if big else 4, places), count: (16 if big else 4, [len(b) for b in blocks])}
    body = b"".join(blocks)
    extra, rows = b"", []
    beyond = head + len(body)
    for tag in sorted(tags):
        kind, values = tags[tag]
        data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{G.FIELD[kind]}", *values)
        own = struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, kind, len(values))
        if len(data) > (8 if big else 4):
            own += struct.pack(f"{order}{'Q' if big else 'I'}", beyond + len(extra))
            extra += data
        else:
            own += data.ljust(8 if big else 4, b"\0")
        rows.append(own)
    where = beyond + len(extra)
    first = {"<": b"II", ">": b"MM"}[order] + (struct.pack(f"{order}HHHQ", 43, 8, 0, where) if big else struct.pack(f"{order}HI", 42, where))
    directory = struct.pack(f"{order}{'Q' if big else 'H'}", len(rows)) + b"".join(rows) + struct.pack(f"{order}{'Q' if big else 'I'}", 0)
    return first + body + extra + directory


def base_tags(height, width, dtype, bands=1, compression=1, predictor=1, nodata=None, planar=1):
    size, kind = np.dtype(dtype).itemsize, np.dtype(dtype).kind
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [size * 8] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [planar]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[kind]] * bands)}
    tags |= {33550: (12, [0.5, 0.25, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 84.0, 28.0, 0.0]), 34735: (3, [1, 1, 0, 1, 2048, 0, 1, 4326])}
    return tags | ({42113: (2, nodata)} if nodata else {})


def collected(df):
    return {(r.row, r.col, r.band): r.value for r in df.collect()}


def expected(values, nodata=None):
    """``values`` (band, row, col)."""
    return {(r, c, b + 1): None if (v != v or v == nodata) else float(v) for b, band in enumerate(values) for r, line in enumerate(band.tolist()) for c, v in enumerate(line)}


def plane_rows(values, order):
    """Rows of one band in the third predictor's layout."""
    planes = values.astype(f">f{values.dtype.itemsize}").view(np.uint8).reshape(len(values), -1, values.dtype.itemsize).transpose(0, 2, 1).reshape(len(values), -1)
    return np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_strips_of_all_compressions(spark, tmp_path, order, compression):
    rng = np.random.default_rng(compression)
    values = rng.integers(-300, 300, (1, 23, 17)).astype("i2")
    values[0, 3, 4] = -300
    pack = {1: bytes, 5: lzw_encoded, 8: zlib.compress}[compression]
    strips = [pack(values[0, k : k + 6].astype(f"{order}i2").tobytes()) for k in range(0, 23, 6)]
    (tmp_path / "a.tif").write_bytes(tiff(strips, base_tags(23, 17, "i2", compression=compression, nodata=b"-300\0") | {278: (4, [6])}, order))
    found = G.read_geotiff(spark, str(tmp_path / "a.tif"))
    assert found.rdd.getNumPartitions() == 4
    assert collected(found) == expected(values, -300)


@pytest.mark.parametrize("seed", range(3))
def test_lzw_round_trip(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, [3, 40, 256][seed], 40_000).astype(np.uint8).tobytes()
    assert G.lzw(lzw_encoded(data)) == data
    assert G.lzw(lzw_encoded(b"")) == b"" and G.lzw(lzw_encoded(b"a" * 9_000)) == b"a" * 9_000


@pytest.mark.parametrize("big", [False, True])
def test_tiles_bands_and_predictors(spark, tmp_path, big):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(2, 20, 37)).astype("f4")
    values[1, 5, 5] = np.nan

    def tile(band, r, c):
        out = np.zeros((16, 16), "f4")
        own = values[band, r : r + 16, c : c + 16]
        out[: own.shape[0], : own.shape[1]] = own
        return out

    corners = [(r, c) for r in (0, 16) for c in (0, 16, 32)]
    for predictor in (2, 3):
        blocks = []
        for band in (0, 1):
            for r, c in corners:
                own = tile(band, r, c)
                blocks.append(zlib.compress(plane_rows(own, "<") if predictor == 3 else np.diff(own.view("<u4"), axis=1, prepend=np.uint32(0)).tobytes()))
        blocks[2] = b""  # a sparse file leaves it out
        tags = base_tags(20, 37, "f4", 2, 8, predictor, planar=2) | {322: (4, [16]), 323: (4, [16])}
        (tmp_path / f"{predictor}.tif").write_bytes(tiff(blocks, tags, big=big))
        want = expected(values)
        want |= {(r, c, 1): None for r in range(16) for c in range(32, 37)}
        assert collected(G.read_geotiff(spark, str(tmp_path / f"{predictor}.tif"), blocks=5)) == want


def test_chunky_bands(spark, tmp_path):
    values = np.arange(3 * 4 * 5, dtype="u1").reshape(3, 4, 5)
    strips = [np.diff(values[:, k : k + 2].transpose(1, 2, 0), axis=1, prepend=np.uint8(0)).tobytes() for k in (0, 2)]
    (tmp_path / "c.tif").write_bytes(tiff([zlib.compress(s) for s in strips], base_tags(4, 5, "u1", 3, 8, 2) | {278: (4, [2])}))
    assert collected(G.read_geotiff(spark, str(tmp_path / "c.tif"))) == expected(values)


def test_few_rows_touch_few_bytes(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(1, 640, 100))
    strips = [values[0, k : k + 16].tobytes() for k in range(0, 640, 16)]
    data = tiff(strips, base_tags(640, 100, "f8") | {278: (4, [16])})
    path = str(tmp_path / "w.tif")
    with open(path, "wb") as out:
        out.write(data)
    reader = G.GeoTiffReader({"path": path, "rows": "100:130"})
    parts = reader.partitions()
    assert len(parts) == 3  # of 40 strips
    with files.Ranges(path) as read:
        G._directory(read)
        assert read.taken < 2_000
    found = G.read_geotiff(spark, path, rows=(100, 130))
    assert collected(found) == {k: v for k, v in expected(values).items() if 100 <= k[0] < 130}
    spark.conf.set(G.PUSHDOWN, "true")
    try:
        assert G.read_geotiff(spark, path).filter("row >= 100 AND row < 130").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(G.PUSHDOWN)
    pushed = G.PushingReader({"path": path})
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    assert len(list(pushed.pushFilters([GreaterThan(("row",), 99), LessThanOrEqual(("row",), 129)]))) == 2
    assert [p.blocks for p in pushed.partitions()] == [p.blocks for p in parts]


@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_written_and_read_back(spark, tmp_path, predictor):
    grid = Grid(84.0, 27.0, 84.13, 27.5, 0.01)
    cells = grid.cells(spark, z=F.expr("CASE WHEN (row + col) % 7 = 0 THEN NULL ELSE row * 1000 + col / 8 END")).filter("row <> 20")
    path = f"file://{tmp_path}/grid"
    G.write_geotiff(cells, path, grid, "z", "float64", rows_a_file=16, rows_a_strip=5, predictor=predictor)
    assert sorted(os.listdir(tmp_path / "grid")) == ["rows-000000000.tif", "rows-000000016.tif", "rows-000000032.tif", "rows-000000048.tif"]
    first = G.profile(f"{path}/rows-000000000.tif")
    assert (first.width, first.height, first.dtype, first.nodata, first.epsg) == (13, 16, "f8", -9999.0, 4326)
    found = G.read_geotiff(spark, path)
    assert found.rdd.getNumPartitions() == 4 + 4 + 4 + 1
    want = {(r.row, r.col, 1): r.z for r in cells.collect()} | {(20, c, 1): None for c in range(13)}
    assert collected(found) == want
    # written again, on fewer rows a file: nothing of before is left
    G.write_geotiff(cells.filter("row < 16"), path, Grid(84.0, 27.34, 84.13, 27.5, 0.01), "z", "float32", rows_a_file=8)
    assert sorted(os.listdir(tmp_path / "grid")) == ["rows-000000000.tif", "rows-000000008.tif"]


def test_profile_of_a_grid_and_failed_writes(spark, tmp_path):
    grid = Grid(84.0, 27.0, 84.13, 27.5, 0.01)
    path = str(tmp_path / "one")
    G.write_geotiff(grid.cells(spark, value=F.lit(3.5)), path, grid)
    own = G.profile(f"{path}/rows-000000000.tif")
    assert own.matches(grid) and not own.matches(Grid(84.0, 27.0, 84.14, 27.5, 0.01)) and not own.matches(Grid(84.0 + 1e-6, 27.0, 84.13 + 1e-6, 27.5, 0.01))
    before = os.stat(f"{path}/rows-000000000.tif").st_mtime_ns
    broken = grid.cells(spark, value=F.expr("CASE WHEN row = 49 THEN raise_error('broken') ELSE 1.0 END").cast("double"))
    with pytest.raises(Exception, match="broken"):
        G.write_geotiff(broken, path, grid)
    assert os.stat(f"{path}/rows-000000000.tif").st_mtime_ns == before
    with pytest.raises(FileNotFoundError):
        files.listed(str(tmp_path / "nothing.tif"), G.ENDINGS)
    (tmp_path / "bad.tif").write_bytes(b"not a tiff at all")
    with pytest.raises(ValueError):
        G.profile(str(tmp_path / "bad.tif"))
