"""Shapefiles and large JSON files, cut anywhere."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.sources import json_arrays as J
from talweg.sources import readers, writers
from talweg.sources import shapefile as S


def brute_objects(text):
    """Objects in the arrays of the root object, by a parser."""
    root = json.loads(text)
    return [o for v in root.values() if isinstance(v, list) for o in v if isinstance(o, dict)]


def awkward(rng, n):
    words = ['a "quoted" {brace', "back\\slash\\", "]}", "é漢", "\\", '\\"', "", "x" * 300, "line\nbreak"]
    one = lambda: {"type": "Feature", "properties": {"name": rng.choice(words), "deep": [{"a": rng.choice(words)}, [1, [2]]]}, "geometry": {"type": "Point", "coordinates": [rng.random(), rng.random()]}}
    return json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "x{"}}, "bbox": [1, 2], "features": [one() for _ in range(n)]}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1_000_000])
def test_objects_from_ranges_of_any_size(size):
    rng = random.Random(size)
    text = awkward(rng, 6)
    data = text.encode()
    read = lambda start, n: data[start : start + n]
    state, depth, found = J.OUTSIDE, 0, []
    for start in range(0, len(data), size):
        stop = min(len(data), start + size)
        found += J.objects_in(read, start, stop, len(data), state, depth, 2)
        change, end = J.scanned(np.frombuffer(data[start:stop], np.uint8), state)
        state, depth = end, depth + int(change.sum())
    assert (state, depth) == (J.OUTSIDE, 0)
    assert [json.loads(o) for o in found] == brute_objects(text)


def test_objects_by_tasks(spark, tmp_path):
    rng = random.Random(9)
    texts = [awkward(rng, 40), awkward(rng, 1), '{"features": []}', ""]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.geojson").write_text(text, encoding="utf-8")
    want = sorted(json.dumps(o, sort_keys=True) for t in texts if t for o in brute_objects(t))
    for size in (100, 4_000, J.RANGE_BYTES):
        found = J.objects(spark, f"file://{tmp_path}", range_bytes=size)
        assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in found.collect()) == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col("id") / 1e3, F.lit(27.5)).alias("coordinates")).alias("geometry"), F.struct("id").alias("properties"))).alias("feature"))
    writers.write_features(rows.coalesce(1), f"{tmp_path}/c")
    found = J.objects(spark, f"{tmp_path}/c", range_bytes=1 << 17)
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 3 and sum(sizes) == 20_000
    points = readers.geojson_points(spark, f"{tmp_path}/c")
    assert points.count() == 20_000 and points.agg(F.max("lon")).first()[0] == 19.999
    writers.write_features(rows.limit(0), f"{tmp_path}/none")
    assert readers.features(spark, f"{tmp_path}/none").count() == 0


def record(kind, body):
    return struct.pack("<i", kind) + body


def layer(path, kind, bodies, table=None, prj=None):
    at, index, shapes = 50, b"", b""
    for k, body in enumerate(bodies):
        shapes += struct.pack(">2i", k + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, at) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (path / "l.shp").write_bytes(head + shapes)
    (path / "l.shx").write_bytes(head + index)
    if table:
        names, rows = table
        fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([12, 0]) + bytes(14) for n in names)
        data = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, len(rows), 33 + len(fields), 1 + 12 * len(names)) + fields + b"\r"
        (path / "l.dbf").write_bytes(data + b"".join(b" " + b"".join(v.encode("latin-1").ljust(12) for v in r) for r in rows))
    if prj:
        (path / "l.prj").write_text(prj)


def points(*xy):
    return np.array(xy, "<f8").tobytes()


def poly(kind, *parts):
    xy = np.array([p for part in parts for p in part])
    starts = np.cumsum([0] + [len(p) for p in parts])[:-1].astype("<i4").tobytes()
    return record(kind, struct.pack("<4d2i", *xy.min(0), *xy.max(0), len(parts), len(xy)) + starts + xy.astype("<f8").tobytes())


def read(spark, path, **options):
    rows = S.read_shapefile(spark, str(path / "l.shp"), **options).orderBy("record").collect()
    return [(r.record, r.kind, r.parts and [[(p.lon, p.lat) for p in part] for part in r.parts], r.properties) for r in rows]


def test_shapes_of_all_kinds(spark, tmp_path):
    ring, hole, line = [(0, 0), (0, 4), (4, 4), (0, 0)], [(1, 1), (2, 1), (1, 1)], [(84.0, 27.0), (84.5, 27.5)]
    bodies = [record(1, points((84, 27))), record(0, b""), poly(5, ring, hole), poly(3, line), poly(3, line, ring), record(8, struct.pack("<4di", 1, 2, 3, 4, 2) + points((1, 2), (3, 4))), record(11, points((5, 6)) + struct.pack("<2d", 7, 8)), poly(13, line) + struct.pack("<4d", 1, 2, 1, 2)]
    layer(tmp_path, 0, bodies, (["name", "type"], [("Ümlaut", ""), ("b", "Road")]))
    floats = lambda part: [(float(a), float(b)) for a, b in part]
    want = [
        (0, "Point", [[(84.0, 27.0)]], {"name": "Ümlaut"}), (1, None, None, {"name": "b", "type": "Road"}), (2, "Polygon", [floats(ring), floats(hole)], {}),
        (3, "LineString", [line], {}), (4, "MultiLineString", [line, floats(ring)], {}), (5, "MultiPoint", [[(1.0, 2.0), (3.0, 4.0)]], {}), (6, "Point", [[(5.0, 6.0)]], {}), (7, "LineString", [line], {}),
    ]
    assert read(spark, tmp_path) == want
    assert read(spark, tmp_path, records=3) == want
    assert S.read_shapefile(spark, str(tmp_path / "l.shp"), records=3).rdd.getNumPartitions() == 3
    assert [r[0] for r in read(spark, tmp_path, box=(84.4, 27.4, 90.0, 30.0))] == [3, 4, 7]  # by their boxes
    roads = readers.line_roads(spark, str(tmp_path / "l.shp"))
    assert [(r.name, r.highway, len(r.coords)) for r in roads.collect()] == [("", "road", 2)] * 2
    own = readers.inventory_points(spark, str(tmp_path / "l.shp"), (80.0, 20.0, 90.0, 30.0)).collect()
    assert sorted((r.lon, r.lat) for r in own) == [(84.0, 27.0), (84.25, 27.25), (84.25, 27.25)]


def test_projected_layers_and_empty_ones(spark, tmp_path):
    layer(tmp_path, 1, [], prj='GEOGCS["WGS 84"]')
    assert read(spark, tmp_path) == []
    layer(tmp_path, 1, [record(1, points((1, 2)))], prj='PROJCS["UTM"]')
    with pytest.raises(Exception, match="projected"):
        read(spark, tmp_path)
    with pytest.raises(ValueError, match="only CSV"):
        readers.inventory_points(spark, "x.gpkg")


def test_written_and_read_back(spark, tmp_path):
    rows = spark.range(500).select(F.col("id"), F.array(F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 2), lambda k: F.struct((F.col("id") / 8 + k).alias("lon"), (k / 4).alias("lat")))).alias("parts"), F.create_map(F.lit("name"), F.concat(F.lit("é"), F.col("id").cast("string"))).alias("properties"))
    S.write_shapefile(rows.repartition(3), f"file://{tmp_path}/lines", S.LINE, ["name"])
    found = S.read_shapefile(spark, f"file://{tmp_path}/lines", records=100).select("parts", "properties")
    key = lambda r: r.properties["name"]
    assert sorted(found.collect(), key=key) == sorted(rows.select("parts", "properties").collect(), key=key)
