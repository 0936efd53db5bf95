import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from talweg.functions import mechanics as M
from talweg.functions import scores as S
from talweg.functions import triggers as T
from talweg.functions.gridding import Grid, asset_cell, cell_centre, sample_cell, tile_names
from talweg.operators import fitting, graph, lines, ranking, reach, sampling, stability, validation
from talweg.operators.units import merge_records
from talweg.sources import readers, writers
from talweg.streaming import exposure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_mechanics_on_flat_ground(spark):
    assert one(spark, M.wetness(0.0, 10.0, 0.1)) is None
    assert one(spark, M.factor_of_safety(0.0, 10.0, 0.1, 30.0, 0.1)) == math.inf
    assert one(spark, M.factor_of_safety(0.0, 10.0, 0.1, 30.0, 0.1, k_h=0.2)) is None
    assert one(spark, M.critical_acceleration(0.0, 10.0, 0.1, 30.0, 0.1)) is None
    kc = one(spark, M.critical_acceleration(0.6, 40.0, 0.1, 33.0, 0.001))
    assert abs(one(spark, M.factor_of_safety(0.6, 40.0, 0.1, 33.0, 0.001, k_h=kc)) - 1) < 0.06  # wetness and shaking differ in one term
    rows = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (0.7, None), (0.7, 500.0)], "slope double, sca double")
    out = stability.classes(rows, stability.Soil(), stability.draws(stability.Soil(), 50)).collect()
    assert [(r["probability"] is None, r["class"]) for r in out[:3]] == [(False, 2), (True, None), (True, None)]


def test_draws_come_range_by_range():
    rng = np.random.default_rng(0)
    soil = stability.Soil()
    want = [rng.uniform(*soil.cohesion, 9), rng.uniform(*soil.friction_deg, 9), rng.uniform(*soil.rt, 9)]
    assert np.array_equal(stability.draws(soil, 9), np.stack(want, axis=1))
    assert len(fitting.candidate_soils()) == 48 and len(fitting.candidate_soils((0.0, 1.0, 2.5))) == 144


def test_triggers(spark):
    assert abs(one(spark, T.recharge_multiplier(F.lit(2.0))) - 1) < 1e-12
    z = 1.7
    years = one(spark, T.return_period(F.lit(z)))
    assert abs(one(spark, T.gumbel_factor(F.lit(years))) - z) < 1e-9
    with pytest.raises(Exception, match="over 1 year"):
        one(spark, T.gumbel_factor(F.lit(1.0)))
    with pytest.raises(Exception, match="unknown scenario"):
        one(spark, T.scenario_parts(F.lit("ssp999"))[0])


def test_grid_arithmetic(spark):
    g = Grid(10.0, 20.0, 11.0, 21.0, 0.01)
    assert (g.width, g.height) == (100, 100)
    rows = spark.createDataFrame([(9.995, 21.005), (10.005, 20.995), (11.5, 20.5)], "lon double, lat double")
    a, s = asset_cell(F.col("lon"), F.col("lat"), g), sample_cell(F.col("lon"), F.col("lat"), g)
    got = rows.select(*[c.alias(n) for c, n in zip((*a, *s), "abcd", strict=True)]).collect()
    assert [tuple(r) for r in got] == [(0, 0, None, None), (0, 0, 0, 0), (None, None, None, None)]
    x, y = cell_centre(F.lit(0), F.lit(0), g)
    assert one(spark, F.round(x, 6)) == 10.005 and one(spark, F.round(y, 6)) == 20.995
    assert tile_names(83.5, 27.2, 85.0, 28.1) == ["N27_E083", "N27_E084", "N28_E083", "N28_E084"]
    assert g.cells(spark, v=F.lit(1.0)).count() == 10_000


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_rank_statistics(spark):
    rng = random.Random(0)
    pairs = [(rng.randint(0, 9) / 3, rng.random() < 0.4) for _ in range(300)]
    rows = spark.createDataFrame([(s, y) for s, y in pairs] + [(None, True)], "score double, y boolean")
    assert abs(ranking.auc(rows, []).first().auc - brute_auc(pairs)) < 1e-12
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "score double, y boolean")
    assert ranking.auc(same, []).first().auc == 0.5
    assert ranking.auc(same.filter("y"), []).first().auc is None
    got = {(r.k, r.v): r.before_n for r in ranking.running_counts(spark.createDataFrame([(k, v, v + 1) for k in (0, 1) for v in range(50)], "k int, v int, n int"), ["k"], "v", ["n"], 7).collect()}
    assert got == {(k, v): sum(range(1, v + 1)) for k in (0, 1) for v in range(50)}


def test_planted_parameters_are_found(spark):
    rng = np.random.default_rng(1)
    soils = [stability.Soil((0.0, c), (25.0, 40.0), (0.0001, 0.005), k) for c, k in ((0.2, 0.0), (0.2, 2.5))]
    slope, sca = rng.uniform(0.2, 1.6, 1500), rng.uniform(5, 300, 1500)
    p = stability.failed_draws(slope, sca, np.ones(1500), np.zeros(1500), stability.draws(soils[1], 60), 2.5) / 60
    y = rng.random(1500) < p
    rows = [(float(a), float(b), bool(c), k % 4) for k, (a, b, c) in enumerate(zip(slope, sca, y, strict=True))]
    samples = spark.createDataFrame(rows, "slope double, sca double, y boolean, fold int")
    candidates = fitting.candidate_draws(spark, soils, 40)
    assert fitting.best(fitting.search(samples, candidates)).first().cand_id == 1
    cv = fitting.cross_validate(samples, candidates, 4)
    assert cv.count() == 4 and fitting.summary(cv).first()["mean"] > 0.6
    report = spark.createDataFrame([(0.9, 0.85, 0.6, 0.05)], "in_sample double, random_cv double, spatial_cv double, deviation double")
    assert len(fitting.warnings(report).first().warnings) == 4
    assert fitting.block_folds(spark, 10, 3).groupBy("fold").count().count() == 3


def test_bins_with_ties(spark):
    rows = spark.createDataFrame([(0.0,)] * 5 + [(1.0,)] * 20 + [(2.0,)], "v double")
    edges = validation.quantile_edges(rows, "v").first().edges
    assert edges == [1.0]
    assert one(spark, validation.bin_of(F.lit(1.0), F.lit([1.0]))) == 2


def test_polygons(spark):
    square = [[Row(lon=0.0, lat=0.0), Row(lon=4.0, lat=0.0), Row(lon=4.0, lat=4.0), Row(lon=0.0, lat=4.0), Row(lon=0.0, lat=0.0)]]
    hole = [[Row(lon=1.0, lat=1.0), Row(lon=3.0, lat=1.0), Row(lon=3.0, lat=3.0), Row(lon=1.0, lat=3.0), Row(lon=1.0, lat=1.0)]]
    polygons = spark.createDataFrame([(1, 10, square + hole), (2, 20, hole)], f"id int, code int, rings {sampling.RINGS}")
    burnt = sampling.burn(polygons, Grid(0.0, 0.0, 5.0, 5.0, 1.0), "code", "id")
    got = {(r.row, r.col): r.code for r in burnt.collect()}
    assert got == {(r, c): 20 if 2 <= r <= 3 and 1 <= c <= 2 else 10 for r in range(1, 5) for c in range(4)}
    point = one(spark, sampling.representative_point(F.lit(None).cast(lines.COORDS)))
    assert point.lon is None
    cells = Grid(0.0, 0.0, 5.0, 5.0, 1.0).cells(spark)
    assert sampling.background_points(cells, Grid(0.0, 0.0, 5.0, 5.0, 1.0), 25).count() == 25
    assert sampling.complete(spark.createDataFrame([(1.0,), (None,), (math.nan,), (math.inf,)], "x double"), ["x"]).count() == 1


def test_background_draws_are_exact_and_near_presence(spark):
    grid = Grid(0.0, 0.0, 5.0, 5.0, 0.1)
    cells = grid.cells(spark)
    drawn = sampling.background_points(cells, grid, 100, seed=3)
    places = {(r.lon, r.lat) for r in drawn.collect()}
    assert len(places) == 100 and places == {(r.lon, r.lat) for r in sampling.background_points(cells.repartition(5), grid, 100, seed=3).collect()}
    assert all(0 <= lon <= 5 and 0 <= lat <= 5 for lon, lat in places)
    presence = spark.createDataFrame([(1.05, 3.95), (1.05, 3.95), (0.05, 0.05), (None, 1.0)], "lon double, lat double")
    for within, k in ((0.25, 2), (0.05, 0)):
        near = {(r.row, r.col) for r in sampling.near_presence(cells, grid, presence, within).collect()}
        want = {(r, c) for r in range(grid.height) for c in range(grid.width) for a, b in ((10, 10), (49, 0)) if abs(r - a) <= k and abs(c - b) <= k}
        assert near == want
    assert sampling.near_presence(cells, grid, presence.limit(0)).count() == 0


def test_totals_change_by_key(spark):
    rows = [("a", "current", 5), ("a", "wet", 7), ("b", "current", 2), ("b", "wet", 1), ("c", "wet", 4)]
    totals = spark.createDataFrame(rows, "country string, scenario string, n long")
    got = {(r.country, r.scenario): r.n_change for r in reach.totals_change(totals, ["n"], keys=["country"]).collect()}
    assert got == {("a", "current"): 0, ("a", "wet"): 2, ("b", "current"): 0, ("b", "wet"): -1, ("c", "wet"): None}
    one = totals.filter("country = 'a'").drop("country")
    assert {r.scenario: r.n_change for r in reach.totals_change(one, ["n"]).collect()} == {"current": 0, "wet": 2}
    assert reach.totals_change(totals.limit(0), ["n"]).count() == 0


def test_regional_failure_probability(spark):
    schema = "slope double, sca double, region int, recharge double, note string"
    samples = spark.createDataFrame([(0.7, 50.0, 1, 1.0, "a"), (0.7, 50.0, 2, 1.0, "b"), (0.7, 50.0, None, 1.0, "c"), (None, 50.0, 1, 1.0, None)], schema)
    strong, weak = np.array([[9.0, 45.0, 1e-4]]), np.array([[0.0, 5.0, 1e-2]])
    out = stability.regional_failure_probability(samples, {1: strong}, weak)
    assert [r.probability for r in out.collect()] == [0.0, 1.0, None, None] and out.columns == [*samples.columns, "probability"]
    assert stability.regional_failure_probability(samples.limit(0), {}, weak).count() == 0


def test_lines(spark):
    coords = [Row(lon=84 + 0.001 * k, lat=28.0) for k in range(60)]
    df = spark.createDataFrame([(1, coords), (2, coords[:1]), (3, None)], f"asset_id int, coords {lines.COORDS}")
    step = lines.METRES_PER_DEGREE_LON * math.cos(math.radians(28)) * 0.001
    length = df.select("asset_id", lines.length_m(F.col("coords")).alias("m")).collect()
    assert abs(length[0].m - 59 * step) < 30 and length[1].m == 0
    cut = lines.pieces(df, ["asset_id"]).collect()
    assert sum(len(r.coords) - 1 for r in cut) == 59 and all(a.coords[-1] == b.coords[0] for a, b in zip(cut, cut[1:], strict=False))
    assert {r.asset_id for r in cut} == {1}
    bent = [Row(lon=84.0, lat=28.0), Row(lon=84.001, lat=28.00001), Row(lon=84.002, lat=28.0), Row(lon=84.002, lat=28.01)]
    thin = lines.simplify(spark.createDataFrame([(1, bent), (2, None)], f"k int, coords {lines.COORDS}"), ["k"]).collect()
    assert [len(thin[0].coords), thin[1].coords] == [3, None]
    rng = random.Random(3)
    points = spark.createDataFrame([(0, 84 + rng.random() / 50, 28 + rng.random() / 50) for _ in range(200)], "g int, lon double, lat double")
    hull = lines.hulls(points, "g").first().hull
    ring = [*hull, hull[0]]
    for p in points.collect():
        assert all((b.lon - a.lon) * (p.lat - a.lat) >= (b.lat - a.lat) * (p.lon - a.lon) for a, b in zip(ring, ring[1:], strict=False))


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    points = [(i, f"p{i}" if i % 2 else None, 84 + rng.random() / 20, 28 + rng.random() / 20) for i in range(250)]
    df = spark.createDataFrame(points, "asset_id int, name string, lon double, lat double")
    x = lambda p: (p[2] * S.METRES_PER_DEGREE_LON * math.cos(math.radians(28)), p[3] * S.METRES_PER_DEGREE_LAT)
    root = {p[0]: p[0] for p in points}
    for _ in range(60):
        for a in points:
            for b in points:
                if math.dist(x(a), x(b)) <= 250 and root[b[0]] != root[a[0]]:
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    clustered = graph.clusters(df, 28.0, 250.0)
    assert {r.asset_id: r.cluster_id for r in clustered.collect()} == root
    top = graph.largest_clusters(clustered).collect()
    sizes = sorted((list(root.values()).count(k) for k in set(root.values())), reverse=True)
    assert sorted((r["size"] for r in top), reverse=True) == [s for s in sizes if s > 1][:5]
    assert all(len(r.hull) >= 4 for r in top)


def test_cone_reaches_its_foot(spark):
    n = 41
    rows = [(r, c, max(0.0, 600 * (1 - math.hypot(r - 20, c - 20) / 18)), 0.5) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(rows, "row int, col int, z double, p double")
    targets = spark.createDataFrame([(1, 0, 20, 1), (2, 0, 20, 20), (3, 0, 99, 99)], "asset_id int, vertex int, row int, col int")
    edges = reach.reach_edges(targets, cells, 30.0, 30.0, 1000.0)
    assert {r.asset_id for r in edges.select("asset_id").distinct().collect()} == {1}
    assert all(r.relief / r.dist > math.tan(math.radians(18)) for r in edges.collect())
    p = cells.select("row", "col", F.lit("current").alias("scenario"), "p")
    score = reach.reach_scores(edges, p, 900.0).first()
    assert score.reaching == pytest.approx(0.5) and score.delivering_m2 == pytest.approx(450.0 * score.n_sources)
    uneven = p.withColumn("p", F.when(F.col("row").between(18, 22), 0.9).otherwise(0.1))
    assert reach.worst_sector(edges, uneven).first().sector == "E"
    none = edges.select("asset_id", "row", "col").limit(0).withColumn("dependence", F.lit(1.0))
    weak = reach.reach_edges(targets, cells, 30.0, 30.0, 1000.0, dependence=none)
    assert weak.agg(F.sum("w")).first()[0] == pytest.approx(0.2 * edges.agg(F.sum("w")).first()[0])


def test_bands_and_octants(spark):
    got = [one(spark, S.band(F.lit(x))) for x in (0.0, 0.02, 0.0799, 0.08, 0.2, 0.4, 5.0)]
    assert got == ["very low", "low", "low", "moderate", "high", "very high", "very high"]
    assert [one(spark, S.octant(F.lit(x))) for x in (0.0, 22.5, 67.5, 350.0)] == [0, 0, 2, 0]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,Latitude,LONGITUDE,country_name\n1,28.1,84.2,Nepal\n2,x,84,Nepal\n3,27.0,83.0,India\n")
    assert [tuple(r) for r in readers.csv_points(spark, str(tmp_path / "a.csv"), countries=["NEPAL"]).collect()] == [(84.2, 28.1)]
    assert readers.csv_points(spark, str(tmp_path / "a.csv"), (80.0, 26.0, 83.0, 27.0)).count() == 1
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none of the columns"):
        readers.csv_points(spark, str(tmp_path / "b.csv"))
    box = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    collection = {
        "features": [
            {"properties": {"name": "One", "admin": "X"}, "geometry": {"type": "Polygon", "coordinates": [box]}},
            {"properties": {"NAME_1": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box], [[[5, 5], [6, 5], [6, 6.5], [5, 5]]]]}},
            {"properties": {}, "geometry": {"type": "Point", "coordinates": [84.5, -28.25, 10]}},
        ]
    }
    (tmp_path / "g.json").write_text(json.dumps(collection, indent=1))
    units = {r.name: r for r in readers.geojson_units(spark, str(tmp_path / "g.json")).collect()}
    assert (units["One"].country, units["One"].east, len(units["One"].rings)) == ("X", 2.0, 1)
    assert (units["Two"].north, len(units["Two"].rings), units["Two"].rings[1][1].lon) == (6.5, 2, 6.0)
    points = sorted(tuple(r) for r in readers.geojson_points(spark, str(tmp_path / "g.json")).collect())
    assert points[0] == (0.8, 0.4) and (84.5, -28.25) in points
    osm = {"elements": [{"type": "node", "id": 1, "lat": 28.0, "lon": 84.0, "tags": {"place": "town", "name": "A", "population": "1,200"}}, {"type": "node", "id": 2, "lat": 28.0, "lon": 84.0, "tags": {"place": "isle"}}, {"type": "way", "id": 3, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}, {"type": "way", "id": 4, "tags": {"highway": "primary"}, "geometry": [{"lat": 1, "lon": 2}]}]}
    (tmp_path / "o.json").write_text(json.dumps(osm))
    assert [tuple(r) for r in readers.overpass_settlements(spark, str(tmp_path / "o.json")).collect()] == [("A", 84.0, 28.0, "town", 1200)]
    make = lambda: readers.overpass_roads(spark, str(tmp_path / "o.json"), ["primary"])
    cache = f"file://{tmp_path}/roads"
    assert readers.cached(spark, cache, make, ["primary", "track"]).count() == 1
    assert readers.cached(spark, cache, lambda: 1 / 0, ["track"]).count() == 0
    line = ["1", "Place", "", "", "28.5", "84.5", "P", "PPLA", "NP", *[""] * 5, "0", *[""] * 4]
    (tmp_path / "n.tsv").write_text("\t".join(line) + "\n" + "\t".join([*line[:6], "H", *line[7:]]) + "\n")
    assert [tuple(r) for r in readers.geonames(spark, str(tmp_path / "n.tsv")).collect()] == [("Place", 84.5, 28.5, "city", None)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 84.1234567, 28.0, "a")], "id int, lon double, lat double, name string")
    feature = json.loads(writers.point_features(rows, ["id", "name"]).first().feature)
    assert feature["geometry"]["coordinates"] == [84.12346, 28.0] and feature["properties"] == {"id": 1, "name": "a"}
    scored = spark.createDataFrame([(1, "current", 0.2, 0.1, 0.2), (1, "later", 0.3, 0.1, 0.3)], "asset_id int, scenario string, score double, on_site double, reaching double")
    assert json.loads(writers.records(scored).first().record)["scenarios"]["later"]["score"] == 0.3
    assert "JSON.parse" in writers.page_data("x", '{"a": "</script>"}')
    cells = Grid(0.0, 0.0, 3.0, 2.0, 1.0).cells(spark, v=F.lit(0.5))
    image = writers.png(cells.filter("col < 2"), "v", 2, 3)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and len(zlib.decompress(image[image.index(b"IDAT") + 4 : -16])) == 2 * 13
    writers.write_layer(cells, f"{tmp_path}/layer")
    assert spark.read.parquet(f"{tmp_path}/layer").count() == 6
    products = spark.createDataFrame([("risk", "a", "osm"), ("risk", "b", None)], "kind string, path string, source string")
    assert json.loads(writers.manifest(products, {"res": 1}))["sources"] == ["osm"]
    records = spark.createDataFrame([("u", {"a": "1", "b": "1"}, 1), ("u", {"a": "2"}, 2), ("u", None, 3)], "slug string, payload map<string,string>, written int")
    assert merge_records(records).first().payload == {"a": "2", "b": "1"}


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0, "current", 0.1), (0, 1, "current", 0.01)], "row int, col int, scenario string, score double")
    new, out, marks = (f"{tmp_path}/{x}" for x in ("new", "out", "marks"))
    rows = lambda *r: spark.createDataFrame(r, "asset_id long, name string, row int, col int, seen timestamp")
    from datetime import datetime

    rows((1, "a", 0, 0, datetime(2024, 1, 1)), (2, "b", 5, 5, datetime(2024, 1, 1))).write.json(new)
    exposure.write_scores(exposure.scored_stream(spark, new, scores), out, marks).awaitTermination()
    assert [(r.asset_id, r.band) for r in spark.read.parquet(out).collect()] == [(1, "moderate")]
    rows((3, "c", 0, 1, datetime(2024, 1, 9))).write.mode("append").json(new)
    exposure.write_scores(exposure.scored_stream(spark, new, scores), out, marks).awaitTermination()
    assert sorted(r.asset_id for r in spark.read.parquet(out).collect()) == [1, 3]
    counts = exposure.exposed_per_window(exposure.scored_stream(spark, new, scores))
    query = counts.writeStream.format("memory").queryName("per_window").outputMode("append").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.n_exposed) for r in spark.table("per_window").collect()] == [(1, 1)]
    p = spark.createDataFrame([(0, 0, "current", 0.2)], "row int, col int, scenario string, p double")
    e = spark.createDataFrame([(0, 1, 0, 0, 1.0)], "to_row int, to_col int, row int, col int, w double")
    assert exposure.cell_scores(e, p).count() == 1
