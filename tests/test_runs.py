"""Whole runs against their parts done one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid
from talweg.operators import hydrology, runs, sampling, stability
from talweg.operators.stability import Soil

SOIL = Soil()
GRID = Grid(84.0, 27.0, 84.6, 27.5, 0.02)  # 25 rows, 30 columns


def terrain(spark, grid, seed=1):
    rng = np.random.default_rng(seed)
    z = 2000 - 30.0 * np.arange(grid.height)[:, None] + rng.normal(size=(grid.height, grid.width)) * 20
    return z, spark.createDataFrame([(r, c, float(z[r, c])) for r in range(grid.height) for c in range(grid.width)], "row int, col int, z double").repartition(3)


def test_units_are_routed_with_their_buffers(spark):
    _, cells = terrain(spark, GRID)
    boxes = spark.createDataFrame([("a", 84.1, 27.1, 84.3, 27.3), ("b", 84.25, 27.2, 84.5, 27.45), ("out", 90.0, 27.0, 91.0, 28.0), ("thin", 84.301, 27.3, 84.305, 27.31), ("big", 84.0, 27.0, 84.6, 27.5)], "slug string, west double, south double, east double, north double")
    maps, statistics, records = runs.run_units(cells, boxes, GRID, SOIL, 0.06, n_draws=40, max_cells=700)
    errors = {r.slug: r.errors for r in records.collect()}
    assert errors == {"a": [], "b": [], "out": ["outside the grid"], "thin": ["no cell lies in the unit"], "big": ["too many cells"]}
    got = {}
    for r in maps.collect():
        got.setdefault(r.slug, {})[r.row, r.col] = (round(r.slope, 9), round(r.sca, 6), r.probability)
    assert set(got) == {"a", "b"}
    dx, dy = GRID.metres()
    for slug, box in (("a", (84.1, 27.1, 84.3, 27.3)), ("b", (84.25, 27.2, 84.5, 27.45))):
        w, s, e, n = box[0] - 0.06, box[1] - 0.06, min(box[2] + 0.06, 84.6), min(box[3] + 0.06, 27.5)
        r0, r1, c0, c1 = round((27.5 - n) / 0.02), round((27.5 - s) / 0.02) - 1, round((w - 84.0) / 0.02), round((e - 84.0) / 0.02) - 1
        alone = cells.filter(f"row BETWEEN {r0} AND {r1} AND col BETWEEN {c0} AND {c1}").select(F.lit(0).alias("grid_id"), (F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "z")
        scored = stability.classes(hydrology.specific_catchment_area(alone, dx, dy), SOIL, stability.draws(SOIL, 40, 0)).collect()
        want = {}
        for r in scored:
            lon, lat = 84.0 + (r.col + c0 + 0.5) * 0.02, 27.5 - (r.row + r0 + 0.5) * 0.02
            if box[0] <= lon <= box[2] and box[1] <= lat <= box[3]:
                want[r.row + r0, r.col + c0] = (round(r.slope, 9), round(r.sca, 6), r.probability)
        assert got[slug] == want
        row = statistics.filter(F.col("slug") == slug).first()
        assert row.cells_in_unit == len(want) and math.isclose(row.buffer_fraction, 1 - len(want) / len(scored))
        assert math.isclose(row.mean_probability, np.mean([p for _, _, p in want.values()]))


def test_if_all_units_fail_that_is_an_error(spark):
    _, cells = terrain(spark, GRID)
    boxes = spark.createDataFrame([("out", 90.0, 27.0, 91.0, 28.0)], "slug string, west double, south double, east double, north double")
    with pytest.raises(RuntimeError, match="out susceptibility: outside the grid"):
        runs.run_units(cells, boxes, GRID, SOIL)


def test_months_have_to_be_twelve(spark):
    good = spark.range(12).select(F.lit("now").alias("scenario"), (F.col("id") + 1).cast("int").alias("band"), F.lit(1.0).alias("mm"))
    assert runs.twelve_months(good, ["scenario"]).count() == 12
    for bad in (good.filter("band < 12"), good.unionByName(good.withColumn("band", F.lit(13))), good.withColumn("band", F.col("band") - 1)):
        with pytest.raises(Exception, match="expected 12 months of"):
            runs.twelve_months(bad, ["scenario"]).collect()


def test_climates_are_scaled_by_the_baseline(spark):
    layers = spark.createDataFrame([(0, k, 0.6 + 0.02 * k, 50.0 + k) for k in range(40)], "row int, col int, slope double, sca double")
    bands = spark.createDataFrame([(s, 0, k, m, (100.0 + k) * f * (2 if m == 7 else 1)) for s, f in (("current", 1.0), ("wet", 3.0)) for k in range(40) for m in range(1, 13)], "scenario string, row int, col int, band int, mm double")
    table = stability.draws(SOIL, 60, 0)
    scored, report = runs.climate_run(layers, bands, table)
    rows = {r.scenario: r for r in report.collect()}
    assert rows["current"].mean_change == 0 and rows["wet"].mean_change > 0 and rows["wet"].mean_probability > rows["current"].mean_probability
    reference = np.median([2 * (100.0 + k) for k in range(40)])
    want = stability.failed_draws(*(np.array(x, float) for x in ([0.6 + 0.02 * k for k in range(40)], [50.0 + k for k in range(40)], [3 * 2 * (100.0 + k) / reference for k in range(40)], [0.0] * 40)), table, 0.0) / 60
    assert [r.probability for r in scored.filter("scenario = 'wet'").orderBy("col").collect()] == want.tolist()


def test_validation_refuses_a_map_elsewhere(spark):
    _, cells = terrain(spark, GRID)
    rng = random.Random(0)
    scored = cells.withColumn("probability", F.when(F.col("row") < 24, F.col("row") / 25))
    inside = [(84.0 + 0.6 * rng.random(), 27.05 + 0.2 * rng.random()) for _ in range(90)]
    points = lambda extra: spark.createDataFrame(inside + [(10.0, 10.0)] * extra, "lon double, lat double")
    row = runs.validation_run(scored, GRID, points(10)).first()
    assert (row.coverage, row.n_presence, row.n_background) == (0.9, 90, 24 * 30) and row.auc > 0.6 and row.verdict in ("good", "fair", "poor")
    half = cells.filter("col < 15").select("row", "col")
    assert runs.validation_run(scored, GRID, points(0), survey=half).first().n_background == 24 * 15
    with pytest.raises(ValueError, match="covers 89 %"):
        runs.validation_run(scored, GRID, points(11))
    with pytest.raises(ValueError, match="no presence lies"):
        runs.validation_run(scored.withColumn("probability", F.lit(None).cast("double")), GRID, points(0))


@pytest.mark.parametrize("seed", range(3))
def test_polygon_cells_by_rows(spark, seed):
    rng = random.Random(seed)
    grid = Grid(0.0, 0.0, 3.0, 2.0, 0.1)
    snap = lambda x: round(x * 20) / 20 if seed == 1 else x  # noqa: E731  vertices on centres and borders of cells

    def ring(n):
        pts = [(snap(rng.uniform(-0.5, 3.5)), snap(rng.uniform(-0.5, 2.5))) for _ in range(n)]
        return [*pts, pts[0]]

    shapes = [(k, [ring(rng.randint(3, 9)) for _ in range(rng.randint(1, 3))]) for k in range(6)] + [(6, [[(1.0, 1.0)]]), (7, []), (0, [ring(4)])]
    table = spark.createDataFrame(shapes, "id int, rings array<array<struct<lon:double,lat:double>>>")
    got = sorted((r.id, r.row, r.col) for r in sampling.polygon_cells(table, grid, ["id"]).collect())
    want = []
    for k, rings in shapes:
        for row in range(grid.height):
            for col in range(grid.width):
                lon, lat = grid.west + (col + 0.5) * grid.res, grid.north - (row + 0.5) * grid.res
                hits = sum((a[1] > lat) != (b[1] > lat) and lon < a[0] + (lat - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for r in rings for a, b in zip(r, r[1:], strict=False))
                want += [(k, row, col)] * (hits % 2)
    assert got == sorted(want)


def test_a_long_outline(spark):
    n, grid = 20_000, Grid(0.0, 0.0, 2.0, 2.0, 0.001)
    turn = 2 * math.pi / n
    ring = [(1 + (0.8 + 0.1 * math.sin(40 * k * turn)) * math.cos(k * turn), 1 + (0.8 + 0.1 * math.sin(40 * k * turn)) * math.sin(k * turn)) for k in range(n)]
    table = spark.createDataFrame([(1, [[*ring, ring[0]]])], "id int, rings array<array<struct<lon:double,lat:double>>>")
    area = sampling.polygon_cells(table, grid, ["id"]).count() * 1e-6
    assert abs(area - math.pi * (0.8**2 + 0.1**2 / 2)) < 1e-3


def test_links_of_dense_squares_stay_few(spark, monkeypatch):
    from talweg.operators import graph

    rng = np.random.default_rng(4)
    n, limit = 4_000, 100.0
    side = limit / 2**0.5
    # two dense squares, a scattered rest, and pairs just within and beyond the limit
    xy = np.concatenate([rng.uniform(0, side, (n, 2)), rng.uniform(0, side, (n, 2)) + [2 * side, 0], rng.uniform(1_000, 3_000, (300, 2)), [[5_000, 0], [5_000 + 99.99, 0], [6_000, 0], [6_000 + 100.01, 0]]])
    lon, lat = xy[:, 0] / (graph.METRES_PER_DEGREE_LON * math.cos(math.radians(28))), xy[:, 1] / graph.METRES_PER_DEGREE_LAT
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))], "asset_id int, lon double, lat double")
    rows = []
    monkeypatch.setattr(graph, "stored", lambda df, real=graph.stored: (rows.append((out := real(df)).count()), out)[1])
    edges = graph.link_edges(points, limit, 28.0)
    assert max(rows) < 10 * len(xy) and edges.count() < 2 * len(xy)
    found = {r.asset_id: r.cluster_id for r in graph.clusters(points, 28.0, limit).collect()}
    root = list(range(len(xy)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    order = np.argsort(xy[:, 0])
    for i, k in enumerate(order):
        later = order[i + 1 : i + 1 + np.searchsorted(xy[order[i + 1 :], 0], xy[k, 0] + limit, "right")]
        for m in later[np.hypot(*(xy[later] - xy[k]).T) <= limit].tolist():
            a, b = sorted((find(int(k)), find(m)))
            root[b] = a
    assert found == {k: find(k) for k in range(len(xy))}


def test_exposure_in_one_call(spark):
    from talweg.functions import scores
    from talweg.functions.gridding import asset_cell
    from talweg.operators import lines, reach

    _, cells = terrain(spark, GRID)
    fine = Grid(84.0, 27.0, 84.06, 27.05, 0.002)  # some 200 m a cell
    _, cells = terrain(spark, fine)
    p = cells.select("row", "col", F.explode(F.array(F.struct(F.lit("current").alias("s"), (F.col("col") / 40).alias("p")), F.struct(F.lit("wet").alias("s"), F.least(F.col("col") / 20, F.lit(1.0)).alias("p")))).alias("x")).select("row", "col", "x.s", "x.p").withColumnRenamed("s", "scenario")
    towns = spark.createDataFrame([(1, 84.011, 27.021, "town", 5000), (2, 84.041, 27.031, "hamlet", None), (3, 90.0, 27.0, "city", 10)], "asset_id int, lon double, lat double, place string, population int")
    way = [(84.001 + 0.002 * k, 27.011) for k in range(25)]
    roads = spark.createDataFrame([(1, way), (2, way[:1])], "asset_id int, coords array<struct<lon:double,lat:double>>")
    assets, summary = runs.exposure_run(towns, roads, cells, p, fine, 700.0, 1_500.0)
    got = {(r.asset, r.scenario): r for r in assets.collect()}
    dx, dy = fine.metres()
    row, col = asset_cell(F.col("lon"), F.col("lat"), fine)
    disc = reach.footprint(towns.filter("asset_id = 1").withColumns({"row": row, "col": col}), dx, dy, fine.height, fine.width)
    one = {r.scenario: r for r in reach.footprint_scores(reach.vertex_scores(disc, reach.reach_edges(disc, cells, dx, dy, 700.0), p, dx * dy)).collect()}
    for s in ("current", "wet"):
        own = got["settlement-1", s]
        assert (own.score, own.on_site, own.reaching, own.people) == (one[s].score, one[s].on_site, one[s].reaching, 5000)
    pieces = lines.pieces(roads, ["asset_id"], 1_500.0).collect()
    assert {k[0] for k in got} == {"settlement-1", "settlement-2", *(f"road-1-{r.piece}" for r in pieces if r.asset_id == 1)} and len(pieces) > 1
    total = {(r.kind, r.scenario): r for r in summary.collect()}
    assert total["settlements", "wet"].n == 2 and total["settlements", "current"].n_exposed_change == 0
    km = sum(got[f"road-1-{r.piece}", "wet"].km for r in pieces)
    assert math.isclose(total["roads", "wet"].km, km) and total["roads", "wet"].km_exposed_change == total["roads", "wet"].km_exposed - total["roads", "current"].km_exposed >= 0
    assert total["roads", "wet"].n_exposed == sum(r.score >= scores.EXPOSED for k, r in got.items() if k[1] == "wet" and r.kind == "roads")
