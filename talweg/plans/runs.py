"""Queries on formats, walks and whole runs; what is read from a format is first written from the driver tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid
from talweg.operators import fitting, runs, walks
from talweg.operators.stability import Soil
from talweg.plans import views as V
from talweg.plans.mechanics import BLOCKS, CANDIDATE_ROWS, FOLDS, PLACED, _auc_cte, _candidates, _gumbel, fs_sql
from talweg.plans.terrain import r6
from talweg.plans.views import CELLS, DRAW_ROWS, DRAWS, SAMPLES, SCENARIO_ROWS, SETTLEMENTS, TRACKS, UNITS, WIDTH
from talweg.session import shared_dir
from talweg.sources import geotiff, json_arrays, readers, shapefile, writers


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/talweg-{uuid.uuid4().hex}"


def _grid(spark, sf_dir, res: float = 0.12, west: float = 80.0, north: float = 30.0) -> Grid:
    """The grid of the cells, ``WIDTH`` columns wide."""
    height = -(-V.table(spark, sf_dir, "orders").count() // WIDTH)
    return Grid(west, north - height * res, west + WIDTH * res, north, res)


# --- formats -----------------------------------------------------------------------------------------------------


def q_geotiff(spark, sf_dir):
    """The heights as GeoTIFF files of 64 rows, read back by strips."""
    path, grid = _folder(spark), _grid(spark, sf_dir)
    geotiff.write_geotiff(V.cells(spark, sf_dir), path, grid, "z", "float64", rows_a_file=64, rows_a_strip=16)
    return geotiff.read_geotiff(spark, path).filter("value IS NOT NULL").select("row", "col", r6("value", "z"))


GEOTIFF_SQL = f"WITH {CELLS} SELECT row, col, round(z, 6) AS z FROM cells"


def _line_rows(lines):
    mean = lambda c: F.aggregate(F.transform("coords", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x) / F.size("coords")
    return lines.select(F.col("asset_id").cast("long").alias("asset_id"), F.size("coords").alias("n"), r6(mean("lon"), "lon"), r6(mean("lat"), "lat"))


def q_shapefile_lines(spark, sf_dir):
    """The users' tracks as line layers, read back by ranges of records."""
    path = _folder(spark)
    shapes = V.tracks(spark, sf_dir).select(F.array("coords").alias("parts"), F.create_map(F.lit("asset_id"), F.col("asset_id").cast("string")).alias("properties"))
    shapefile.write_shapefile(shapes, path, shapefile.LINE, ["asset_id"])
    found = shapefile.read_shapefile(spark, path, records=500).filter("kind = 'LineString'")
    return _line_rows(found.select(F.element_at("properties", "asset_id").alias("asset_id"), F.col("parts")[0].alias("coords")))


def q_geojson_lines(spark, sf_dir):
    """The users' tracks as GeoJSON collections, read back by ranges of bytes."""
    path = _folder(spark)
    writers.write_features(writers.line_features(V.tracks(spark, sf_dir), ["asset_id"]), path)
    text = json_arrays.objects(spark, path, range_bytes=1 << 16)
    kind = "type string, properties map<string,string>, geometry struct<type:string, coordinates:array<array<double>>>"
    each = text.select(F.from_json("value", kind).alias("f")).filter("f.type = 'Feature'")
    coords = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return _line_rows(each.select(F.element_at("f.properties", "asset_id").alias("asset_id"), coords.alias("coords")))


LINES_SQL = f"WITH {TRACKS} SELECT asset_id, CAST(count(*) AS INT) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM tracks GROUP BY asset_id"


def q_vector_points(spark, sf_dir):
    """A point of each line: the mean of its vertices, from the shapefile, counted by hundredths of a degree."""
    path = _folder(spark)
    shapes = V.tracks(spark, sf_dir).select(F.array("coords").alias("parts"), F.create_map(F.lit("asset_id"), F.col("asset_id").cast("string")).alias("properties"))
    shapefile.write_shapefile(shapes, path, shapefile.LINE, ["asset_id"])
    points = readers.shapefile_points(spark, path)
    return points.groupBy(F.floor(F.col("lon") * 100 + 1e-7).alias("x"), F.floor(F.col("lat") * 100 + 1e-7).alias("y")).agg(F.count(F.lit(1)).alias("n"))


POINTS_SQL = f"""WITH {TRACKS}, means AS (SELECT asset_id, avg(lon) AS lon, avg(lat) AS lat FROM tracks GROUP BY asset_id)
SELECT CAST(floor(lon * 100 + 1e-7) AS BIGINT) AS x, CAST(floor(lat * 100 + 1e-7) AS BIGINT) AS y, count(*) AS n FROM means GROUP BY ALL"""

# --- walks -------------------------------------------------------------------------------------------------------

LOWEST = """steps AS (SELECT * FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) AS s(dr, dc)),
around AS (
  SELECT a.row, a.col, a.z, b.row AS to_row, b.col AS to_col, b.z AS to_z, row_number() OVER (PARTITION BY a.row, a.col ORDER BY b.z, b.row, b.col) AS nth
  FROM cells a CROSS JOIN steps JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc),
low AS (SELECT row, col, to_row, to_col FROM around WHERE nth = 1 AND to_z < z)"""


def q_steepest_walk(spark, sf_dir):
    """The walks down from every settlement."""
    starts = V.settlements(spark, sf_dir).select(F.col("asset_id").alias("walk"), F.lit(0).alias("grid_id"), "row", "col")
    return walks.walks(walks.receivers(V.cells(spark, sf_dir)), starts).select("walk", "step", "row", "col")


WALK_SQL = f"""WITH RECURSIVE {CELLS}, {SETTLEMENTS}, {LOWEST}, walk AS (
  SELECT asset_id AS walk, 0 AS step, row, col FROM settlements
  UNION ALL SELECT walk, step + 1, to_row, to_col FROM walk w JOIN low l ON w.row = l.row AND w.col = l.col)
SELECT walk, step, row, col FROM walk"""


def q_walk_ends(spark, sf_dir):
    """How many cells' walks end in each cell that has no lower neighbour."""
    return walks.ends(walks.receivers(V.cells(spark, sf_dir))).groupBy(F.col("end_row").alias("row"), F.col("end_col").alias("col")).agg(F.count(F.lit(1)).alias("n_cells"))


ENDS_SQL = f"""WITH RECURSIVE {CELLS}, {LOWEST}, walk AS (
  SELECT row AS r, col AS c, to_row AS row, to_col AS col FROM low
  UNION ALL SELECT r, c, to_row, to_col FROM walk w JOIN low l ON w.row = l.row AND w.col = l.col)
SELECT w.row, w.col, count(*) AS n_cells FROM walk w ANTI JOIN low l ON w.row = l.row AND w.col = l.col GROUP BY ALL"""

# --- runs --------------------------------------------------------------------------------------------------------

SOIL = Soil(cohesion=(0.01, 0.238), friction_deg=(24.0, 43.0), rt=(0.0002, 0.00419))
BUFFER = 0.25


def _boxes(spark, sf_dir):
    return V.units(spark, sf_dir).select(F.col("id").cast("string").alias("slug"), "west", "south", "east", "north")


def q_unit_windows(spark, sf_dir):
    """How many cells of each unit's buffered window there are, and how many lie in the unit itself."""
    grid = _grid(spark, sf_dir)
    windows = runs.unit_windows(_boxes(spark, sf_dir), grid, BUFFER)
    held = runs.windowed_cells(V.cells(spark, sf_dir), windows, grid).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"))
    met = windows.join(held, F.col("slug") == F.col("grid_id"), "left")
    return met.select("slug", F.coalesce("n", F.lit(0)).cast("long").alias("n_window"), F.coalesce("n_own", F.lit(0)).cast("long").alias("n_own"))


UNIT_WINDOWS_SQL = f"""WITH {CELLS}, {UNITS}, height AS (SELECT CAST(ceil(count(*) / {WIDTH}) AS INT) AS h FROM cells),
box AS (SELECT id, west, south, east, north, h, greatest(west - {BUFFER!r}, 80e0) AS bw, greatest(south - {BUFFER!r}, 30e0 - h * 12e-2) AS bs,
               least(east + {BUFFER!r}, 80e0 + {WIDTH} * 12e-2) AS be, least(north + {BUFFER!r}, 30e0) AS bn FROM units CROSS JOIN height),
win AS (SELECT *, least(greatest(round((30e0 - bn) / 12e-2), 0), h) AS r0, least(greatest(round((30e0 - bs) / 12e-2), 0), h) - 1 AS r1,
               least(greatest(round((bw - 80e0) / 12e-2), 0), {WIDTH}) AS c0, least(greatest(round((be - 80e0) / 12e-2), 0), {WIDTH}) - 1 AS c1 FROM box)
SELECT CAST(id AS VARCHAR) AS slug, count(c.row) AS n_window,
       count(c.row) FILTER (WHERE 80e0 + (c.col + 5e-1) * 12e-2 BETWEEN west AND east AND 30e0 - (c.row + 5e-1) * 12e-2 BETWEEN south AND north) AS n_own
FROM win LEFT JOIN cells c ON c.row BETWEEN r0 AND r1 AND c.col BETWEEN c0 AND c1 GROUP BY id"""


def q_unit_run(spark, sf_dir):
    """Statistics of all units, routed with their buffers; a test holds them against routing each unit alone."""
    _, statistics, records = runs.run_units(V.cells(spark, sf_dir), _boxes(spark, sf_dir), _grid(spark, sf_dir), SOIL, BUFFER, n_draws=20)
    met = records.select("slug", F.array_join("errors", "; ").alias("errors")).join(statistics, "slug", "left")
    return met.select("slug", "errors", "cells_in_unit", *[r6(c, c) for c in ("buffer_fraction", "mean_probability", "unstable_area_pct", "p90_probability")])


HAZARD_PERIODS, HAZARD_PGA = [10.0, 100.0], [0.1, 0.35]


def q_hazard_suite(spark, sf_dir):
    """Mean probability and share over one half under each trigger scenario."""
    scenarios = runs.hazard_scenarios(spark, HAZARD_PERIODS, HAZARD_PGA)
    scored = runs.hazard_suite(V.samples(spark, sf_dir).select("id", "slope", "sca"), scenarios, np.array(DRAWS))
    summed = scored.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean"), F.avg(F.when(F.col("probability") > 0.5, 100.0).otherwise(0.0)).alias("over_half"))
    return summed.join(scenarios.select("scenario", "description"), "scenario").select("scenario", "description", "n", r6("mean", "mean"), r6("over_half", "over_half"))


_HAZARD = [f"('rp{y:g}', 'rainfall, {y:g}-year return period', (1 + 3e-1 * {_gumbel(repr(y))}) / (1 + 3e-1 * {_gumbel('2e0')}), 0e0)" for y in HAZARD_PERIODS]
_HAZARD += [f"('pga{a:g}', 'earthquake, PGA {a:.2f} g', 1e0, 5e-1 * {a!r}::DOUBLE)" for a in HAZARD_PGA]
HAZARD_SQL = f"""WITH {SAMPLES}, {DRAW_ROWS}, hazard AS (SELECT * FROM (VALUES {', '.join(_HAZARD)}) AS h(scenario, description, m, k)),
prob AS (SELECT id, scenario, description, count(*) FILTER (WHERE {fs_sql(r='(r * m)', k='k')} < 1) / 20e0 AS probability FROM samples CROSS JOIN hazard CROSS JOIN draws GROUP BY ALL)
SELECT scenario, description, count(*) AS n, round(avg(probability), 6) AS mean, round(avg(CASE WHEN probability > 5e-1 THEN 1e2 ELSE 0e0 END), 6) AS over_half FROM prob GROUP BY ALL"""

MONTHS = "((id * 31 + band * 17) % 300 - 5) * multiplier"


def _monthly(spark, sf_dir):
    scenarios = spark.createDataFrame(V.SCENARIOS, "scenario string, multiplier double")
    each = V.samples(spark, sf_dir).select("id").crossJoin(F.broadcast(scenarios))  # three rows
    return each.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(12)))).select("scenario", "id", "band", F.expr(MONTHS).alias("mm"))


def q_climate_run(spark, sf_dir):
    """The report of a run over the present and two future climates."""
    layers = V.samples(spark, sf_dir).select("id", "slope", "sca")
    _, report = runs.climate_run(layers, _monthly(spark, sf_dir), np.array(DRAWS), cell=("id",))
    return report.select("scenario", *[r6(c, c) for c in ("mean_probability", "unstable_area_pct", "mean_change", "pct_more_likely")])


CLIMATE_SQL = f"""WITH {SAMPLES}, {DRAW_ROWS}, {SCENARIO_ROWS},
rain AS (SELECT id, slope, sca, scenario, max(CASE WHEN mm >= 0 THEN mm END) AS mm FROM (
  SELECT id, slope, sca, scenario, {MONTHS} AS mm FROM samples CROSS JOIN scenarios CROSS JOIN (SELECT unnest(range(1, 13)) AS band)) GROUP BY ALL),
ref AS (SELECT coalesce(nullif(median(CASE WHEN mm > 0 THEN mm END), 0), nullif(avg(mm), 0), 1e0) AS reference FROM rain WHERE scenario = 'current'),
prob AS (SELECT id, scenario, count(*) FILTER (WHERE {fs_sql(r='(r * (mm / reference))')} < 1) / 20e0 AS p FROM rain CROSS JOIN ref CROSS JOIN draws GROUP BY id, scenario),
met AS (SELECT a.scenario, a.p, a.p - b.p AS change FROM prob a JOIN prob b ON a.id = b.id AND b.scenario = 'current')
SELECT scenario, round(avg(p), 6) AS mean_probability, round(avg(CASE WHEN p > 5e-1 THEN 1e2 ELSE 0e0 END), 6) AS unstable_area_pct,
       round(avg(change), 6) AS mean_change, round(1e2 * count(*) FILTER (WHERE change > 1e-2) / count(*), 6) AS pct_more_likely FROM met GROUP BY scenario"""


def q_validation_run(spark, sf_dir):
    """The map of p against the cells of failed orders; so many that the background is the whole map."""
    grid = _grid(spark, sf_dir)
    failed = V.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.expr(f"o_orderkey div {WIDTH}").alias("row"), F.expr(f"o_orderkey % {WIDTH}").alias("col"))
    presence = failed.select((F.lit(grid.west) + (F.col("col") + 0.5) * grid.res).alias("lon"), (F.lit(grid.north) - (F.col("row") + 0.5) * grid.res).alias("lat"))
    out = runs.validation_run(V.cells(spark, sf_dir), grid, presence, "p")
    return out.select("n_presence", "n_background", "monotone", "verdict", *[r6(c, c) for c in ("coverage", "auc", "top_presence_percent", "top_area_percent", "efficiency")])


VALIDATION_SQL = f"""WITH {CELLS}, hit AS (SELECT p FROM cells c JOIN orders o ON o.o_orderkey = CAST(c.row AS BIGINT) * {WIDTH} + c.col WHERE o_orderstatus = 'F'),
edges AS (SELECT quantile_cont(p, [2e-1, 4e-1, 6e-1, 8e-1]) AS e FROM cells WHERE p > 0),
pooled AS (SELECT p, true AS y FROM hit UNION ALL SELECT p, false FROM cells),
binned AS (SELECT y, len(list_filter(list_distinct(e), lambda x: x <= p)) + 1 AS bin FROM pooled CROSS JOIN edges),
ratios AS (SELECT bin, 1e2 * count(*) FILTER (WHERE NOT y) / (SELECT count(*) FROM cells) AS area, 1e2 * count(*) FILTER (WHERE y) / (SELECT count(*) FROM hit) AS presence FROM binned GROUP BY bin),
steps AS (SELECT *, presence / area < lag(presence / area) OVER (ORDER BY bin) - 1e-9 AS falls, row_number() OVER (ORDER BY bin DESC) AS place FROM ratios),
one AS (SELECT NOT coalesce(bool_or(falls), false) AS monotone, sum(presence) FILTER (WHERE place <= 2) AS top, sum(area) FILTER (WHERE place <= 2) AS area FROM steps),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM pooled),
t AS (SELECT count(*) FILTER (WHERE y) AS np, count(*) FILTER (WHERE NOT y) AS nn, sum(rk) FILTER (WHERE y) AS w FROM r),
a AS (SELECT np, nn, (w - np * (np + 1) / 2e0) / (CAST(np AS DOUBLE) * nn) AS auc FROM t)
SELECT np AS n_presence, nn AS n_background, monotone,
       CASE WHEN auc >= 75e-2 AND monotone AND top / area >= 15e-1 THEN 'good' WHEN auc >= 65e-2 AND top / area >= 15e-1 THEN 'fair' ELSE 'poor' END AS verdict,
       1e0 AS coverage, round(auc, 6) AS auc, round(top, 6) AS top_presence_percent, round(area, 6) AS top_area_percent, round(top / area, 6) AS efficiency FROM one CROSS JOIN a"""

N_BLOCKS = 16


def q_cv_permuted(spark, sf_dir):
    """Cross-validation over squares dealt to folds by a permutation."""
    rows = fitting.numbered_blocks(V.samples(spark, sf_dir), 0.5)
    folded = rows.join(F.broadcast(fitting.block_folds(spark, N_BLOCKS, FOLDS)), "block")  # a row for each square
    out = fitting.cross_validate(folded, _candidates(spark), FOLDS)
    return out.select("fold", "cand_id", r6("train_auc", "train_auc"), r6("test_auc", "test_auc"))


_ORDER = np.random.default_rng(0).permutation(N_BLOCKS).tolist()
PERMUTED_SQL = f"""WITH {SAMPLES}, {PLACED}, {BLOCKS}, {CANDIDATE_ROWS},
dealt AS (SELECT * FROM (VALUES {', '.join(f'({b}, {k % FOLDS})' for k, b in enumerate(_ORDER))}) AS d(number, own)),
scored AS (SELECT cand_id, id, y, own AS fold, count(*) FILTER (WHERE {fs_sql()} < 1) / 4e0 AS score FROM folded JOIN dealt ON block = number CROSS JOIN cand GROUP BY ALL),
others AS (SELECT f.fold, cand_id, y, score FROM scored s JOIN (SELECT unnest(range(0, {FOLDS})) AS fold) f ON f.fold <> s.fold),
{_auc_cte('train', 'others')}, {_auc_cte('test', 'scored')},
best AS (SELECT fold, cand_id, auc, row_number() OVER (PARTITION BY fold ORDER BY auc DESC, cand_id) AS nth FROM train)
SELECT CAST(b.fold AS INT) AS fold, b.cand_id, round(b.auc, 6) AS train_auc, round(t.auc, 6) AS test_auc FROM best b JOIN test t ON b.fold = t.fold AND b.cand_id = t.cand_id WHERE nth = 1"""

QUERIES = {
    "q_geotiff": (q_geotiff, GEOTIFF_SQL),
    "q_shapefile_lines": (q_shapefile_lines, LINES_SQL),
    "q_geojson_lines": (q_geojson_lines, LINES_SQL),
    "q_vector_points": (q_vector_points, POINTS_SQL),
    "q_steepest_walk": (q_steepest_walk, WALK_SQL),
    "q_walk_ends": (q_walk_ends, ENDS_SQL),
    "q_unit_windows": (q_unit_windows, UNIT_WINDOWS_SQL),
    "q_unit_run": (q_unit_run, None),
    "q_hazard_suite": (q_hazard_suite, HAZARD_SQL),
    "q_climate_run": (q_climate_run, CLIMATE_SQL),
    "q_validation_run": (q_validation_run, VALIDATION_SQL),
    "q_cv_permuted": (q_cv_permuted, PERMUTED_SQL),
}
