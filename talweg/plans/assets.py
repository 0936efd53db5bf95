"""Queries on settlements, lines and units: sampling, reach, exposure, clusters and stage records."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from talweg.functions import scores as S
from talweg.functions import triggers as T
from talweg.functions.gridding import Grid
from talweg.operators import graph, lines, reach, sampling, stencil, units as U
from talweg.plans import views as V
from talweg.plans.terrain import STEEPEST_SQL, r6
from talweg.plans.views import CELLS, DX, DY, SAMPLES, SCENARIO_P, SCENARIO_ROWS, SETTLEMENTS, TRACKS, UNITS, WIDTH, table

RADIUS_M = 150.0
POINTS = Grid(84.0, 27.0, 86.0, 29.0, 0.02)


def q_point_sample(spark, sf_dir):
    rows = sampling.sample_layers(V.samples(spark, sf_dir).select("id", "lon", "lat"), V.cells(spark, sf_dir), POINTS, ["z", "p"])
    return rows.select("id", r6("z", "z"), r6("p", "p"))


POINT_SQL = f"""WITH {CELLS}, {SAMPLES}, keyed AS (SELECT id, floor(({POINTS.north!r} - lat) / {POINTS.res!r}) AS r, floor((lon - {POINTS.west!r}) / {POINTS.res!r}) AS c FROM samples)
SELECT id, round(z, 6) AS z, round(p, 6) AS p FROM keyed LEFT JOIN cells ON row = r AND col = c AND r BETWEEN 0 AND {POINTS.height - 1} AND c BETWEEN 0 AND {POINTS.width - 1}"""


def q_survey_semi(spark, sf_dir):
    return sampling.inside(V.cells(spark, sf_dir), V.settlements(spark, sf_dir), ["row", "col"]).select("row", "col", r6("z", "z"))


SEMI_SQL = f"WITH {CELLS}, {SETTLEMENTS} SELECT row, col, round(z, 6) AS z FROM cells SEMI JOIN settlements USING (row, col)"


def q_unit_anti(spark, sf_dir):
    left = sampling.outside(V.cells(spark, sf_dir), V.settlements(spark, sf_dir), ["row", "col"])
    return left.groupBy("row").agg(F.count(F.lit(1)).alias("n"))


ANTI_SQL = f"WITH {CELLS}, {SETTLEMENTS} SELECT row, count(*) AS n FROM cells ANTI JOIN settlements USING (row, col) GROUP BY row"


def q_mosaic_last_wins(spark, sf_dir):
    pieces = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("cell"), F.col("p_partkey").alias("source"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("value"))
    return sampling.mosaic(pieces, ["cell"], "value", "source").select("cell", r6("value", "value"))


MOSAIC_SQL = "SELECT p_partkey % 50 AS cell, round(arg_max(p_retailprice, p_partkey), 6) AS value FROM part WHERE p_size % 3 > 0 GROUP BY 1"

UNIT_GRID = Grid(80.0, 26.0, 92.0, 30.0, 0.0937)


def q_polygon_cells(spark, sf_dir):
    """Cells in the rhombus of each unit's box; the country's code of the last unit over each."""
    boxes = V.units(spark, sf_dir)
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    corner = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    ring = F.array(corner(F.col("west"), y), corner(x, F.col("south")), corner(F.col("east"), y), corner(x, F.col("north")), corner(F.col("west"), y))
    polygons = boxes.select("id", (F.col("id") % 7).alias("code"), F.array(ring).alias("rings"))
    return sampling.burn(polygons, UNIT_GRID, "code", "id")


POLYGON_SQL = f"""WITH {UNITS}, grid AS (
  SELECT CAST(i // {UNIT_GRID.width} AS INT) AS row, CAST(i % {UNIT_GRID.width} AS INT) AS col FROM range({UNIT_GRID.width * UNIT_GRID.height}) AS t(i)),
centre AS (SELECT row, col, {UNIT_GRID.west!r} + (col + 5e-1) * {UNIT_GRID.res!r} AS x, {UNIT_GRID.north!r} - (row + 5e-1) * {UNIT_GRID.res!r} AS y FROM grid)
SELECT row, col, arg_max(id % 7, id) AS code FROM centre JOIN units
ON abs(x - (west + east) / 2) / ((east - west) / 2) + abs(y - (south + north) / 2) / ((north - south) / 2) < 1 GROUP BY row, col"""


def _targets(spark, sf_dir):
    return V.settlements(spark, sf_dir).select("asset_id", F.lit(0).alias("vertex"), "row", "col")


def _edges(spark, sf_dir):
    return reach.reach_edges(_targets(spark, sf_dir), V.cells(spark, sf_dir), DX, DY, RADIUS_M)


def q_reach_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("asset_id", "row", "col", r6("w", "w"), r6("relief", "relief"), r6("dist", "dist"), r6("az", "az"))


ROWS, COLS = int(RADIUS_M // DY), int(RADIUS_M // DX)
OFFSETS = f"""offs AS (SELECT dr, dc, sqrt(dr * dr * {DY * DY!r} + dc * dc * {DX * DX!r}) AS dist,
  CASE WHEN degrees(atan2(dc * {DX!r}, -dr * {DY!r})) < 0 THEN degrees(atan2(dc * {DX!r}, -dr * {DY!r})) + 360 ELSE degrees(atan2(dc * {DX!r}, -dr * {DY!r})) END AS az
  FROM (SELECT unnest(range({-ROWS}, {ROWS + 1})) AS dr) CROSS JOIN (SELECT unnest(range({-COLS}, {COLS + 1})) AS dc))"""


def _edge_cte(source: str) -> str:
    return f"""edges AS (SELECT s.asset_id, s.vertex, c.row, c.col, 1 / dist AS w, c.z - b.z AS relief, dist, az FROM {source} s JOIN cells b ON b.row = s.row AND b.col = s.col
  CROSS JOIN offs JOIN cells c ON c.row = s.row + dr AND c.col = s.col + dc
  WHERE dist > 0 AND dist <= {RADIUS_M!r} AND c.z > b.z AND (c.z - b.z) / dist > {math.tan(math.radians(18))!r})"""


TARGETS = "targets AS (SELECT asset_id, 0 AS vertex, row, col FROM settlements)"
REACHED = f"{CELLS}, {SETTLEMENTS}, {TARGETS}, {OFFSETS}, {_edge_cte('targets')}"
REACH_SQL = f"WITH {REACHED} SELECT asset_id, row, col, round(w, 6) AS w, round(relief, 6) AS relief, round(dist, 6) AS dist, round(az, 6) AS az FROM edges"


def _scores(spark, sf_dir):
    cells = V.cells(spark, sf_dir)
    return reach.tile_scores(_targets(spark, sf_dir), cells, V.scenario_probability(cells), DX, DY, RADIUS_M)


def q_reach_score(spark, sf_dir):
    out = _scores(spark, sf_dir)
    return out.select("asset_id", "scenario", *[r6(c, c) for c in ("reaching", "reaching_max", "delivering_m2", "source_relief_m", "source_distance_m")], "n_sources")


SCORES = f"""met AS (SELECT e.*, scenario, p FROM edges e JOIN sp USING (row, col)),
top AS (SELECT *, row_number() OVER (PARTITION BY asset_id, vertex, scenario ORDER BY p DESC, row, col) AS nth FROM met),
reached AS (SELECT asset_id, vertex, scenario, sum(w * p) / sum(w) AS reaching, max(p) AS reaching_max, count(*) AS n_sources, sum(p) * {DX * DY!r} AS delivering_m2,
  max(relief) FILTER (WHERE nth = 1) AS source_relief_m, max(dist) FILTER (WHERE nth = 1) AS source_distance_m FROM top GROUP BY asset_id, vertex, scenario)"""
REACH_SCORE_SQL = f"""WITH {REACHED}, {SCENARIO_ROWS}, {SCENARIO_P}, {SCORES} SELECT asset_id, scenario, round(reaching, 6) AS reaching, round(reaching_max, 6) AS reaching_max,
round(delivering_m2, 6) AS delivering_m2, round(source_relief_m, 6) AS source_relief_m, round(source_distance_m, 6) AS source_distance_m, n_sources FROM reached"""


def q_worst_sector(spark, sf_dir):
    out = reach.sectors_of(_scores(spark, sf_dir))
    return out.select("asset_id", "scenario", "sector", r6("sector_reaching", "sector_reaching"))


SECTOR_SQL = f"""WITH {REACHED}, {SCENARIO_ROWS}, {SCENARIO_P}, parts AS (
  SELECT asset_id, scenario, CAST(round_even(az / 45, 0) AS INT) % 8 AS k, sum(w * p) / sum(w) AS v FROM edges JOIN sp USING (row, col) GROUP BY ALL)
SELECT asset_id, scenario, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][arg_max(k, (v, -k)) + 1] AS sector, round(max(v), 6) AS sector_reaching FROM parts GROUP BY asset_id, scenario HAVING max(v) > 0"""


def _scored(spark, sf_dir):
    cells = V.cells(spark, sf_dir)
    targets = V.settlements(spark, sf_dir).select("asset_id", F.lit(0).alias("vertex"), "row", "col", "place", "population")
    return reach.tile_scores(targets, cells, V.scenario_probability(cells), DX, DY, RADIUS_M, site=True)


SCORED = f"""{SCORES}, scored AS (SELECT t.asset_id, t.vertex, s.place, s.population, sp.scenario, sp.p AS on_site, coalesce(reaching, 0) AS reaching, coalesce(reaching_max, 0) AS reaching_max,
  coalesce(n_sources, 0) AS n_sources, greatest(sp.p, coalesce(reaching, 0)) AS score
  FROM targets t JOIN settlements s ON s.asset_id = t.asset_id JOIN sp ON sp.row = t.row AND sp.col = t.col
  LEFT JOIN reached r ON r.asset_id = t.asset_id AND r.vertex = t.vertex AND r.scenario = sp.scenario)"""
SCORED_ALL = f"{REACHED}, {SCENARIO_ROWS}, {SCENARIO_P}, {SCORED}"


def q_asset_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("asset_id", "scenario", r6("on_site", "on_site"), r6("reaching", "reaching"), r6("score", "score"), S.band(F.col("score")).alias("band"))


BAND = "CASE WHEN score < 2e-2 THEN 'very low' WHEN score < 8e-2 THEN 'low' WHEN score < 2e-1 THEN 'moderate' WHEN score < 4e-1 THEN 'high' ELSE 'very high' END"
ASSET_SQL = f"WITH {SCORED_ALL} SELECT asset_id, scenario, round(on_site, 6) AS on_site, round(reaching, 6) AS reaching, round(score, 6) AS score, {BAND} AS band FROM scored"


def q_headline(spark, sf_dir):
    return reach.headline(_scored(spark, sf_dir)).select("asset_id", r6("score", "score"), r6("score_max", "score_max"), r6("delta_max", "delta_max"), "band")


HEADLINE_SQL = f"""WITH {SCORED_ALL}, h AS (SELECT asset_id, max(score) FILTER (WHERE scenario = 'current') AS score, max(score) AS score_max FROM scored GROUP BY asset_id)
SELECT asset_id, round(score, 6) AS score, round(score_max, 6) AS score_max, round(score_max - score, 6) AS delta_max, {BAND} AS band FROM h"""


def q_band_counts(spark, sf_dir):
    return reach.band_counts(_scored(spark, sf_dir), ["scenario"])


BAND_SQL = f"""WITH {SCORED_ALL}, names AS (SELECT unnest(['very low', 'low', 'moderate', 'high', 'very high']) AS band), own AS (SELECT scenario, {BAND} AS band FROM scored)
SELECT s.scenario, n.band, count(o.band) AS total FROM scenarios s CROSS JOIN names n LEFT JOIN own o ON o.scenario = s.scenario AND o.band = n.band GROUP BY s.scenario, n.band"""


def q_scenario_totals(spark, sf_dir):
    out = reach.scenario_totals(_scored(spark, sf_dir), population="population")
    return out.withColumn("mean_score", F.round("mean_score", 6))


TOTALS = """totals AS (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE score >= 8e-2) AS n_exposed, avg(score) AS mean_score, CAST(sum(coalesce(population, 0)) AS BIGINT) AS people,
  CAST(coalesce(sum(coalesce(population, 0)) FILTER (WHERE score >= 8e-2), 0) AS BIGINT) AS people_exposed FROM scored GROUP BY scenario)"""
TOTALS_SQL = f"WITH {SCORED_ALL}, {TOTALS} SELECT scenario, n, n_exposed, round(mean_score, 6) AS mean_score, people, people_exposed FROM totals"


def q_exposure_change(spark, sf_dir):
    totals = reach.scenario_totals(_scored(spark, sf_dir), population="population")
    out = reach.totals_change(totals, ["n_exposed", "people_exposed"])
    return out.select("scenario", "n_exposed", "n_exposed_change", "people_exposed_change")


EXPOSURE_SQL = f"""WITH {SCORED_ALL}, {TOTALS} SELECT a.scenario, a.n_exposed, a.n_exposed - b.n_exposed AS n_exposed_change, a.people_exposed - b.people_exposed AS people_exposed_change
FROM totals a CROSS JOIN totals b WHERE b.scenario = 'current'"""


def q_footprint_p90(spark, sf_dir):
    """The record at the ninetieth percentile of the cells under each settlement, by probability; the disc is that of its place."""
    return reach.footprint_cells(V.settlements(spark, sf_dir), V.cells(spark, sf_dir), DX, DY, "p").select("asset_id", "row", "col", r6("p", "score"))


LARGEST = max(S.FOOTPRINT_M.values())
FOOTPRINT_SQL = f"""WITH {CELLS}, {SETTLEMENTS}, radii AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {m:e})" for p, m in S.FOOTPRINT_M.items())}) AS r(place, radius)),
offs AS (SELECT place, dr, dc FROM radii CROSS JOIN (SELECT unnest(range({-int(LARGEST // DY)}, {int(LARGEST // DY) + 1})) AS dr) CROSS JOIN (SELECT unnest(range({-int(LARGEST // DX)}, {int(LARGEST // DX) + 1})) AS dc)
  WHERE sqrt(dr * dr * {DY * DY!r} + dc * dc * {DX * DX!r}) <= radius),
met AS (SELECT asset_id, c.row, c.col, p FROM settlements s JOIN offs USING (place) JOIN cells c ON c.row = s.row + dr AND c.col = s.col + dc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY p, row, col) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM met)
SELECT asset_id, row, col, round(p, 6) AS score FROM ranked WHERE k = CAST(round_even(9e-1 * (n - 1), 0) AS INT) + 1"""

LINE_GRID = Grid(84.0, 27.9, 84.25, 28.15, 0.0025)


def q_line_length(spark, sf_dir):
    return V.tracks(spark, sf_dir).select("asset_id", F.size("coords").alias("n_vertices"), r6(lines.length_m(F.col("coords")) / 1000, "km"))


STEPS = f"""steps AS (SELECT *, row_number() OVER v AS k, lag(lon) OVER v AS lon0, lag(lat) OVER v AS lat0 FROM tracks WINDOW v AS (PARTITION BY asset_id ORDER BY event_id)),
run AS (SELECT *, 2 * {S.EARTH_M!r} * asin(least(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)), 1e0)) AS d FROM steps)"""
LENGTH_SQL = f"WITH {TRACKS}, {STEPS} SELECT asset_id, CAST(count(*) AS INT) AS n_vertices, round(coalesce(sum(d) FILTER (WHERE k > 1), 0) / 1000, 6) AS km FROM run GROUP BY asset_id"

LIMIT_M = 60_000.0


def q_segment_line(spark, sf_dir):
    cut = lines.pieces(V.tracks(spark, sf_dir), ["asset_id"], LIMIT_M)
    return cut.select("asset_id", "piece", F.size("coords").alias("n_vertices"), r6(lines.length_m(F.col("coords")) / 1000, "km"))


SEGMENT_SQL = f"""WITH RECURSIVE {TRACKS}, {STEPS},
fold AS (
  SELECT asset_id, k, 0e0 AS run, 0 AS piece, 0e0 AS d FROM run WHERE k = 1
  UNION ALL
  SELECT r.asset_id, r.k, CASE WHEN f.run >= {LIMIT_M!r} THEN r.d ELSE f.run + r.d END, CASE WHEN f.run >= {LIMIT_M!r} THEN f.piece + 1 ELSE f.piece END, r.d
  FROM fold f JOIN run r ON r.asset_id = f.asset_id AND r.k = f.k + 1)
SELECT asset_id, CAST(piece AS INT) AS piece, CAST(count(*) FILTER (WHERE k > 1) + 1 AS INT) AS n_vertices, round(sum(d) / 1000, 6) AS km FROM fold GROUP BY asset_id, piece HAVING count(*) FILTER (WHERE k > 1) > 0"""


def q_line_cells(spark, sf_dir):
    return lines.line_cells(V.tracks(spark, sf_dir), LINE_GRID)


LINE_CELLS_SQL = f"""WITH {TRACKS}, v AS (SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY event_id) - 1 AS INT) AS vertex,
  CAST(trunc(({LINE_GRID.north!r} - lat) / {LINE_GRID.res!r}) AS INT) AS row, CAST(trunc((lon - {LINE_GRID.west!r}) / {LINE_GRID.res!r}) AS INT) AS col FROM tracks)
SELECT asset_id, min(vertex) AS vertex, row, col FROM v WHERE row BETWEEN 0 AND {LINE_GRID.height - 1} AND col BETWEEN 0 AND {LINE_GRID.width - 1} GROUP BY asset_id, row, col"""


def q_segment_score(spark, sf_dir):
    """Each line's best vertex on a coarse grid of probabilities."""
    at = lines.line_cells(V.tracks(spark, sf_dir), LINE_GRID)
    p = V.scenario_probability(V.cells(spark, sf_dir).filter(F.col("row") < LINE_GRID.height))
    met = at.join(p, ["row", "col"]).select("asset_id", "vertex", "scenario", F.col("p").alias("score"), F.col("p").alias("on_site"))
    zero = met.withColumns({c: F.lit(0) for c in ("reaching", "reaching_max", "n_sources", "delivering_m2")})
    return reach.segment_scores(zero).select("asset_id", "scenario", "vertex", r6("score", "score"), r6("on_site", "on_site"))


SEGMENT_SCORE_SQL = f"""WITH {CELLS}, {SCENARIO_ROWS}, {SCENARIO_P}, lc AS ({LINE_CELLS_SQL}),
met AS (SELECT asset_id, vertex, scenario, p, row_number() OVER (PARTITION BY asset_id, scenario ORDER BY p DESC, vertex) AS nth FROM lc JOIN sp USING (row, col) WHERE row < {LINE_GRID.height})
SELECT asset_id, scenario, vertex, round(p, 6) AS score, round(p, 6) AS on_site FROM met WHERE nth = 1"""


def q_mechanisms(spark, sf_dir):
    cells = V.cells(spark, sf_dir)
    rise = stencil.steepest_rise(cells, DX, DY).select("row", "col", "rise")
    per_cell = rise.join(cells.select("row", "col", (F.col("p") * 6000).alias("sca")), ["row", "col"])
    out = reach.mechanisms(lines.line_cells(V.tracks(spark, sf_dir), LINE_GRID), per_cell)
    return out.select("asset_id", r6("sca", "sca"), "cut_slope", "washout")


MECHANISM_SQL = f"""WITH rises AS ({STEEPEST_SQL.replace('round(greatest(', '(greatest(').replace('), 9) AS rise', ')) AS rise')}), {CELLS}, lc AS ({LINE_CELLS_SQL})
SELECT asset_id, round(max(p * 6000), 6) AS sca, degrees(atan(max(rise))) >= 35 AS cut_slope, max(p * 6000) >= 5000 AS washout FROM lc JOIN rises USING (row, col) JOIN cells USING (row, col) GROUP BY asset_id"""


def q_mechanism_lengths(spark, sf_dir):
    roads = V.samples(spark, sf_dir).select(F.col("sca").alias("length_m"), (F.col("slope") > 0.7).alias("cut_slope"), (F.col("years") > 200).alias("washout"))
    out = reach.mechanism_lengths(roads)
    return out.select(*[r6(c, c) for c in out.columns])


MECHANISM_LENGTHS_SQL = f"""WITH {V.SAMPLES} SELECT round(coalesce(sum(sca) FILTER (WHERE slope > 7e-1), 0) / 1e3, 6) AS km_cut_slope,
  round(coalesce(sum(sca) FILTER (WHERE years > 200), 0) / 1e3, 6) AS km_washout, round(coalesce(sum(sca) FILTER (WHERE slope > 7e-1 AND years > 200), 0) / 1e3, 6) AS km_both FROM samples"""


def q_middle_vertex(spark, sf_dir):
    middle = V.tracks(spark, sf_dir).select("asset_id", lines.middle_vertex(F.col("coords")).alias("v"))
    return middle.select("asset_id", r6("v.lon", "lon"), r6("v.lat", "lat"))


MIDDLE_SQL = f"""WITH {TRACKS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY asset_id) AS n FROM tracks)
SELECT asset_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM placed WHERE nth = n // 2"""


def q_labelled(spark, sf_dir):
    rows = V.samples(spark, sf_dir).select("id", "region", "y").withColumnRenamed("y", "failed")
    out = U.labelled(rows.filter("failed"), rows.filter("NOT failed"), ["id", "region"])
    return out.groupBy("region", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


LABELLED_SQL = f"WITH {V.SAMPLES} SELECT region, y, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM samples GROUP BY region, y"


def q_near_presence(spark, sf_dir):
    rows = V.cells(spark, sf_dir).select("row", "col")
    grid = Grid(0.0, 0.0, 10.0, 1e4, 0.1)
    towns = V.settlements(spark, sf_dir)
    presence = towns.select(((F.col("col") + 0.5) / 10).alias("lon"), (1e4 - (F.col("row") + 0.5) / 10).alias("lat"))
    return sampling.near_presence(rows, grid, presence)


NEAR_PRESENCE_SQL = f"""WITH {CELLS}, {SETTLEMENTS} SELECT row, col FROM cells c WHERE EXISTS (
  SELECT 1 FROM settlements s WHERE abs(s.row - c.row) <= 1 AND abs(s.col - c.col) <= 1)"""

LINK_M, LAT0 = 80.0, 28.0


def _placed(spark, sf_dir):
    return V.settlements(spark, sf_dir).select("asset_id", "name", (84.0 + F.col("col") * 0.00027).alias("lon"), (28.0 - F.col("row") * 0.00029).alias("lat"))


PLACED = f"""{SETTLEMENTS}, xy AS (SELECT asset_id, name, 84e0 + col * 0.00027e0 AS lon, 28e0 - row * 0.00029e0 AS lat,
  (84e0 + col * 0.00027e0) * {S.METRES_PER_DEGREE_LON * math.cos(math.radians(LAT0))!r} AS x, (28e0 - row * 0.00029e0) * {S.METRES_PER_DEGREE_LAT!r} AS y FROM settlements)"""
PAIRS = f"pairs AS (SELECT a.asset_id AS a, b.asset_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM xy a JOIN xy b ON a.asset_id < b.asset_id AND abs(a.x - b.x) <= {LINK_M!r} AND abs(a.y - b.y) <= {LINK_M!r})"


def q_pairs_within(spark, sf_dir):
    out = graph.pairs_within(_placed(spark, sf_dir), LINK_M, LAT0)
    return out.select("a", "b", F.round("dist", 3).alias("dist"))


PAIRS_SQL = f"WITH {PLACED}, {PAIRS} SELECT a, b, round(dist, 3) AS dist FROM pairs WHERE dist <= {LINK_M!r}"


def q_clusters(spark, sf_dir):
    return graph.clusters(_placed(spark, sf_dir), LAT0, LINK_M).select("asset_id", "cluster_id")


CLUSTERS_SQL = f"""WITH RECURSIVE {PLACED}, {PAIRS},
near AS MATERIALIZED (SELECT a, b FROM pairs WHERE dist <= {LINK_M!r} UNION ALL SELECT b, a FROM pairs WHERE dist <= {LINK_M!r}),
comp(id, root) USING KEY (id) AS (
  SELECT asset_id, asset_id FROM xy
  UNION
  SELECT x.id, x.root FROM (
    SELECT n.a AS id, min(c.root) AS root, any_value(o.root) AS old FROM near n JOIN recurring.comp c ON c.id = n.b JOIN recurring.comp o ON o.id = n.a GROUP BY n.a) x WHERE x.root < x.old)
SELECT id AS asset_id, root AS cluster_id FROM comp"""


def q_cluster_sizes(spark, sf_dir):
    """The largest clusters; their hulls are held against brute force by a test."""
    out = graph.largest_clusters(graph.clusters(_placed(spark, sf_dir), LAT0, LINK_M))
    return out.select("cluster_id", "size", "name", r6("lon", "lon"), r6("lat", "lat"))


SIZES_SQL = f"""{CLUSTERS_SQL.rpartition('SELECT id AS asset_id')[0].rstrip()},
sized AS (SELECT root AS cluster_id, count(*) AS size, arg_min(name, asset_id) FILTER (WHERE name IS NOT NULL) AS name, avg(lon) AS lon, avg(lat) AS lat FROM comp JOIN xy ON asset_id = id GROUP BY root)
SELECT cluster_id, size, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sized WHERE size >= 2 ORDER BY size DESC, cluster_id LIMIT 5"""


BOX = (80.5, 26.0, 88.0, 29.0)
COUNTRIES, EXCLUDE = ["asia", "AFRICA", "europe"], ["france"]


def q_unit_selection(spark, sf_dir):
    found = U.select_units(V.units(spark, sf_dir), BOX, COUNTRIES, exclude=EXCLUDE)
    return found.select("slug", *[r6(c, c) for c in ("west", "south", "east", "north")])


SELECTED = f"""selected AS (SELECT trim(regexp_replace(lower(country || ' ' || name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, greatest(west, {BOX[0]!r}) AS west, greatest(south, {BOX[1]!r}) AS south, least(east, {BOX[2]!r}) AS east, least(north, {BOX[3]!r}) AS north
  FROM units WHERE lower(country) IN ('asia', 'africa', 'europe') AND lower(name) <> 'france' AND greatest(west, {BOX[0]!r}) < least(east, {BOX[2]!r}) AND greatest(south, {BOX[1]!r}) < least(north, {BOX[3]!r}))"""
SELECTION_SQL = f"WITH {UNITS}, {SELECTED} SELECT slug, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM selected WHERE east - west >= 2e-2 AND north - south >= 2e-2"


def q_cost_plan(spark, sf_dir):
    named = V.units(spark, sf_dir).withColumn("slug", S.slug(F.col("country"), F.col("name")))
    return U.cost_plan(named, 0.01, 20_000).select("slug", "n_cells", "too_large")


COST_SQL = f"""WITH {UNITS} SELECT trim(regexp_replace(lower(country || ' ' || name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(round((east - west) / 1e-2) * round((north - south) / 1e-2) AS BIGINT) AS n_cells,
round((east - west) / 1e-2) * round((north - south) / 1e-2) > 20000 AS too_large FROM units"""


def _unit_cells(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return met.select(F.col("c_nationkey").alias("unit"), ((F.col("o_orderkey") * 7919) % 101 / 100.0).alias("p"), (F.col("o_totalprice") / 100).alias("z"), ((F.col("o_orderkey") * 31) % 900).cast("double").alias("relief"), (26.0 + F.col("o_orderkey") % 4).alias("lat"))


UNIT_CELLS = "uc AS (SELECT c_nationkey AS unit, (o_orderkey * 7919) % 101 / 1e2 AS p, o_totalprice / 100 AS z, CAST((o_orderkey * 31) % 900 AS DOUBLE) AS relief, 26e0 + o_orderkey % 4 AS lat FROM customer JOIN orders ON c_custkey = o_custkey)"


def q_unit_statistics(spark, sf_dir):
    out = U.unit_statistics(_unit_cells(spark, sf_dir), ["unit"], "p")
    return out.select("unit", "n_cells", r6("mean", "mean"), r6("unstable_percent", "unstable_percent"), r6("p90", "p90"))


UNIT_STATISTICS_SQL = f"WITH {UNIT_CELLS} SELECT unit, count(*) AS n_cells, round(avg(p), 6) AS mean, round(avg(CASE WHEN p > 5e-1 THEN 1e2 ELSE 0e0 END), 6) AS unstable_percent, round(quantile_cont(p, 0.9), 6) AS p90 FROM uc GROUP BY unit"


def q_mountain_units(spark, sf_dir):
    out = U.relief_statistics(_unit_cells(spark, sf_dir), 0.1, ["unit"])
    return out.select("unit", r6("mountain_fraction", "mountain_fraction"), F.round("mountain_area_km2", 3).alias("mountain_area_km2"), r6("max_elevation_m", "max_elevation_m"), r6("median_local_relief_m", "median_local_relief_m"), "mountainous")


MOUNTAIN_SQL = f"""WITH {UNIT_CELLS}, m AS (SELECT unit, avg(CASE WHEN z >= 1000 AND relief >= 500 THEN 1e0 ELSE 0e0 END) AS f,
  sum(CASE WHEN z >= 1000 AND relief >= 500 THEN 1e-1 * {S.METRES_PER_DEGREE_LON!r} * cos(radians(lat)) * 1e-1 * {S.METRES_PER_DEGREE_LAT!r} / 1e6 ELSE 0e0 END) AS area, max(z) AS top, median(relief) AS med FROM uc GROUP BY unit)
SELECT unit, round(f, 6) AS mountain_fraction, round(area, 3) AS mountain_area_km2, round(top, 6) AS max_elevation_m, round(med, 6) AS median_local_relief_m, f >= 1e-1 OR (area >= 1000 AND top >= 1400) AS mountainous FROM m"""


def q_worst_first(spark, sf_dir):
    named = V.units(spark, sf_dir).withColumn("slug", F.lower("name"))
    known = U.unit_statistics(_unit_cells(spark, sf_dir).filter(F.col("unit") % 3 > 0), ["unit"], "p")
    named_known = known.join(V.units(spark, sf_dir).select("id", F.lower("name").alias("slug")), F.col("unit") == F.col("id"))
    ordered = U.worst_first(named, named_known)
    return ordered.select("slug", r6("unstable_percent", "unstable_percent"))


WORST_SQL = f"""WITH {UNITS}, {UNIT_CELLS}, k AS (SELECT unit, avg(CASE WHEN p > 5e-1 THEN 1e2 ELSE 0e0 END) AS u FROM uc WHERE unit % 3 > 0 GROUP BY unit)
SELECT lower(name) AS slug, round(u, 6) AS unstable_percent FROM units LEFT JOIN k ON id = unit"""


def _records(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("slug"),
        F.col("s_suppkey").alias("written"),
        F.create_map(F.concat(F.lit("k"), (F.col("s_suppkey") % 4).cast("string")), F.col("s_name"), F.lit("last"), F.col("s_suppkey").cast("string")).alias("payload"),
    )


def q_marker_merge(spark, sf_dir):
    merged = U.merge_records(_records(spark, sf_dir))
    return merged.select("slug", F.explode("payload").alias("k", "v"))


MERGE_SQL = """WITH r AS (SELECT CAST(s_nationkey AS VARCHAR) AS slug, s_suppkey AS written, 'k' || (s_suppkey % 4) AS k, s_name AS v FROM supplier
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), s_suppkey, 'last', CAST(s_suppkey AS VARCHAR) FROM supplier) SELECT slug, k, arg_max(v, written) AS v FROM r GROUP BY slug, k"""


def q_latest_record(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    return U.latest(rows, ["s_nationkey"], "s_suppkey").select("s_nationkey", "s_suppkey", "s_name", r6("s_acctbal", "s_acctbal"))


LATEST_SQL = "SELECT s_nationkey, max(s_suppkey) AS s_suppkey, arg_max(s_name, s_suppkey) AS s_name, round(arg_max(s_acctbal, s_suppkey), 6) AS s_acctbal FROM supplier GROUP BY s_nationkey"


def q_stage_missing(spark, sf_dir):
    named = V.units(spark, sf_dir).select(F.lower("name").alias("slug"))
    wanted = spark.createDataFrame([("terrain",), ("susceptibility",), ("risk",)], "stage string")
    stage = F.element_at(F.array(F.lit("terrain"), F.lit("susceptibility"), F.lit("risk")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    errors = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>"))
    done = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("slug"), stage.alias("stage"), errors.alias("errors"))
    return U.missing_stages(named, wanted, done)


MISSING_SQL = """WITH done AS (SELECT lower(n_name) AS slug, ['terrain', 'susceptibility', 'risk'][n_nationkey % 3 + 1] AS stage FROM nation WHERE n_nationkey % 5 > 0)
SELECT lower(n_name) AS slug, stage FROM nation CROSS JOIN (SELECT unnest(['terrain', 'susceptibility', 'risk']) AS stage) w ANTI JOIN done ON done.slug = lower(n_name) AND done.stage = w.stage"""


def q_dedup_scenarios(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scenario"), F.col("c_custkey").alias("position"))
    return U.ordered_distinct(rows, "scenario", "position")


DEDUP_SQL = "SELECT c_mktsegment AS scenario, min(c_custkey) AS position FROM customer GROUP BY 1"


def q_pool_inventories(spark, sf_dir):
    place = lambda t, k: table(spark, sf_dir, t).select((F.col(k) % 360 - 180.0).alias("lon"), (F.col(k) % 180 - 90.0).alias("lat"))
    pool = U.pooled({"one": place("customer", "c_custkey"), "two": place("supplier", "s_suppkey")})
    return pool.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.min("lon"), "west"), r6(F.max("lat"), "north"))


POOL_SQL = """SELECT source, count(*) AS n, round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM (
SELECT c_custkey % 360 - 180e0 AS lon, c_custkey % 180 - 90e0 AS lat, 'one' AS source FROM customer UNION ALL SELECT s_suppkey % 360 - 180e0, s_suppkey % 180 - 90e0, 'two' FROM supplier) GROUP BY source"""


def q_prune(spark, sf_dir):
    outputs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.col("n_regionkey").alias("country_slug"))
    selected = table(spark, sf_dir, "region").filter("r_name IN ('ASIA', 'EUROPE')").select(F.col("r_regionkey").alias("country_slug"))
    return U.to_prune(outputs, selected).select("path")


PRUNE_SQL = "SELECT n_name AS path FROM nation ANTI JOIN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) ON r_regionkey = n_regionkey"


def q_slug(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b")).distinct()
    return rows.select("a", "b", S.slug(F.col("a"), F.col("b")).alias("slug"))


SLUG_SQL = "SELECT DISTINCT p_type AS a, p_brand AS b, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"

TEXTS = ["current", "SSP245", " ssp585:2081-2100", "ssp126:2021-2040", "Baseline"]


def q_short_label(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select("n_name", text.alias("text"))
    pathway, period = T.scenario_parts(F.col("text"))
    return rows.select("n_name", T.scenario_key(pathway, period).alias("scenario"), T.short_label(pathway, period).alias("label"))


LABEL_SQL = """SELECT n_name, ['current', 'ssp245_2041-2060', 'ssp585_2081-2100', 'ssp126_2021-2040', 'current'][n_nationkey % 5 + 1] AS scenario,
['present', 'SSP2-4.5 2041-60', 'SSP5-8.5 2081-00', 'SSP1-2.6 2021-40', 'present'][n_nationkey % 5 + 1] AS label FROM nation"""


def q_inventory_extent(spark, sf_dir):
    from talweg.operators import validation

    rows = V.samples(spark, sf_dir)
    return validation.extent(rows, 0.1).join(validation.share_inside(rows, 84.5, 27.5, 85.5, 28.5)).select(*[r6(c, c) for c in ("west", "south", "east", "north")], "n", r6("share", "share"))


EXTENT_SQL = f"WITH {SAMPLES} SELECT round(min(lon) - 1e-1, 6) AS west, round(min(lat) - 1e-1, 6) AS south, round(max(lon) + 1e-1, 6) AS east, round(max(lat) + 1e-1, 6) AS north, count(*) AS n, round(avg(CASE WHEN lon BETWEEN 84.5e0 AND 85.5e0 AND lat BETWEEN 27.5e0 AND 28.5e0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM samples"


def q_polygon_points(spark, sf_dir):
    """Crown, upper quarter and toe of groups of samples, as if they were polygons' vertices."""
    rows = V.samples(spark, sf_dir).select((F.col("id") % 97).alias("poly"), (F.col("sca") + F.col("id") / 1e6).alias("z"), "lon", "lat")
    out = sampling.polygon_points(rows, "poly")
    return out.select("poly", *[r6(c, c) for c in out.columns if c != "poly"])


POLYGON_POINTS_SQL = f"""WITH {SAMPLES}, v AS (SELECT id % 97 AS poly, sca + id / 1e6 AS z, lon, lat FROM samples), q AS (SELECT poly, quantile_cont(z, 0.75) AS cut FROM v GROUP BY poly)
SELECT poly, round(arg_max(lon, z), 6) AS crown_lon, round(arg_max(lat, z), 6) AS crown_lat, round(avg(lon) FILTER (WHERE z >= cut), 6) AS upper_lon, round(avg(lat) FILTER (WHERE z >= cut), 6) AS upper_lat,
round(arg_min(lon, z), 6) AS toe_lon, round(arg_min(lat, z), 6) AS toe_lat FROM v JOIN q USING (poly) GROUP BY poly"""

QUERIES = {
    "q_point_sample": (q_point_sample, POINT_SQL),
    "q_survey_semi": (q_survey_semi, SEMI_SQL),
    "q_unit_anti": (q_unit_anti, ANTI_SQL),
    "q_mosaic_last_wins": (q_mosaic_last_wins, MOSAIC_SQL),
    "q_polygon_cells": (q_polygon_cells, POLYGON_SQL),
    "q_reach_edges": (q_reach_edges, REACH_SQL),
    "q_reach_score": (q_reach_score, REACH_SCORE_SQL),
    "q_worst_sector": (q_worst_sector, SECTOR_SQL),
    "q_asset_scores": (q_asset_scores, ASSET_SQL),
    "q_headline": (q_headline, HEADLINE_SQL),
    "q_band_counts": (q_band_counts, BAND_SQL),
    "q_scenario_totals": (q_scenario_totals, TOTALS_SQL),
    "q_exposure_change": (q_exposure_change, EXPOSURE_SQL),
    "q_footprint_p90": (q_footprint_p90, FOOTPRINT_SQL),
    "q_line_length": (q_line_length, LENGTH_SQL),
    "q_segment_line": (q_segment_line, SEGMENT_SQL),
    "q_line_cells": (q_line_cells, LINE_CELLS_SQL),
    "q_segment_score": (q_segment_score, SEGMENT_SCORE_SQL),
    "q_mechanisms": (q_mechanisms, MECHANISM_SQL),
    "q_mechanism_lengths": (q_mechanism_lengths, MECHANISM_LENGTHS_SQL),
    "q_middle_vertex": (q_middle_vertex, MIDDLE_SQL),
    "q_labelled": (q_labelled, LABELLED_SQL),
    "q_near_presence": (q_near_presence, NEAR_PRESENCE_SQL),
    "q_pairs_within": (q_pairs_within, PAIRS_SQL),
    "q_clusters": (q_clusters, CLUSTERS_SQL),
    "q_cluster_sizes": (q_cluster_sizes, SIZES_SQL),
    "q_unit_selection": (q_unit_selection, SELECTION_SQL),
    "q_cost_plan": (q_cost_plan, COST_SQL),
    "q_unit_statistics": (q_unit_statistics, UNIT_STATISTICS_SQL),
    "q_mountain_units": (q_mountain_units, MOUNTAIN_SQL),
    "q_worst_first": (q_worst_first, WORST_SQL),
    "q_marker_merge": (q_marker_merge, MERGE_SQL),
    "q_latest_record": (q_latest_record, LATEST_SQL),
    "q_stage_missing": (q_stage_missing, MISSING_SQL),
    "q_dedup_scenarios": (q_dedup_scenarios, DEDUP_SQL),
    "q_pool_inventories": (q_pool_inventories, POOL_SQL),
    "q_prune": (q_prune, PRUNE_SQL),
    "q_slug": (q_slug, SLUG_SQL),
    "q_short_label": (q_short_label, LABEL_SQL),
    "q_inventory_extent": (q_inventory_extent, EXTENT_SQL),
    "q_polygon_points": (q_polygon_points, POLYGON_POINTS_SQL),
}
