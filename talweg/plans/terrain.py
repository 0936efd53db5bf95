"""Queries on grids: stencils, hydrology and raster sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import scores
from talweg.functions.gridding import Grid
from talweg.operators import hydrology, sampling, stability, stencil
from talweg.plans.views import CELLS, DX, DY, SCENARIO_P, SCENARIO_ROWS, WIDTH, cells, scenario_probability
from talweg.session import cut
from talweg.sources import writers

NAMES = list(stencil.NEIGHBOURS)


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _joined(value: str, replicate: bool) -> str:
    """SQL of the neighbour columns, by joins on shifted keys."""
    out, joins = [], []
    for k, (dr, dc) in stencil.NEIGHBOURS.items():
        row = f"least(greatest(a.row + ({dr}), 0), (SELECT max(row) FROM cells))" if replicate else f"a.row + ({dr})"
        col = f"least(greatest(a.col + ({dc}), 0), {WIDTH - 1})" if replicate else f"a.col + ({dc})"
        joins.append(f"LEFT JOIN cells n{k} ON n{k}.row = {row} AND n{k}.col = {col}")
        out.append(f"n{k}.{value} AS {value}_{k}")
    return f"SELECT a.*, {', '.join(out)} FROM cells a {' '.join(joins)}"


def q_neighbours(spark, sf_dir):
    around = stencil.with_neighbours(cells(spark, sf_dir))
    return around.select("row", "col", *[r6(f"z_{k}", f"z_{k.lower()}") for k in NAMES])


NEIGHBOURS_SQL = f"WITH {CELLS}, around AS ({_joined('z', False)}) SELECT row, col, " + ", ".join(f"round(z_{k}, 6) AS z_{k.lower()}" for k in NAMES) + " FROM around"


def q_local_relief(spark, sf_dir):
    return stencil.local_relief(cells(spark, sf_dir)).select("row", "col", r6("relief", "relief"))


LOCAL_RELIEF_SQL = f"""WITH {CELLS} SELECT a.row, a.col, round(max(b.z) - min(b.z), 6) AS relief FROM cells a
JOIN (SELECT unnest([-1, 0, 1]) AS dr) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dc) ON true
JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.row, a.col"""


def q_steepest_rise(spark, sf_dir):
    return stencil.steepest_rise(cells(spark, sf_dir), DX, DY).select("row", "col", F.round("rise", 9).alias("rise"))


RUNS = {k: (DX if not dr else DY if not dc else (DX * DX + DY * DY) ** 0.5) for k, (dr, dc) in stencil.NEIGHBOURS.items()}
STEEPEST_SQL = f"WITH {CELLS}, around AS ({_joined('z', False)}) SELECT row, col, round(greatest(" + ", ".join(f"(z_{k} - z) / {RUNS[k]!r}" for k in NAMES) + "), 9) AS rise FROM around"


def directed(spark, sf_dir):
    """Written once, since the edges join it with itself."""
    return cut(hydrology.flow_direction(cells(spark, sf_dir).withColumnRenamed("z", "filled"), DX, DY))


def q_dinf_direction(spark, sf_dir):
    rows = hydrology.flow_direction(cells(spark, sf_dir).withColumnRenamed("z", "filled"), DX, DY)
    return rows.select("row", "col", r6("angle", "angle"), F.round("slope", 9).alias("slope"))


def _facets() -> str:
    import math

    parts = []
    for cardinal, diagonal, turns, sign in hydrology.FACETS:
        d1, d2 = (DX, DY) if cardinal in "EW" else (DY, DX)
        s1, s2 = f"((z - z_{cardinal}) / {d1!r})", f"((z_{cardinal} - z_{diagonal}) / {d2!r})"
        r, limit = f"atan2({s2}, {s1})", math.atan2(d2, d1)
        s = f"CASE WHEN {r} < 0 THEN {s1} WHEN {r} > {limit!r} THEN (z - z_{diagonal}) / {math.hypot(d1, d2)!r} ELSE sqrt({s1} * {s1} + {s2} * {s2}) END"
        t = f"CASE WHEN {r} < 0 THEN 0e0 WHEN {r} > {limit!r} THEN {limit!r} ELSE {r} END"
        parts.append(f"{{'s': {s}, 'a': {sign} * {t} + {turns} * {math.pi / 2!r}}}")
    return ", ".join(parts)


DIRECTED = f"""around AS ({_joined('z', True)}),
faced AS (SELECT row, col, z, list_transform([{_facets()}], lambda f: f) AS f FROM around),
best AS (SELECT row, col, z, f, list_max(list_transform(f, lambda x: x.s)) AS top FROM faced),
directed AS (SELECT row, col, z, CASE WHEN top > 0 THEN fmod(f[list_position(list_transform(f, lambda x: x.s), top)].a, {2 * 3.141592653589793!r}) END AS angle,
  greatest(top, 0e0) AS slope FROM best)"""
DIRECTION_SQL = f"WITH {CELLS}, {DIRECTED} SELECT row, col, round(angle, 6) AS angle, round(slope, 9) AS slope FROM directed"

EDGES = f"""steps AS (SELECT * FROM (VALUES {', '.join(f'({i}, {dr}, {dc})' for i, (dr, dc) in enumerate(hydrology.STEPS))}) AS s(k, dr, dc)),
parts AS (SELECT row, col, z, angle / {hydrology.QUARTER!r} AS part FROM directed WHERE angle IS NOT NULL),
aimed AS (
  SELECT row, col, z, CAST(floor(part) AS INT) % 8 AS k, 1 - (part - floor(part)) AS share FROM parts UNION ALL
  SELECT row, col, z, (CAST(floor(part) AS INT) + 1) % 8 AS k, part - floor(part) AS share FROM parts),
edges AS (
  SELECT a.row, a.col, b.row AS to_row, b.col AS to_col, share, b.z < a.z AS down
  FROM aimed a JOIN steps s ON a.k = s.k JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc WHERE share > 0)"""


def q_flow_edges(spark, sf_dir):
    return hydrology.flow_edges(directed(spark, sf_dir)).select("row", "col", "to_row", "to_col", r6("share", "share"), "down")


FLOW_EDGES_SQL = f"WITH {CELLS}, {DIRECTED}, {EDGES} SELECT row, col, to_row, to_col, round(share, 6) AS share, down FROM edges"


def q_mass_balance(spark, sf_dir):
    edges = hydrology.flow_edges(directed(spark, sf_dir))
    return edges.groupBy("to_row", "to_col").agg(F.count(F.lit(1)).alias("n_in"), F.round(F.sum("share"), 6).alias("inflow"))


MASS_SQL = f"WITH {CELLS}, {DIRECTED}, {EDGES} SELECT to_row, to_col, count(*) AS n_in, round(sum(share), 6) AS inflow FROM edges GROUP BY to_row, to_col"


def q_fill(spark, sf_dir):
    return hydrology.fill_depressions(cells(spark, sf_dir)).select("row", "col", r6("filled", "filled"))


FILLED = """nb AS MATERIALIZED (
  SELECT n.row, n.col, n.z, u.row AS ur, u.col AS uc FROM cells n
  JOIN (SELECT unnest([-1,-1,-1,0,0,1,1,1]) AS dr, unnest([-1,0,1,-1,1,-1,0,1]) AS dc) o ON true
  JOIN cells u ON u.row = n.row + o.dr AND u.col = n.col + o.dc
  WHERE n.row BETWEEN 1 AND (SELECT max(row) - 1 FROM cells) AND n.col BETWEEN 1 AND (SELECT max(col) - 1 FROM cells)),
f(row, col, v) USING KEY (row, col) AS (
  SELECT row, col, CASE WHEN row IN (0, (SELECT max(row) FROM cells)) OR col IN (0, (SELECT max(col) FROM cells)) THEN z ELSE 1e300 END FROM cells
  UNION
  SELECT x.row, x.col, x.v FROM (
    SELECT nb.row, nb.col, greatest(nb.z, min(u.v) + 1e-6) AS v, any_value(cur.v) AS cv
    FROM nb JOIN recurring.f u ON u.row = nb.ur AND u.col = nb.uc JOIN recurring.f cur ON cur.row = nb.row AND cur.col = nb.col
    GROUP BY nb.row, nb.col, nb.z) x
  WHERE x.v < x.cv)"""
FILL_SQL = f"WITH RECURSIVE {CELLS}, {FILLED} SELECT row, col, round(v, 6) AS filled FROM f"


def q_raised_cells(spark, sf_dir):
    filled = hydrology.fill_depressions(cells(spark, sf_dir))
    return filled.groupBy("row").agg(F.count_if(F.col("filled") > F.col("z")).alias("n_raised"), F.count(F.lit(1)).alias("n_cells"))


RAISED_SQL = f"WITH RECURSIVE {CELLS}, {FILLED} SELECT f.row, count(*) FILTER (WHERE v > z) AS n_raised, count(*) AS n_cells FROM f JOIN cells USING (row, col) GROUP BY f.row"


def q_catchment_area(spark, sf_dir):
    """The whole chain from heights to the area that drains through each cell."""
    return hydrology.specific_catchment_area(cells(spark, sf_dir), DX, DY).select("row", "col", F.round("slope", 4).alias("slope"), F.round("sca", 1).alias("sca"))


# The same CTEs over the filled heights; then all cells' sums are made again until none of them moves.
CATCHMENT_SQL = f"""WITH RECURSIVE {CELLS}, {FILLED}, raised AS MATERIALIZED (SELECT row, col, v AS z FROM f),
{DIRECTED.replace('cells', 'raised')}, {EDGES.replace('cells', 'raised').replace('edges AS (', 'edges AS MATERIALIZED (')},
acc(row, col, p) USING KEY (row, col) AS (
  SELECT row, col, 1e0 FROM raised
  UNION
  SELECT x.row, x.col, x.p FROM (
    SELECT e.to_row AS row, e.to_col AS col, 1 + sum(e.share * u.p) AS p, any_value(cur.p) AS old
    FROM edges e JOIN recurring.acc u ON u.row = e.row AND u.col = e.col JOIN recurring.acc cur ON cur.row = e.to_row AND cur.col = e.to_col
    WHERE e.down GROUP BY e.to_row, e.to_col) x
  WHERE abs(x.p - x.old) > 1e-13 * x.p),
up AS (SELECT e.to_row AS row, e.to_col AS col, sum(e.share * a.p) AS more FROM edges e JOIN acc a ON a.row = e.row AND a.col = e.col WHERE NOT e.down GROUP BY ALL)
SELECT d.row, d.col, round(d.slope, 4) AS slope, round((a.p + coalesce(up.more, 0)) * {DX * DY!r} / {0.5 * (DX + DY)!r}, 1) AS sca
FROM directed d JOIN acc a ON a.row = d.row AND a.col = d.col LEFT JOIN up ON up.row = d.row AND up.col = d.col"""


def q_raster_statistics(spark, sf_dir):
    out = stability.raster_statistics(cells(spark, sf_dir), ["row"], "z")
    return out.select("row", r6("min", "min_z"), r6("max", "max_z"), r6("mean", "mean_z"), F.col("count").alias("n"))


RASTER_SQL = f"WITH {CELLS} SELECT row, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(avg(z), 6) AS mean_z, count(z) AS n FROM cells GROUP BY row"


def q_area_above(spark, sf_dir):
    return stability.area_above(scenario_probability(cells(spark, sf_dir)), ["scenario", "row"], "p").select("scenario", "row", r6("percent_above", "percent_above"))


AREA_SQL = f"WITH {CELLS}, {SCENARIO_ROWS}, {SCENARIO_P} SELECT scenario, row, round(avg(CASE WHEN p > 5e-1 THEN 1e2 ELSE 0e0 END), 6) AS percent_above FROM sp GROUP BY scenario, row"


def q_scenario_change(spark, sf_dir):
    out = stability.change(scenario_probability(cells(spark, sf_dir)), ["row", "col"], value="p")
    return out.select("row", "col", "scenario", r6("before", "before"), r6("after", "after"), r6("change", "change"))


CHANGES = """changes AS (SELECT a.row, a.col, a.scenario, b.p AS before, a.p AS after, a.p - b.p AS change
  FROM sp a JOIN sp b USING (row, col) WHERE a.scenario <> 'current' AND b.scenario = 'current')"""
CHANGE_SQL = f"WITH {CELLS}, {SCENARIO_ROWS}, {SCENARIO_P}, {CHANGES} SELECT row, col, scenario, round(before, 6) AS before, round(after, 6) AS after, round(change, 6) AS change FROM changes"


def q_change_statistics(spark, sf_dir):
    out = stability.change_statistics(stability.change(scenario_probability(cells(spark, sf_dir)), ["row", "col"], value="p"))
    return out.withColumn("mean_change", F.round("mean_change", 6))


CHANGE_STATISTICS_SQL = f"""WITH {CELLS}, {SCENARIO_ROWS}, {SCENARIO_P}, {CHANGES}
SELECT scenario, count(*) AS n_cells, count(*) FILTER (WHERE change > 1e-2) AS n_up, count(*) FILTER (WHERE change < -1e-2) AS n_down,
       count(*) FILTER (WHERE abs(change) > 1e-1) AS n_large, round(avg(change), 6) AS mean_change FROM changes GROUP BY scenario"""


def q_thumbnail(spark, sf_dir):
    return writers.thumbnail(cells(spark, sf_dir), "p", 7).select("row", "col", r6("p", "p"))


THUMBNAIL_SQL = f"WITH {CELLS} SELECT CAST(row // 7 AS INT) AS row, CAST(col // 7 AS INT) AS col, round(avg(p), 6) AS p FROM cells GROUP BY ALL"


def q_colour_ramp(spark, sf_dir):
    values = cells(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("n_cells"))
    return values.select(r6("p", "p"), "n_cells", *[scores.ramp(F.col("p"), k).alias(c) for k, c in enumerate(("red", "green", "blue"))])


def _ramp(k: int) -> str:
    parts = [f"WHEN p <= {b[0]!r} THEN {a[k + 1]} + (p - {a[0]!r}) / {b[0] - a[0]!r} * {b[k + 1] - a[k + 1]}" for a, b in zip(scores.RAMP, scores.RAMP[1:], strict=False)]
    return f"CAST(round(CASE {' '.join(parts)} END) AS INT)"


RAMP_SQL = f"WITH {CELLS} SELECT round(p, 6) AS p, count(*) AS n_cells, {_ramp(0)} AS red, {_ramp(1)} AS green, {_ramp(2)} AS blue FROM cells GROUP BY p"


def q_reclassify(spark, sf_dir):
    at = cells(spark, sf_dir)
    bands = scores.reclassify(F.col("p"), [(0.2, 1), (0.5, 2), (0.9, 3)])
    kinds = scores.remap((F.col("col") % 7).cast("int"), {0: "ice", 1: "rock", 2: "till"}, "other")
    return at.groupBy(bands.alias("class"), kinds.alias("kind")).agg(F.count(F.lit(1)).alias("n_cells"))


RECLASSIFY_SQL = f"""WITH {CELLS} SELECT CASE WHEN p <= 2e-1 THEN 1 WHEN p <= 5e-1 THEN 2 WHEN p <= 9e-1 THEN 3 END AS class,
CASE col % 7 WHEN 0 THEN 'ice' WHEN 1 THEN 'rock' WHEN 2 THEN 'till' ELSE 'other' END AS kind, count(*) AS n_cells FROM cells GROUP BY ALL"""

SOURCE, TARGET = Grid(0.0, -100.0, 100.0, 0.0, 1.0), Grid(-3.0, -90.0, 97.0, 10.0, 2.5)


def q_nearest_resample(spark, sf_dir):
    return sampling.nearest_resample(cells(spark, sf_dir), SOURCE, TARGET, "p").select("row", "col", r6("p", "p"))


RESAMPLE_SQL = f"""WITH {CELLS}, target AS (
  SELECT CAST(i // {TARGET.width} AS INT) AS row, CAST(i % {TARGET.width} AS INT) AS col FROM range({TARGET.width * TARGET.height}) AS t(i)),
placed AS (SELECT row, col, floor({SOURCE.north!r} - ({TARGET.north!r} - (row + 5e-1) * {TARGET.res!r})) AS r, floor({TARGET.west!r} + (col + 5e-1) * {TARGET.res!r} - {SOURCE.west!r}) AS c FROM target)
SELECT a.row, a.col, round(s.p, 6) AS p FROM placed a LEFT JOIN cells s ON s.row = r AND s.col = c AND r BETWEEN 0 AND {SOURCE.height - 1} AND c BETWEEN 0 AND {SOURCE.width - 1}"""


def q_bilinear_resample(spark, sf_dir):
    return sampling.bilinear_resample(cells(spark, sf_dir), SOURCE, TARGET, "p").select("row", "col", r6("p", "p"))


BILINEAR_SQL = f"""WITH {CELLS}, target AS (
  SELECT CAST(i // {TARGET.width} AS INT) AS row, CAST(i % {TARGET.width} AS INT) AS col FROM range({TARGET.width * TARGET.height}) AS t(i)),
placed AS (SELECT row, col, ({TARGET.west!r} + (col + 5e-1) * {TARGET.res!r} - {SOURCE.west!r}) - 5e-1 AS x,
  ({SOURCE.north!r} - ({TARGET.north!r} - (row + 5e-1) * {TARGET.res!r})) - 5e-1 AS y FROM target),
corner AS (
  SELECT a.row, a.col, p, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
  FROM placed a CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 0, 1]) AS dy)
  LEFT JOIN cells s ON s.row = floor(y) + dy AND s.col = floor(x) + dx)
SELECT row, col, round(sum(w * p) / nullif(sum(CASE WHEN p IS NOT NULL THEN w END), 0), 6) AS p FROM corner GROUP BY row, col"""

QUERIES = {
    "q_neighbours": (q_neighbours, NEIGHBOURS_SQL),
    "q_local_relief": (q_local_relief, LOCAL_RELIEF_SQL),
    "q_steepest_rise": (q_steepest_rise, STEEPEST_SQL),
    "q_dinf_direction": (q_dinf_direction, DIRECTION_SQL),
    "q_flow_edges": (q_flow_edges, FLOW_EDGES_SQL),
    "q_mass_balance": (q_mass_balance, MASS_SQL),
    "q_fill": (q_fill, FILL_SQL),
    "q_raised_cells": (q_raised_cells, RAISED_SQL),
    "q_catchment_area": (q_catchment_area, CATCHMENT_SQL),
    "q_raster_statistics": (q_raster_statistics, RASTER_SQL),
    "q_area_above": (q_area_above, AREA_SQL),
    "q_scenario_change": (q_scenario_change, CHANGE_SQL),
    "q_change_statistics": (q_change_statistics, CHANGE_STATISTICS_SQL),
    "q_thumbnail": (q_thumbnail, THUMBNAIL_SQL),
    "q_colour_ramp": (q_colour_ramp, RAMP_SQL),
    "q_reclassify": (q_reclassify, RECLASSIFY_SQL),
    "q_nearest_resample": (q_nearest_resample, RESAMPLE_SQL),
    "q_bilinear_resample": (q_bilinear_resample, BILINEAR_SQL),
}
