"""Queries on readers and writers of tables, collections and records, on files written from the driver tables, and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions.scores import FOOTPRINT_M
from talweg.operators import sampling, stability, sweep
from talweg.operators.stability import Soil
from talweg.plans import views as V
from talweg.plans.mechanics import fs_sql
from talweg.plans.runs import POINTS_SQL, _folder
from talweg.plans.terrain import r6
from talweg.plans.views import CELLS, SAMPLES, SCENARIO_P, SCENARIO_ROWS, SETTLEMENTS, TRACKS, UNITS, table
from talweg.sources import readers, writers
from talweg.streaming import exposure

BOX = (84.2, 27.1, 85.5, 28.7)
COUNTRIES = ["nation_3", "NATION_7", "nation_11", "NATION_12"]
PLACED = "SELECT c_custkey AS id, 84e0 + (c_custkey % 200) / 1e2 AS lon, 27e0 + (c_custkey * 7 % 200) / 1e2 AS lat, 'nation_' || c_nationkey AS country FROM customer"


def _placed(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "84e0 + (c_custkey % 200) / 1e2 AS lon", "27e0 + (c_custkey * 7 % 200) / 1e2 AS lat", "concat('nation_', c_nationkey) AS country")


def q_csv_points(spark, sf_dir):
    """Points of a CSV inside a box and some countries."""
    path = _folder(spark)
    rows = _placed(spark, sf_dir).select("id", F.col("lat").alias("Latitude"), F.col("lon").alias("LONGITUDE"), F.col("country").alias("country_name"))
    rows.write.option("header", True).csv(path)
    found = readers.inventory_points(spark, path, BOX, COUNTRIES)
    return found.groupBy(r6("lon", "lon"), r6("lat", "lat")).agg(F.count(F.lit(1)).alias("n"))


CSV_SQL = f"""SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, count(*) AS n FROM ({PLACED})
WHERE lon BETWEEN {BOX[0]!r} AND {BOX[2]!r} AND lat BETWEEN {BOX[1]!r} AND {BOX[3]!r} AND country IN ('nation_3', 'nation_7', 'nation_11', 'nation_12') GROUP BY ALL"""


def q_geojson_points(spark, sf_dir):
    """A point of each line of a GeoJSON collection, counted by hundredths of a degree."""
    path = _folder(spark)
    writers.write_features(writers.line_features(V.tracks(spark, sf_dir), ["asset_id"]), path)
    points = readers.geojson_points(spark, path)
    return points.groupBy(F.floor(F.col("lon") * 100 + 1e-7).alias("x"), F.floor(F.col("lat") * 100 + 1e-7).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def q_geojson_units(spark, sf_dir):
    """Names, countries and bounds of polygons."""
    path = _folder(spark)
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(*[corner(a, b) for a, b in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("name", F.col("country").alias("admin")).alias("properties")))
    writers.write_features(V.units(spark, sf_dir).select(feature.alias("feature")), path)
    return readers.geojson_units(spark, path).select("name", "country", *[r6(c, c) for c in ("west", "south", "east", "north")], F.size(F.get("rings", F.lit(0))).alias("n"))


GEOJSON_UNITS_SQL = f"WITH {UNITS} SELECT name, country, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, 5 AS n FROM units"


def q_overpass_settlements(spark, sf_dir):
    """Places of an Overpass answer; hamlets are not asked for."""
    path = _folder(spark)
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("place"), F.col("place"), F.lit("population"), F.format_number("population", 0)), lambda k, v: v.isNotNull())
    node = F.struct(F.lit("node").alias("type"), F.col("asset_id").alias("id"), (27 + F.col("row") / 1e3).alias("lat"), (84 + F.col("col") / 1e3).alias("lon"), tags.alias("tags"))
    writers.write_objects(V.settlements(spark, sf_dir).select(F.to_json(node).alias("object")), path, '{"version": 0.6, "elements": [')
    wanted = [p for p in FOOTPRINT_M if p != "hamlet"]
    return readers.overpass_settlements(spark, path, wanted).select("name", "place", "population", r6("lon", "lon"), r6("lat", "lat"))


OVERPASS_SQL = f"""WITH {SETTLEMENTS} SELECT coalesce(name, '(unnamed)') AS name, place, population, round(84 + col / 1e3, 6) AS lon, round(27 + row / 1e3, 6) AS lat
FROM settlements WHERE place <> 'hamlet'"""

CLASSES = ["primary", "secondary", "service", "trunk"]


def _roads(spark, sf_dir):
    lines = V.tracks(spark, sf_dir)
    return lines.withColumn("highway", F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("asset_id") % 4 + 1).cast("int")))


def _write_ways(spark, sf_dir) -> str:
    path = _folder(spark)
    tags = F.create_map(F.lit("name"), F.col("asset_id").cast("string"), F.lit("highway"), F.col("highway"))
    way = F.struct(F.lit("way").alias("type"), F.col("asset_id").alias("id"), tags.alias("tags"), F.transform("coords", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))
    writers.write_objects(_roads(spark, sf_dir).select(F.to_json(way).alias("object")), path, '{"elements": [')
    return path


def q_overpass_roads(spark, sf_dir):
    """Ways of the main classes with two vertices at least."""
    found = readers.overpass_roads(spark, _write_ways(spark, sf_dir))
    return found.select(F.col("name").cast("long").alias("asset_id"), "highway", F.size("coords").alias("n"))


def q_cached_roads(spark, sf_dir):
    """The same from a cache of two classes, of which one is asked for the second time."""
    path, cache = _write_ways(spark, sf_dir), _folder(spark)
    make = lambda: readers.overpass_roads(spark, path, ["primary", "trunk"])
    first = readers.cached(spark, cache, make, ["primary", "trunk"])
    again = readers.cached(spark, cache, lambda: make().limit(0), ["trunk"])
    both = first.withColumn("turn", F.lit(1)).unionByName(again.withColumn("turn", F.lit(2)))
    return both.groupBy("turn", "highway").agg(F.count(F.lit(1)).alias("n_roads"), F.sum(F.size("coords")).alias("n_vertices"))


ROADS = f"{TRACKS}, roads AS (SELECT asset_id, ['primary', 'secondary', 'service', 'trunk'][asset_id % 4 + 1] AS highway, count(*) AS n FROM tracks GROUP BY asset_id HAVING count(*) >= 2)"
OVERPASS_ROADS_SQL = f"WITH {ROADS} SELECT asset_id, highway, CAST(n AS INT) AS n FROM roads WHERE highway <> 'service'"
CACHED_SQL = f"""WITH {ROADS} SELECT turn, highway, count(*) AS n_roads, CAST(sum(n) AS BIGINT) AS n_vertices FROM roads
JOIN (VALUES (1, 'primary'), (1, 'trunk'), (2, 'trunk')) AS t(turn, kind) ON highway = kind GROUP BY ALL"""


def q_geonames(spark, sf_dir):
    """Populated places of a GeoNames table; a population of 0 is unknown."""
    path = _folder(spark)
    rows = V.settlements(spark, sf_dir)
    code = F.element_at(F.create_map(*[F.lit(x) for x in ("city", "PPLC", "town", "PPLA2", "village", "PPL", "hamlet", "PPLL")]), F.col("place"))
    given = {"geonameid": F.col("asset_id"), "name": F.coalesce("name", F.lit("x")), "latitude": 27 + F.col("row") / 1e3, "longitude": 84 + F.col("col") / 1e3, "feature_class": F.when(F.col("asset_id") % 5 == 0, "H").otherwise("P"), "feature_code": code, "population": F.coalesce("population", F.lit(0))}
    rows.select(*[given.get(c, F.lit("")).cast("string").alias(c) for c in readers.GEONAMES]).write.option("sep", "\t").option("emptyValue", "").csv(path)
    return readers.geonames(spark, path).select("name", "place", "population", r6("lon", "lon"), r6("lat", "lat"))


GEONAMES_SQL = f"""WITH {SETTLEMENTS} SELECT coalesce(name, 'x') AS name, place, nullif(population, 0) AS population, round(84 + col / 1e3, 6) AS lon, round(27 + row / 1e3, 6) AS lat
FROM settlements WHERE asset_id % 5 <> 0"""


def _scored(spark, sf_dir):
    p = V.scenario_probability(V.cells(spark, sf_dir))
    met = V.settlements(spark, sf_dir).select("asset_id", "row", "col").join(p, ["row", "col"])
    return met.select("asset_id", "row", "col", "scenario", F.col("p").alias("score"), (F.col("p") / 2).alias("on_site"), F.col("p").alias("reaching"))


def q_asset_records(spark, sf_dir):
    """Each asset's nested JSON record, taken apart again."""
    text = writers.records(_scored(spark, sf_dir))
    kind = "asset_id long, score double, scenarios map<string, struct<score: double, on_site: double, reaching: double>>"
    parsed = text.select(F.from_json("record", kind).alias("r"))
    each = parsed.select("r.asset_id", F.col("r.score").alias("top"), F.explode("r.scenarios").alias("scenario", "v"))
    return each.select("asset_id", "scenario", r6("top", "top"), r6("v.score", "score"), r6("v.on_site", "on_site"))


RECORDS_SQL = f"""WITH {CELLS}, {SETTLEMENTS}, {SCENARIO_ROWS}, {SCENARIO_P}, scored AS (SELECT asset_id, scenario, p FROM settlements JOIN sp USING (row, col))
SELECT asset_id, scenario, round(max(CASE WHEN scenario = 'current' THEN p END) OVER (PARTITION BY asset_id), 6) AS top, round(p, 6) AS score, round(p / 2, 6) AS on_site FROM scored"""


def q_complete_rows(spark, sf_dir):
    """Samples with a finite value in every column."""
    rows = V.samples(spark, sf_dir).select("id", "slope", F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 11 > 0, F.col("sca")).otherwise(float("nan"))).alias("sca"), F.when(F.col("id") % 13 > 0, F.col("pga")).otherwise(float("inf")).alias("pga"))
    return sampling.complete(rows, ["slope", "sca", "pga"]).select("id", r6("sca", "sca"))


COMPLETE_SQL = f"WITH {SAMPLES} SELECT id, round(CAST(sca AS DOUBLE), 6) AS sca FROM samples WHERE id % 7 > 0 AND id % 11 > 0 AND id % 13 > 0"

SOIL, N_DRAWS = Soil(), 12


def q_scenario_multiply(spark, sf_dir):
    """Mean probability of every scenario over cells routed once."""
    layers = V.samples(spark, sf_dir).select(F.lit(0).alias("grid_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), "slope", "sca")
    scenarios = spark.createDataFrame([(s, m, 0.05 * k) for k, (s, m) in enumerate(V.SCENARIOS)], "scenario string, multiplier double, k_h double")
    out = sweep.scenario_probabilities(layers, scenarios, SOIL, N_DRAWS)
    return out.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p"), "mean"), F.count_if(F.col("p") > 0.5).alias("n_over_half"))


_DRAWN = ", ".join(f"({c!r}::DOUBLE, {p!r}::DOUBLE, {r!r}::DOUBLE)" for c, p, r in stability.draws(SOIL, N_DRAWS, 0).tolist())
MULTIPLY_SQL = f"""WITH {SAMPLES}, drawn AS (SELECT * FROM (VALUES {_DRAWN}) AS d(c, p, r)), terms AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {m!r}::DOUBLE, {0.05 * k!r}::DOUBLE)" for k, (s, m) in enumerate(V.SCENARIOS))}) AS t(scenario, m, k)),
prob AS (SELECT id, scenario, count(*) FILTER (WHERE {fs_sql(r='(r * m)', k='k')} < 1) / {N_DRAWS}e0 AS p FROM samples CROSS JOIN terms CROSS JOIN drawn GROUP BY id, scenario)
SELECT scenario, count(*) AS n, round(avg(p), 6) AS mean, count(*) FILTER (WHERE p > 5e-1) AS n_over_half FROM prob GROUP BY scenario"""


def q_ranked_index(spark, sf_dir):
    """Every nation with the share of its samples over one half, 0 where it has none."""
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = met.filter("c_nationkey < 20").groupBy(F.col("c_nationkey").cast("string").alias("slug")).agg(F.avg(F.when(F.col("o_totalprice") > 250_000, 100.0).otherwise(0.0)).alias("unstable_percent"))
    every = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("slug"))
    return sweep.ranked_index(known, every).select("slug", r6("unstable_percent", "unstable_percent"))


RANKED_SQL = """WITH known AS (SELECT CAST(c_nationkey AS VARCHAR) AS slug, avg(CASE WHEN o_totalprice > 250000 THEN 1e2 ELSE 0e0 END) AS u FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20 GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS slug, round(coalesce(u, 0e0), 6) AS unstable_percent FROM nation LEFT JOIN known ON slug = CAST(n_nationkey AS VARCHAR)"""


def q_stream_exposure(spark, sf_dir):
    """Settlements that arrive as files, scored as a stream against the cells' scores."""
    arrived, out, state = _folder(spark), _folder(spark), _folder(spark)
    rows = V.settlements(spark, sf_dir).select("asset_id", "name", "row", "col", F.timestamp_seconds(F.col("asset_id") * 60).alias("seen"))
    rows.repartition(3).write.json(arrived)
    scores = V.scenario_probability(V.cells(spark, sf_dir)).withColumnRenamed("p", "score")
    exposure.write_scores(exposure.scored_stream(spark, arrived, scores), out, state).awaitTermination()
    return spark.read.parquet(out).select("asset_id", "scenario", r6("score", "score"))


STREAM_SQL = f"WITH {CELLS}, {SETTLEMENTS}, {SCENARIO_ROWS}, {SCENARIO_P} SELECT asset_id, scenario, round(p, 6) AS score FROM settlements JOIN sp USING (row, col)"

QUERIES = {
    "q_csv_points": (q_csv_points, CSV_SQL),
    "q_geojson_points": (q_geojson_points, POINTS_SQL),
    "q_geojson_units": (q_geojson_units, GEOJSON_UNITS_SQL),
    "q_overpass_settlements": (q_overpass_settlements, OVERPASS_SQL),
    "q_overpass_roads": (q_overpass_roads, OVERPASS_ROADS_SQL),
    "q_cached_roads": (q_cached_roads, CACHED_SQL),
    "q_geonames": (q_geonames, GEONAMES_SQL),
    "q_asset_records": (q_asset_records, RECORDS_SQL),
    "q_complete_rows": (q_complete_rows, COMPLETE_SQL),
    "q_scenario_multiply": (q_scenario_multiply, MULTIPLY_SQL),
    "q_ranked_index": (q_ranked_index, RANKED_SQL),
    "q_stream_exposure": (q_stream_exposure, STREAM_SQL),
}
