"""Inventories, settlements, roads and units from CSV, GeoJSON, Overpass JSON and GeoNames tables.

Rows that cannot be read as what they should be are left out, as are points without finite coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.scores import FOOTPRINT_M
from talweg.sources import json_arrays
from talweg.sources.shapefile import read_shapefile, shape_vertices

# Column names that are looked for, in this order, in any case; codes of places; road classes.
LATITUDES = ["latitude", "lat", "y", "ycoord", "y_coord"]
LONGITUDES = ["longitude", "lon", "long", "lng", "x", "xcoord", "x_coord"]
COUNTRIES = ["country_name", "country", "admin0", "cntry_name"]
UNIT_NAMES = ["name", "shapename", "name_1", "adm1_en", "adm1_name"]
UNIT_COUNTRIES = ["admin", "shapegroup", "name_0", "adm0_en", "country"]
ROAD_CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary"]
GEONAMES = ["geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country", "cc2", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "dem", "timezone", "modified"]
GEONAMES_PLACES = {"PPLC": "city", "PPLA": "city", "PPLA2": "town", "PPLA3": "town", "PPLA4": "town", "PPL": "village", "PPLX": "village", "PPLL": "hamlet"}

Box = tuple[float, float, float, float]


def _find(columns: list[str], names: list[str], required: bool = True) -> str | None:
    low = {c.strip().lower(): c for c in columns}
    found = next((low[n] for n in names if n in low), None)
    if required and found is None:
        raise ValueError(f"none of the columns {names} in {columns}")
    return found


def _in_box(points: DataFrame, box: Box | None) -> DataFrame:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = points.filter(finite(F.col("lon")) & finite(F.col("lat")))
    return points if box is None else points.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def csv_points(spark: SparkSession, path: str, box: Box | None = None, countries: list[str] | None = None) -> DataFrame:
    """(lon, lat) of a CSV with a header; the columns are found by name. ``countries`` ignores case."""
    rows = spark.read.option("header", True).csv(path)
    lat, lon = (F.col(f"`{_find(rows.columns, names)}`").try_cast("double") for names in (LATITUDES, LONGITUDES))
    country = _find(rows.columns, COUNTRIES, required=False)
    if countries and country:
        rows = rows.filter(F.lower(F.trim(F.col(f"`{country}`"))).isin([c.lower() for c in countries]))
    return _in_box(rows.select(lon.alias("lon"), lat.alias("lat")), box)


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, kind, coordinates) of a GeoJSON collection; properties a map, coordinates as JSON text.

    A large file is read by many tasks.
    """
    each = json_arrays.objects(spark, path).select(F.from_json("value", "type string, properties map<string,string>, geometry string").alias("f")).filter("coalesce(f.type, 'Feature') = 'Feature' AND (f.type IS NOT NULL OR f.geometry IS NOT NULL)")
    geometry = F.from_json(F.col("f.geometry"), "type string, coordinates string")
    return each.select(F.col("f.properties").alias("properties"), geometry["type"].alias("kind"), geometry["coordinates"].alias("coordinates"))


def vertices(coordinates: Column) -> Column:
    """All (lon, lat) pairs of a geometry of any depth, from its coordinates as JSON text."""
    pair = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    lon, lat = (F.regexp_extract_all(coordinates, F.lit(pair), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(lon.alias("a"), lat.alias("b")), lambda p: F.struct(p["a"].cast("double").alias("lon"), p["b"].cast("double").alias("lat")))


def geojson_points(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(lon, lat): a point of each feature, the mean of all coordinates of those that are no points."""
    from talweg.operators.sampling import representative_point

    point = representative_point(vertices(F.col("coordinates")))
    return _in_box(features(spark, path).select(point.alias("p")).select("p.lon", "p.lat"), box)


def shapefile_points(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(lon, lat): a point of each shape, the mean of all coordinates of those that are no points."""
    from talweg.operators.sampling import representative_point

    return _in_box(read_shapefile(spark, path).select(representative_point(shape_vertices()).alias("p")).select("p.lon", "p.lat"), box)


def inventory_points(spark: SparkSession, path: str, box: Box | None = None, countries: list[str] | None = None) -> DataFrame:
    """(lon, lat) of an inventory: GeoJSON, a shapefile or, with any other ending, CSV."""
    low = path.lower()
    if low.endswith((".geojson", ".json")):
        return geojson_points(spark, path, box)
    if low.endswith(".shp"):
        return shapefile_points(spark, path, box)
    if low.endswith((".gdb", ".gpkg", ".kml", ".kmz")):
        raise ValueError(f"{path}: only CSV, GeoJSON and shapefiles are read")
    return csv_points(spark, path, box, countries)


def line_roads(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(name, highway, coords) of the lines of one part in a shapefile of roads; the kind of road is its ``type``, else road."""
    rows = read_shapefile(spark, path, box).filter("kind = 'LineString'")
    own = lambda name: F.element_at("properties", name)
    return rows.select(F.coalesce(own("name"), F.lit("")).alias("name"), F.lower(F.coalesce(own("type"), F.lit("road"))).alias("highway"), F.col("parts")[0].alias("coords"))


def geojson_units(spark: SparkSession, path: str) -> DataFrame:
    """(name, country, west, south, east, north, rings) of polygon features."""
    rows = features(spark, path).filter(F.col("kind").isin("Polygon", "MultiPolygon"))
    first = lambda names: F.coalesce(*[F.element_at(F.transform_keys("properties", lambda k, _: F.lower(k)), n) for n in names])
    flat = vertices(F.col("coordinates"))
    edge = lambda f, c: f(F.transform(F.col("flat"), lambda p: p[c]))
    ring = "array<array<array<double>>>"
    polygons = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", ring))).otherwise(F.from_json("coordinates", f"array<{ring}>"))
    rings = F.transform(F.flatten(polygons), lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))
    known = rows.select(first(UNIT_NAMES).alias("name"), first(UNIT_COUNTRIES).alias("country"), flat.alias("flat"), rings.alias("rings"))
    return known.select("name", "country", edge(F.array_min, "lon").alias("west"), edge(F.array_min, "lat").alias("south"), edge(F.array_max, "lon").alias("east"), edge(F.array_max, "lat").alias("north"), "rings")


def people(text: Column) -> Column:
    """A population written with or without commas; NULL for what is no number."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("long")


OVERPASS = "type string, id long, lat double, lon double, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def _elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return json_arrays.objects(spark, path).select(F.from_json("value", OVERPASS).alias("e")).select("e.*").filter(F.col("type") == kind)


def overpass_settlements(spark: SparkSession, path: str, places: list[str] | None = None) -> DataFrame:
    """(name, lon, lat, place, population) of the place nodes of an Overpass answer."""
    tags = lambda k: F.element_at("tags", k)
    rows = _elements(spark, path, "node").filter(tags("place").isin(places or list(FOOTPRINT_M)))
    named = F.coalesce(tags("name:en"), tags("name"), F.lit("(unnamed)"))
    return _in_box(rows.select(named.alias("name"), "lon", "lat", tags("place").alias("place"), people(tags("population")).alias("population")), None)


def overpass_roads(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(name, highway, coords) of the ways of the wanted classes with two vertices at least."""
    tags = lambda k: F.element_at("tags", k)
    rows = _elements(spark, path, "way").filter(tags("highway").isin(classes or ROAD_CLASSES) & (F.size("geometry") >= 2))
    return rows.select(F.coalesce(tags("name:en"), tags("name"), F.lit("(unnamed)")).alias("name"), tags("highway").alias("highway"), F.transform("geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def geonames(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """(name, lon, lat, place, population) of the populated places of a GeoNames table; a population of 0 is unknown."""
    schema = ", ".join(f"{c} string" for c in GEONAMES)
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path).filter("feature_class = 'P'")
    places = F.create_map(*[F.lit(x) for pair in GEONAMES_PLACES.items() for x in pair])
    out = rows.select("name", F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"), F.coalesce(places[F.col("feature_code")], F.lit("village")).alias("place"), F.nullif(F.col("population").try_cast("long"), F.lit(0)).alias("population"))
    return _in_box(out, box)


def covers(have: list[str], want: list[str]) -> bool:
    """Whether a cache of some road classes serves a request for others."""
    return set(want) <= set(have)


def cached(spark: SparkSession, path: str, make, wanted: list[str] | None = None) -> DataFrame:
    """The table at ``path`` if it is there and has the wanted classes, else ``make()``, written there first."""
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = system.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(system)
    if there:
        table = spark.read.parquet(path)
        if wanted is None or covers([r[0] for r in table.select("cached_class").distinct().collect()], wanted):
            return table.drop("cached_class").filter(F.col("highway").isin(wanted)) if wanted is not None else table
    rows = make()
    if wanted is not None:  # classes without a road are in the cache too
        marks = spark.createDataFrame([(c,) for c in wanted], "cached_class string")
        rows = rows.withColumn("cached_class", F.col("highway")).unionByName(marks, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    return table if wanted is None else table.filter("highway IS NOT NULL").drop("cached_class")
