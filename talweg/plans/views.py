"""Grids, samples, assets and units derived from the driver tables: for Spark, and as the same text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
DX, DY = 26.0, 30.0
#: Cohesion, friction angle and recharge ratio of twenty fixed draws.
DRAWS = [(round(0.01 + 0.012 * k, 6), 24.0 + (k * 7) % 20, round(0.0002 + 0.00021 * ((k * 3) % 20), 6)) for k in range(20)]
SCENARIOS = [("current", 1.0), ("ssp245_2041-2060", 1.4), ("ssp585_2081-2100", 2.5)]

# Integer division is `div` in Spark and `//` in DuckDB.
CELL_COLUMNS = {
    "row": "CAST(o_orderkey {div} 100 AS INT)",
    "col": "CAST(o_orderkey % 100 AS INT)",
    "z": "2000e0 - 12e0 * (o_orderkey {div} 100) + 15e-1 * (((o_orderkey % 100) * (o_orderkey % 100)) % 41) + o_totalprice / 1e4",
    "p": "((o_orderkey * 7919) % 101) / 1e2",
}
SAMPLE_COLUMNS = {
    "id": "o_orderkey",
    "slope": "tan(radians(10e0 + 45e0 * o_totalprice / 5e5))",
    "sca": "1e1 + (o_orderkey * 37) % 3000",
    "y": "o_orderstatus = 'F'",
    "region": "CAST(o_custkey % 6 AS INT)",
    "lon": "84e0 + (o_custkey % 200) / 1e2",
    "lat": "27e0 + (o_orderkey % 200) / 1e2",
    "years": "2e0 + o_orderkey % 499",
    "pga": "((o_orderkey * 13) % 100) / 1e2",
}
SETTLEMENT_COLUMNS = {
    "asset_id": "c_custkey",
    "name": "CASE WHEN c_custkey % 3 > 0 THEN c_name END",
    "place": "CASE c_mktsegment WHEN 'BUILDING' THEN 'city' WHEN 'AUTOMOBILE' THEN 'town' WHEN 'MACHINERY' THEN 'village' ELSE 'hamlet' END",
    "population": "CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) END AS BIGINT)",
    "cell": "(c_custkey * 37) % (SELECT count(*) FROM orders)",
}
TRACK_COLUMNS = {
    "asset_id": "user_id",
    "event_id": "event_id",
    "lon": "84e0 + (event_id % 997) / 4e3",
    "lat": "28e0 + ((event_id * 7) % 499) / 4e3",
}


def _sql(name: str, columns: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{x.format(div='//')} AS {c}" for c, x in columns.items()) + f" FROM {table})"


CELLS = _sql("cells", CELL_COLUMNS, "orders")
SAMPLES = _sql("samples", SAMPLE_COLUMNS, "orders")
PLACES = _sql("places", SETTLEMENT_COLUMNS, "customer")
SETTLEMENTS = f"{PLACES},\nsettlements AS (SELECT asset_id, name, place, population, CAST(cell // {WIDTH} AS INT) AS row, CAST(cell % {WIDTH} AS INT) AS col FROM places)"
TRACKS = _sql("tracks", TRACK_COLUMNS, "events")
DRAW_ROWS = "draws AS (SELECT * FROM (VALUES " + ", ".join(f"({c:e}, {p:e}, {r:e})" for c, p, r in DRAWS) + ") AS d(c, p, r))"
SCENARIO_ROWS = "scenarios AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {m:e})" for s, m in SCENARIOS) + ") AS s(scenario, multiplier))"
UNITS = """units AS (
  SELECT n_nationkey AS id, r_name AS country, n_name AS name, 80e0 + (n_nationkey % 5) * 2 AS west, 26e0 + (n_nationkey % 3) AS south,
         80e0 + (n_nationkey % 5) * 2 + 1 + n_nationkey % 4 AS east, 27e0 + (n_nationkey % 3) + (n_nationkey % 7) / 1e1 AS north
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(x.format(div="div")).alias(c) for c, x in columns.items()])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid, a cell for each order: row, col, z, and a probability p."""
    return _view(table(spark, sf_dir, "orders"), CELL_COLUMNS).withColumn("grid_id", F.lit(0))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "orders"), SAMPLE_COLUMNS)


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    columns = SETTLEMENT_COLUMNS | {"cell": f"(c_custkey * 37) % {n}"}
    placed = _view(table(spark, sf_dir, "customer"), columns)
    return placed.select("asset_id", "name", "place", "population", F.expr(f"CAST(cell div {WIDTH} AS INT)").alias("row"), F.expr(f"CAST(cell % {WIDTH} AS INT)").alias("col"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, coords): a line for each user, through the events in order."""
    points = _view(table(spark, sf_dir, "events"), TRACK_COLUMNS)
    listed = points.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "lon", "lat"))).alias("v"))
    return listed.select("asset_id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return met.selectExpr(
        "n_nationkey AS id",
        "r_name AS country",
        "n_name AS name",
        "80e0 + (n_nationkey % 5) * 2 AS west",
        "26e0 + (n_nationkey % 3) AS south",
        "80e0 + (n_nationkey % 5) * 2 + 1 + n_nationkey % 4 AS east",
        "27e0 + (n_nationkey % 3) + (n_nationkey % 7) / 1e1 AS north",
    )


def scenario_probability(cells: DataFrame) -> DataFrame:
    """(row, col, scenario, p): the grid's probability under each scenario, up to 1."""
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(m).alias("m")) for s, m in SCENARIOS])
    return cells.select("row", "col", "p", F.explode(rows).alias("s")).select("row", "col", "s.scenario", F.least(F.col("p") * F.col("s.m"), F.lit(1.0)).alias("p"))


SCENARIO_P = "sp AS (SELECT row, col, scenario, least(p * multiplier, 1e0) AS p FROM cells CROSS JOIN scenarios)"
