"""Queries on made-up inputs over the cells, stored fits and stages kept by their grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.functions import triggers
from talweg.operators import fits, stability, stencil, synthetic
from talweg.operators.stability import Soil
from talweg.plans import views as V
from talweg.plans.mechanics import fs_sql
from talweg.plans.runs import _folder, _grid
from talweg.plans.terrain import r6
from talweg.plans.views import CELLS, SAMPLES, WIDTH

RELIEF, NOISE = "p", "((row * 7 + col * 13) % 97) / 97e0"


def _layers(spark, sf_dir):
    cells = V.cells(spark, sf_dir).withColumn("noise", F.expr(NOISE))
    return synthetic.inputs(cells.withColumn("z", F.col("z") * 2 - 2500), WIDTH, RELIEF)


def q_synthetic_inputs(spark, sf_dir):
    """Land cover, rock and acceleration of every cell."""
    return _layers(spark, sf_dir).select("row", "col", "landcover", "lithology", r6("pga", "pga"))


LAYERS = f"""raised AS (SELECT row, col, p, z * 2 - 2500 AS z, {NOISE} AS noise FROM cells),
covered AS (SELECT *, CASE WHEN p < 5e-2 THEN 80 WHEN z >= 4800 THEN 70 WHEN z >= 4000 THEN 60 WHEN z >= 2500 THEN 20 WHEN z >= 800 THEN 10 ELSE 40 END AS landcover FROM raised)"""
INPUTS_SQL = f"""WITH {CELLS}, {LAYERS} SELECT row, col, landcover, CASE WHEN landcover = 80 THEN 15 WHEN noise < 3e-1 THEN 11 WHEN noise > 6e-1 THEN 2 ELSE 9 END AS lithology,
round(5e-2 + 5e-1 * (col / {WIDTH - 1}) * (5e-1 + 5e-1 * p), 6) AS pga FROM covered"""

FUTURES = ["current", "ssp245:2041-2060", "ssp585:2081-2100", "ssp370"]


def q_synthetic_rain(spark, sf_dir):
    """Mean rain of each month under the present and made-up futures."""
    asked = spark.createDataFrame([(x,) for x in FUTURES], "text string")
    pathway, period = triggers.scenario_parts(F.col("text"))
    factors = asked.select(triggers.scenario_key(pathway, period).alias("scenario"), synthetic.wetting(pathway, period).alias("factor"))
    met = V.cells(spark, sf_dir).select("row", "col", "p").crossJoin(F.broadcast(factors))  # four rows
    rain = synthetic.monthly_rain(met, RELIEF, F.col("factor"))
    return rain.groupBy("scenario", "band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mm"), "mm"))


RAIN_SQL = f"""WITH {CELLS}, factors AS (SELECT * FROM (VALUES ('current', 1e0), ('ssp245_2041-2060', 1 + 9e-2 * 2 / 4), ('ssp585_2081-2100', 1 + 20e-2 * 4 / 4), ('ssp370_2041-2060', 1 + 14e-2 * 2 / 4)) AS f(scenario, factor)),
shares AS (SELECT unnest(range(1, 13)) AS band, unnest([3e-1, 35e-2, 5e-1, 8e-1, 14e-1, 26e-1, 32e-1, 30e-1, 18e-1, 9e-1, 4e-1, 3e-1]) AS share)
SELECT scenario, CAST(band AS INT) AS band, count(*) AS n, round(avg((40 + 260 * p) * factor * share), 6) AS mm FROM cells CROSS JOIN factors CROSS JOIN shares GROUP BY scenario, band"""


def q_constant_layer(spark, sf_dir):
    """A layer of one value over the cells' grid, met with the cells."""
    layer = _grid(spark, sf_dir).cells(spark, value=F.lit(3.5))
    return V.cells(spark, sf_dir).join(layer, ["row", "col"], "left").groupBy("row").agg(F.count("value").alias("n"), r6(F.sum("value"), "total"))


CONSTANT_SQL = f"WITH {CELLS} SELECT row, count(*) AS n, round(35e-1 * count(*), 6) AS total FROM cells GROUP BY row"

STORED = Soil((0.05, 0.05), (30.0, 30.0), (0.002, 0.002))
OWN = {2: Soil((0.15, 0.15), (36.0, 36.0), (0.001, 0.001))}


def q_stored_fit(spark, sf_dir):
    """Samples under parameters that were stored and loaded, a region's own ones where it has them."""
    path = _folder(spark)
    fits.store_fit(spark, path, STORED, OWN, 120.0)
    soil, regions, _ = fits.load_fit(spark, path)
    tables = {r: stability.draws(s, 1) for r, s in regions.items()}
    out = stability.regional_failure_probability(V.samples(spark, sf_dir).select("id", "slope", "sca", "region"), tables, stability.draws(soil, 1))
    return out.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").cast("long").alias("n_failed"))


STORED_SQL = f"""WITH {SAMPLES}, met AS (SELECT *, CASE WHEN region = 2 THEN 15e-2 ELSE 5e-2 END AS c, CASE WHEN region = 2 THEN 36e0 ELSE 30e0 END AS p, CASE WHEN region = 2 THEN 1e-3 ELSE 2e-3 END AS r FROM samples)
SELECT region, count(*) AS n, count(*) FILTER (WHERE {fs_sql()} < 1) AS n_failed FROM met GROUP BY region"""


def q_staged_relief(spark, sf_dir):
    """The relief of a grid as a stage: made once, read the second time."""
    folder, cells = _folder(spark), V.cells(spark, sf_dir).select("grid_id", "row", "col", "z")
    make = lambda df: stencil.local_relief(df).select("row", "col", "relief")
    fits.staged(cells, ["z"], folder, "relief", {"size": 3}, make)
    again = fits.staged(cells.repartition(3), ["z"], folder, "relief", {"size": 3}, lambda df: make(df).limit(0))
    return again.select("row", "col", r6("relief", "relief"))


STAGED_SQL = f"""WITH {CELLS} SELECT a.row, a.col, round(max(b.z) - min(b.z), 6) AS relief FROM cells a
JOIN (SELECT unnest([-1, 0, 1]) AS dr) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dc) ON true
JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.row, a.col"""

QUERIES = {
    "q_synthetic_inputs": (q_synthetic_inputs, INPUTS_SQL),
    "q_synthetic_rain": (q_synthetic_rain, RAIN_SQL),
    "q_constant_layer": (q_constant_layer, CONSTANT_SQL),
    "q_stored_fit": (q_stored_fit, STORED_SQL),
    "q_staged_relief": (q_staged_relief, STAGED_SQL),
}
