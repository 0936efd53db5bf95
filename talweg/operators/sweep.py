"""The chain for many units at once: routing, probability, scenarios, exposure, and the records of what is done."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators import hydrology, stability, units
from talweg.session import cut, stored


def susceptibility(cells: DataFrame, dx: float, dy: float, soil: stability.Soil, n_draws: int = 100, seed: int = 0, tile: int = hydrology.TILE) -> DataFrame:
    """(grid_id, row, col, slope, sca, probability, class) of every grid in ``cells``: all of them in the same jobs."""
    routed = hydrology.specific_catchment_area(cells, dx, dy, tile)
    layers = routed.select("grid_id", "row", "col", "slope", "sca")
    return stability.classes(layers, soil, stability.draws(soil, n_draws, seed))


def scenario_probabilities(layers: DataFrame, scenarios: DataFrame, soil: stability.Soil, n_draws: int = 100, seed: int = 0) -> DataFrame:
    """(grid_id, row, col, scenario, p): ``scenarios`` (scenario, multiplier, k_h) are a few rows, a row per cell and scenario out."""
    met = layers.select("grid_id", "row", "col", "slope", "sca").join(F.broadcast(scenarios.withColumnRenamed("multiplier", "recharge")))
    found = stability.failure_probability(met, stability.draws(soil, n_draws, seed), soil.depth_k, "p")
    return found.select("grid_id", "row", "col", "scenario", "p")


def missing_scenarios(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Scenarios that are wanted and of which no cell is there yet."""
    return wanted.join(present.select("scenario").distinct(), "scenario", "left_anti")


def run_units(cells: DataFrame, records: DataFrame, dx: float, dy: float, soil: stability.Soil, max_cells: int = units.MAX_CELLS) -> tuple[DataFrame, DataFrame]:
    """Works off the units that ``records`` (slug, stage, errors, written) has not as done: their statistics, and new records.

    ``cells`` (grid_id the slug, row, col, z). Units with too many cells are recorded as failed, the others are all
    routed in the same jobs; what was done before is not done again.
    """
    sizes = cut(cells.groupBy(F.col("grid_id").alias("slug")).agg(F.count(F.lit(1)).alias("n_cells")))
    wanted = cells.sparkSession.createDataFrame([("susceptibility",)], "stage string")
    left = units.missing_stages(sizes, wanted, records).join(sizes, "slug")
    fits = left.filter(F.col("n_cells") <= max_cells)
    chosen = cells.join(fits.select(F.col("slug").alias("grid_id")), "grid_id", "left_semi")
    done = stored(susceptibility(chosen, dx, dy, soil))
    statistics = units.unit_statistics(done.withColumnRenamed("grid_id", "slug"), ["slug"])
    large = left.filter(F.col("n_cells") > max_cells).select("slug", "stage", F.array(F.lit("too many cells")).alias("errors"))
    good = fits.select("slug", "stage", F.array().cast("array<string>").alias("errors"))
    return statistics, good.unionByName(large).withColumn("written", F.current_timestamp())


def ranked_index(statistics: DataFrame, known: DataFrame) -> DataFrame:
    """Units by unstable share, the greatest first, unknown as 0."""
    met = known.select("slug").join(statistics, "slug", "left")
    return met.withColumn("unstable_percent", F.coalesce("unstable_percent", F.lit(0.0))).orderBy(F.desc("unstable_percent"), "slug")


def synthetic_terrain(spark, height: int, width: int, seed: int = 7, octaves: int = 6) -> DataFrame:
    """(grid_id, row, col, z): layers of smooth noise, scaled to 500..4500 m; for demonstrations, not for data.

    Tasks make the cells from their numbers and the coarse lattices, whose size does not grow with the grid.
    """
    rng = np.random.default_rng(seed)
    lattices = [rng.standard_normal((n, n)) for n in (2 ** (k + 1) + 1 for k in range(octaves))]

    def noise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col = np.divmod(batch.column(0).to_numpy(), width)
            z = np.zeros(len(row))
            for k, coarse in enumerate(lattices):
                end = len(coarse) - 1.001
                r, c = row * (end / max(height - 1, 1)), col * (end / max(width - 1, 1))
                i, j = r.astype(int), c.astype(int)
                west = coarse[i, j] + (r - i) * (coarse[i + 1, j] - coarse[i, j])
                east = coarse[i, j + 1] + (r - i) * (coarse[i + 1, j + 1] - coarse[i, j + 1])
                z += 0.5**k * (west + (c - j) * (east - west))
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(z)], ["row", "col", "z"])

    raw = spark.range(height * width).mapInArrow(noise, "row int, col int, z double")
    low, high = raw.agg(F.min("z"), F.max("z")).first()
    span = ((high - low) or 1.0) if high is not None else 1.0
    return raw.select(F.lit(0).alias("grid_id"), "row", "col", (F.lit(500.0) + (F.col("z") - F.lit(low)) * (4000.0 / span)).alias("z"))
