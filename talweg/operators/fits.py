"""Fitted parameters as a stored record, with what stands in where there is no fit, and stages kept by their inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.operators.hydrology import TILE
from talweg.operators.stability import Soil


def there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def store_fit(spark: SparkSession, path: str, soil: Soil, regions: dict[int, Soil] | None = None, reference_mm: float | None = None) -> None:
    """Writes a fit as one JSON record in the folder ``path``."""
    text = json.dumps({"parameters": asdict(soil), "region_parameters": {str(k): asdict(v) for k, v in sorted((regions or {}).items())}, "recharge_reference_mm": reference_mm}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_fit(spark: SparkSession, path: str | None, reference_mm: float | None = None) -> tuple[Soil, dict[int, Soil], float | None]:
    """(parameters, those of regions, the recharge's reference) of a stored fit; generic ranges where there is none."""
    if not path or not there(spark, path):
        return Soil(), {}, reference_mm
    raw = json.loads(spark.read.text(path).first().value)  # one record
    soil = lambda d: Soil(tuple(d["cohesion"]), tuple(d["friction_deg"]), tuple(d["rt"]), d.get("depth_k", 0.0))
    return soil(raw["parameters"]), {int(k): soil(v) for k, v in raw.get("region_parameters", {}).items()}, raw.get("recharge_reference_mm") or reference_mm


def fingerprints(cells: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """(grid_id, tile_row, tile_col, n, mark): the contents of each tile, in whatever order its cells come."""
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    one = lambda seed: F.lower(F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "row", "col", *columns))))
    return cells.groupBy("grid_id", at("row").alias("tile_row"), at("col").alias("tile_col")).agg(F.count(F.lit(1)).alias("n"), F.concat(one(1), F.lit("-"), one(2)).alias("mark"))


def fingerprint(tiles: DataFrame) -> str:
    """One mark of all tiles; a row of sums comes to the driver."""
    mark: Column = F.xxhash64("grid_id", "tile_row", "tile_col", "n", "mark")
    row = tiles.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), mark)).alias("b")).first()
    return hashlib.sha256(f"{row.n} {row.a} {row.b}".encode()).hexdigest()[:24]


def changed_tiles(before: DataFrame, now: DataFrame) -> DataFrame:
    """(grid_id, tile_row, tile_col) of tiles that are new, gone or have other contents."""
    keys = ["grid_id", "tile_row", "tile_col"]
    a, b = before.withColumnRenamed("mark", "was").drop("n"), now.withColumnRenamed("mark", "is").drop("n")
    return a.join(b, keys, "full").filter(~F.col("was").eqNullSafe(F.col("is"))).select(*keys)


def staged(cells: DataFrame, columns: list[str], folder: str, name: str, settings: dict, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(cells)`` from the folder, if it was made from cells of the same contents under the same settings.

    Else it is made and written there, whole or not at all, with the tiles' fingerprints beside it.
    """
    spark = cells.sparkSession
    tiles = fingerprints(cells, columns)
    key = hashlib.sha256(json.dumps([fingerprint(tiles), settings], sort_keys=True).encode()).hexdigest()[:24]
    path = f"{folder}/{name}-{key}"
    if not there(spark, f"{path}/_SUCCESS"):
        make(cells).write.mode("overwrite").parquet(path)
        tiles.write.mode("overwrite").parquet(f"{path}-tiles")
    return spark.read.parquet(path)
