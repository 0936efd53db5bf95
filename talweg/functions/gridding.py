"""Grids of square degree cells, north up, and where points lie in them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.scores import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON


@dataclass(frozen=True)
class Grid:
    """Anchored at its west and north edges; the others follow from whole cells."""

    west: float
    south: float
    east: float
    north: float
    res: float

    @property
    def width(self) -> int:
        return max(1, round((self.east - self.west) / self.res))

    @property
    def height(self) -> int:
        return max(1, round((self.north - self.south) / self.res))

    def metres(self) -> tuple[float, float]:
        """Width and height of a cell at the grid's middle latitude."""
        middle = math.radians((self.south + self.north) / 2)
        return self.res * METRES_PER_DEGREE_LON * max(math.cos(middle), 1e-6), self.res * METRES_PER_DEGREE_LAT

    def cells(self, spark: SparkSession, **layers: Column) -> DataFrame:
        """All cells (row, col) with constant or computed ``layers``."""
        numbered = spark.range(self.width * self.height)
        at = numbered.select((F.col("id") / self.width).cast("long").cast("int").alias("row"), F.pmod("id", F.lit(self.width)).cast("int").alias("col"))
        return at.withColumns(layers) if layers else at


def sample_cell(lon: Column, lat: Column, grid: Grid) -> tuple[Column, Column]:
    """(row, col) of a point for sampling: floored, NULL outside the grid."""
    row, col = F.floor((F.lit(grid.north) - lat) / grid.res), F.floor((lon - grid.west) / grid.res)
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    return F.when(inside, row.cast("int")), F.when(inside, col.cast("int"))


def asset_cell(lon: Column, lat: Column, grid: Grid) -> tuple[Column, Column]:
    """(row, col) of an asset: truncated toward zero, so a point just west or north of the grid is in its edge."""
    row, col = ((F.lit(grid.north) - lat) / grid.res).cast("int"), ((lon - grid.west) / grid.res).cast("int")
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    return F.when(inside, row), F.when(inside, col)


def cell_centre(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    return F.lit(grid.west) + (col + 0.5) * grid.res, F.lit(grid.north) - (row + 0.5) * grid.res


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (west, south, east, north) share an area."""
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


def tile_names(west: float, south: float, east: float, north: float, step: int = 1) -> list[str]:
    """Names such as ``N28_E084`` of the tiles of ``step`` degrees that a box needs."""
    first = lambda x: math.floor(x / step) * step
    lats = range(first(south), math.ceil(north - 1e-9), step)
    lons = range(first(west), math.ceil(east - 1e-9), step)
    return [f"{'N' if a >= 0 else 'S'}{abs(a):02d}_{'E' if o >= 0 else 'W'}{abs(o):03d}" for a in lats for o in lons]
