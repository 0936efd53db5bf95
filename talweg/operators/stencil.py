"""Neighbours of grid cells (grid_id, row, col, ...): all rows of a grid are there, nodata being NULL.

The neighbours come by ``lag`` and ``lead`` along rows and then along columns, so each direction is one shuffle on
(grid_id, row) or (grid_id, col) and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name: (row step, column step), in the order in which ties go to the first.
NEIGHBOURS = {"E": (0, 1), "NE": (-1, 1), "N": (-1, 0), "NW": (-1, -1), "W": (0, -1), "SW": (1, -1), "S": (1, 0), "SE": (1, 1)}



def along(fixed: str, moving: str):
    return Window.partitionBy("grid_id", fixed).orderBy(moving)


def with_neighbours(cells: DataFrame, value: str = "z", replicate: bool = False) -> DataFrame:
    """``cells`` and the columns ``value_E`` ... ``value_SE``; beyond the grid NULL, or with ``replicate`` the edge's."""
    along_row, along_col = along("row", "col"), along("col", "row")

    def inside(order, step: Column, back: bool, own: Column) -> Column:
        # an edge cell is told by its place, since a NULL neighbour may be nodata
        beyond = F.row_number().over(order) == 1 if back else F.lead(F.lit(1)).over(order).isNull()
        return F.when(beyond, own).otherwise(step) if replicate else step

    own = F.col(value)
    across = cells.select(
        "*",
        inside(along_row, F.lag(value).over(along_row), True, own).alias(f"{value}_W"),
        inside(along_row, F.lead(value).over(along_row), False, own).alias(f"{value}_E"),
    )
    out = across
    for north, south, of in ((f"{value}_N", f"{value}_S", value), (f"{value}_NW", f"{value}_SW", f"{value}_W"), (f"{value}_NE", f"{value}_SE", f"{value}_E")):
        out = out.withColumns(
            {
                north: inside(along_col, F.lag(of).over(along_col), True, F.col(of)),
                south: inside(along_col, F.lead(of).over(along_col), False, F.col(of)),
            }
        )
    return out.select(*cells.columns, *[f"{value}_{k}" for k in NEIGHBOURS])


def local_relief(cells: DataFrame, value: str = "z") -> DataFrame:
    """(grid_id, row, col, relief): the range of the 3x3 cells around, of those with data; 0 if none has."""
    near_row, near_col = along("row", "col").rowsBetween(-1, 1), along("col", "row").rowsBetween(-1, 1)
    across = cells.select("grid_id", "row", "col", F.max(value).over(near_row).alias("high"), F.min(value).over(near_row).alias("low"))
    return across.select("grid_id", "row", "col", F.coalesce(F.max("high").over(near_col) - F.min("low").over(near_col), F.lit(0.0)).alias("relief"))


def steepest_rise(cells: DataFrame, dx: float, dy: float, value: str = "z") -> DataFrame:
    """(grid_id, row, col, rise): the steepest slope up to a neighbour, in rise over run; NULL without one."""
    diagonal = (dx * dx + dy * dy) ** 0.5
    runs = {k: dx if not dr else dy if not dc else diagonal for k, (dr, dc) in NEIGHBOURS.items()}
    around = with_neighbours(cells, value)
    return around.select("grid_id", "row", "col", F.greatest(*[(F.col(f"{value}_{k}") - F.col(value)) / run for k, run in runs.items()]).alias("rise"))
