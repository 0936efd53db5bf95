"""Walks down a grid from cell to lowest neighbour, of any length, by pointer doubling.

Each cell points to the lowest of its eight neighbours if that is lower than itself. Joining the pointers with
themselves doubles how far they reach, so walks of n steps take a logarithmic number of joins, for all starts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.operators.stencil import NEIGHBOURS, with_neighbours
from talweg.session import stored

CELL = ["grid_id", "row", "col"]


def receivers(cells: DataFrame, value: str = "z") -> DataFrame:
    """(grid_id, row, col, to_row, to_col) of the cells that have a lower neighbour: the lowest, the first by row and column of equal ones.

    ``cells`` are all cells of the grids, with NULL or NaN where there is no data.
    """
    around = with_neighbours(cells.select(*CELL, F.when(~F.isnan(value), F.col(value)).alias(value)), value)
    each = [F.struct(F.col(f"{value}_{k}").alias("z"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in NEIGHBOURS.items()]
    lowest = F.array_min(F.filter(F.array(*each), lambda n: n.z.isNotNull()))
    met = around.select(*CELL, F.col(value).alias("own"), lowest.alias("low")).filter("low.z < own")
    return met.select(*CELL, (F.col("row") + F.col("low.dr")).alias("to_row"), (F.col("col") + F.col("low.dc")).alias("to_col"))


def _further(pointers: DataFrame) -> DataFrame:
    """Pointers over twice the steps, of the cells from which there are that many."""
    on = pointers.select("grid_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("then_row"), F.col("to_col").alias("then_col"))
    return pointers.join(on, ["grid_id", "to_row", "to_col"]).select(*CELL, F.col("then_row").alias("to_row"), F.col("then_col").alias("to_col"))


def walks(pointers: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(walk, step, grid_id, row, col): the cells of each walk from ``starts`` (walk, grid_id, row, col), the start as step 0.

    ``pointers`` as ``receivers`` gives them; a walk has at most ``most`` cells. A round doubles the steps known.
    """
    pointers = stored(pointers)
    paths = stored(starts.select("walk", F.lit(0).alias("step"), *CELL))
    span = 1
    while most is None or span < most:
        more = paths.join(pointers, CELL).select("walk", (F.col("step") + span).alias("step"), "grid_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"))
        more = stored(more if most is None else more.filter(F.col("step") < most))
        if more.isEmpty():
            break
        paths = paths.unionByName(more)
        pointers, span = stored(_further(pointers)), 2 * span
    return paths


def ends(pointers: DataFrame) -> DataFrame:
    """(grid_id, row, col, end_row, end_col): where the walk from each cell that has a receiver ends.

    Rounds work on the cells whose end is not known yet, and their number is the logarithm of the longest walk.
    """
    open_ = stored(pointers)
    done = None
    while True:
        on = open_.select("grid_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("then_row"), F.col("to_col").alias("then_col"))
        met = open_.join(on, ["grid_id", "to_row", "to_col"], "left")
        if done is not None:  # ends known by now
            over = done.select("grid_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), "end_row", "end_col")
            met = met.join(over, ["grid_id", "to_row", "to_col"], "left")
        else:
            met = met.withColumns({"end_row": F.lit(None).cast("int"), "end_col": F.lit(None).cast("int")})
        met = stored(met)
        found = met.filter("then_row IS NULL").select(*CELL, F.coalesce("end_row", "to_row").alias("end_row"), F.coalesce("end_col", "to_col").alias("end_col"))
        done = found if done is None else done.unionByName(found)
        open_ = met.filter("then_row IS NOT NULL").select(*CELL, F.col("then_row").alias("to_row"), F.col("then_col").alias("to_col"))
        if open_.isEmpty():
            return done


def roads(paths: DataFrame, lon, lat) -> DataFrame:
    """(walk, coords): walks of two cells or more as lines; ``lon`` and ``lat`` are columns of a cell's centre."""
    points = paths.select("walk", F.struct("step", lon.alias("lon"), lat.alias("lat")).alias("p"))
    listed = points.groupBy("walk").agg(F.sort_array(F.collect_list("p")).alias("p")).filter(F.size("p") > 1)
    return listed.select("walk", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))
