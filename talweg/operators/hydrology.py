"""Depression filling, D-infinity flow directions, flow accumulation and dependence on grids of any size.

Directions are built-in expressions on the neighbour columns. Filling and accumulation are fixpoints: each tile of
a grid settles on its own in one task, given what lies around it, and only the tiles' border cells travel between
rounds. A round works on the tiles whose surroundings changed, and the last round's tables are in the shared folder,
so the number of rounds is that of tiles that a flow path crosses, not of cells. Cells are packed into one row a tile
once, so a round moves and sorts rows of tiles and borders.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators import tiles as T
from talweg.operators.stencil import NEIGHBOURS, with_neighbours
from talweg.session import cut, stored

STEP = 1e-6  # how much a filled cell lies over its outlet
TILE = 512
QUARTER = math.pi / 4
# Fixed values. Facets: cardinal neighbour, diagonal neighbour, quarter turns of the cardinal, sign of the turn to the diagonal.
FACETS = [("E", "NE", 0, 1), ("N", "NE", 1, -1), ("N", "NW", 1, 1), ("W", "NW", 2, -1), ("W", "SW", 2, 1), ("S", "SW", 3, -1), ("S", "SE", 3, 1), ("E", "SE", 4, -1)]
STEPS = list(NEIGHBOURS.values())


# --- depression filling ----------------------------------------------------------------------------------------


def settle(z: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The least f with ``f = max(z, least neighbour + STEP)``, given f where ``fixed`` is finite; infinite if unreached.

    ``z`` is NaN for nodata. Cells leave a heap lowest first, so what reaches a cell first gives its level.
    """
    wide = z.shape[1] + 2
    given = np.isfinite(fixed)
    framed = np.pad(~np.isnan(z) & ~given, 1)
    level = np.pad(np.where(given, fixed, np.inf), 1).ravel()
    # of the given cells only those beside an open one pass anything on
    beside = np.zeros_like(framed)
    for dr, dc in STEPS:
        beside |= np.roll(framed, (dr, dc), (0, 1))
    starts = np.flatnonzero(beside.ravel() & np.pad(given, 1).ravel())
    heap = list(zip(level[starts].tolist(), starts.tolist(), strict=True))
    heapq.heapify(heap)
    is_open, heights, reached = bytearray(framed.astype(np.uint8).tobytes()), np.pad(z, 1).ravel().tolist(), level.tolist()
    steps = [dr * wide + dc for dr, dc in STEPS]
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        f, at = pop(heap)
        f += STEP
        for step in steps:
            to = at + step
            if is_open[to]:
                is_open[to] = 0
                g = heights[to]
                if g < f:
                    g = f
                reached[to] = g
                push(heap, (g, to))
    return np.array(reached).reshape(-1, wide)[1:-1, 1:-1]


KEY = ["grid_id", "tile_row", "tile_col"]


def _sent(borders: DataFrame, size: int) -> DataFrame:
    """Border cells (grid_id, row, col, ...) with the key of each neighbouring tile that touches them."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS])
    touched = borders.withColumn("step", F.explode(steps))
    to_row, to_col = ((F.col(a) + F.col(f"step.{b}")) / size for a, b in (("row", "dr"), ("col", "dc")))
    reached = touched.withColumns({"to_row": F.floor(to_row).cast("int"), "to_col": F.floor(to_col).cast("int")})
    own = (F.col("to_row") == F.floor(F.col("row") / size)) & (F.col("to_col") == F.floor(F.col("col") / size))
    return reached.filter(~own).drop("step").distinct().withColumnsRenamed({"to_row": "tile_row", "to_col": "tile_col"})


def _listed(borders: DataFrame, value: str) -> DataFrame:
    """``borders`` with a tile's key as one row a tile: what_row, what_col and what, arrays."""
    listed = borders.groupBy(*KEY).agg(F.collect_list(F.struct("row", "col", value)).alias("what"))
    return listed.select(*KEY, *[F.col(f"what.{c}").alias(n) for c, n in (("row", "what_row"), ("col", "what_col"), (value, "what"))])


def _with(tiles: DataFrame, borders: DataFrame, value: str) -> DataFrame:
    return tiles.join(_listed(borders, value), KEY, "left")


def _what(tile: dict) -> tuple[np.ndarray, ...]:
    """What is listed for a tile: rows, columns and values."""
    if not tile["what"].is_valid:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(tile[n].values.to_numpy(zero_copy_only=False) for n in ("what_row", "what_col", "what"))


def _dealt(tiles: DataFrame) -> DataFrame:
    """``tiles`` stored in enough files for all tasks."""
    return stored(tiles.repartition(4 * tiles.sparkSession.sparkContext.defaultParallelism, *KEY))


def _rows(tile: dict, **columns: np.ndarray) -> pa.RecordBatch:
    """A batch of grid_id and ``columns``."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.repeat(tile["grid_id"], n), *[pa.array(c) for c in columns.values()]], ["grid_id", *columns])


def fill_depressions(cells: DataFrame, size: int = TILE, max_rounds: int = 10_000) -> DataFrame:
    """(grid_id, row, col, z, filled): every cell raised until water runs off the grid's edge.

    Edge cells keep their height; nodata is no outlet; a region that the edge does not reach keeps its raw heights.
    """
    packed = _dealt(T.whole(cells.filter("grid_id IS NOT NULL"), ["grid_id"], ["z"], size))
    extent = cells.groupBy("grid_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    tiles = packed.join(extent, "grid_id")

    def settle_tile(tile: dict, final: bool) -> pa.RecordBatch:
        row, col = T.places([tile["at"].as_py()])
        heights = T.numbers([tile["z"].as_py()])
        top, left = row.min() - 1, col.min() - 1
        shape = (row.max() - top + 2, col.max() - left + 2)
        z, fixed = np.full(shape, np.nan), np.full(shape, np.nan)
        r, c = row - top, col - left
        z[r, c] = heights
        edge = (row == 0) | (col == 0) | (row == tile["last_row"].as_py()) | (col == tile["last_col"].as_py())
        seeds = edge & np.isfinite(heights)
        fixed[r[seeds], c[seeds]] = heights[seeds]
        at_row, at_col, levels = _what(tile)
        near = (at_row >= top) & (at_row < top + shape[0]) & (at_col >= left) & (at_col < left + shape[1])
        fixed[at_row[near] - top, at_col[near] - left] = levels[near]
        level = settle(z, fixed)[r, c]
        if final:
            raw = np.isnan(heights)
            return _rows(tile, row=row, col=col, z=np.ma.array(heights, mask=raw), filled=np.ma.array(np.where(np.isfinite(level), level, heights), mask=raw))
        sent = np.isfinite(level) & ((row % size == 0) | (col % size == 0) | (row % size == size - 1) | (col % size == size - 1))
        return _rows(tile, row=row[sent], col=col[sent], level=level[sent])

    kind = cells.schema["grid_id"].dataType.simpleString()
    halo = cells.select("grid_id", "row", "col", F.lit(0.0).alias("level"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col")).limit(0)
    work = tiles
    known = None
    for _ in range(max_rounds):
        found = cut(T.each(_with(work, halo, "level"), lambda t: settle_tile(t, False), f"grid_id {kind}, row int, col int, level double"))
        merged = found if known is None else known.unionByName(found).groupBy("grid_id", "row", "col").agg(F.min("level").alias("level"))
        changed = found if known is None else found.join(known.withColumnRenamed("level", "before"), ["grid_id", "row", "col"], "left").filter("before IS NULL OR level < before").drop("before")
        known = cut(merged)
        woken = cut(_sent(changed, size).select(*KEY).distinct())
        if woken.isEmpty():
            break
        halo = _sent(known, size).join(woken, KEY, "left_semi")
        work = tiles.join(woken, KEY, "left_semi")
    else:
        raise RuntimeError(f"filling did not settle in {max_rounds} rounds")
    return T.each(_with(tiles, _sent(known, size), "level"), lambda t: settle_tile(t, True), f"grid_id {kind}, row int, col int, z double, filled double")


# --- directions ------------------------------------------------------------------------------------------------


def flow_direction(cells: DataFrame, dx: float, dy: float, value: str = "filled") -> DataFrame:
    """``cells`` with angle (radians from east, counter-clockwise; NULL where nothing falls) and slope (NULL on nodata).

    Of eight triangular facets the steepest wins, the first of equal ones; outside the grid the edge's height counts.
    """
    around = with_neighbours(cells, value, replicate=True)
    e0 = F.col(value)
    facets = []
    for cardinal, diagonal, turns, sign in FACETS:
        d1, d2 = (dx, dy) if cardinal in "EW" else (dy, dx)
        e1, e2 = F.col(f"{value}_{cardinal}"), F.col(f"{value}_{diagonal}")
        s1, s2 = (e0 - e1) / d1, (e1 - e2) / d2
        r, limit = F.atan2(s2, s1), math.atan2(d2, d1)
        slope = F.when(r < 0, s1).when(r > limit, (e0 - e2) / math.hypot(d1, d2)).otherwise(F.hypot(s1, s2))
        turned = F.when(r < 0, F.lit(0.0)).when(r > limit, F.lit(limit)).otherwise(r)
        facets.append(F.struct(slope.alias("s"), turned.alias("r"), F.lit(turns).alias("t"), F.lit(sign).alias("g")))
    faced = around.select(*cells.columns, F.array(*facets).alias("facets"))
    steepest = F.array_max(F.transform("facets", lambda f: f.s))
    at = F.array_position(F.transform("facets", lambda f: f.s), F.col("best")).cast("int")
    chosen = faced.withColumn("best", steepest).withColumn("facet", F.when(F.col("best") > 0, F.get("facets", at - 1)))
    angle = F.pmod(F.col("facet.g") * F.col("facet.r") + F.col("facet.t") * (math.pi / 2), F.lit(2 * math.pi))
    slope = F.when(e0.isNotNull(), F.greatest(F.coalesce(F.col("best"), F.lit(0.0)), F.lit(0.0)))
    return chosen.select(*cells.columns, angle.alias("angle"), slope.alias("slope"))


def flow_edges(directed: DataFrame, value: str = "filled") -> DataFrame:
    """(grid_id, row, col, to_row, to_col, share, down): where each cell's flow goes, inside the grid.

    The angle is split between the two neighbours on either side of it, in quarter turns.
    """
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS])
    part = F.col("angle") / QUARTER
    k = F.pmod(F.floor(part).cast("int"), F.lit(8))
    share = part - F.floor(part)
    two = F.array(F.struct(k.alias("k"), (1 - share).alias("share")), F.struct(F.pmod(k + 1, F.lit(8)).alias("k"), share.alias("share")))
    out = directed.filter("angle IS NOT NULL").select("grid_id", "row", "col", F.col(value).alias("from_z"), F.explode(two).alias("e")).filter("e.share > 0")
    step = F.element_at(steps, F.col("e.k") + 1)
    aimed = out.select("grid_id", "row", "col", "from_z", (F.col("row") + step.dr).alias("to_row"), (F.col("col") + step.dc).alias("to_col"), F.col("e.share").alias("share"))
    target = directed.filter(F.col(value).isNotNull()).select("grid_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col(value).alias("to_z"))
    met = aimed.join(target, ["grid_id", "to_row", "to_col"])
    return met.select("grid_id", "row", "col", "to_row", "to_col", "share", (F.col("to_z") < F.col("from_z")).alias("down"))


# --- accumulation ----------------------------------------------------------------------------------------------


def _carried(n: int, source: np.ndarray, target: np.ndarray, share: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``p = start + sum of share * p`` over edges of a graph without cycles, level by level."""
    p, waiting = start.copy(), np.bincount(target, minlength=n)
    order = np.argsort(source, kind="stable")
    source, target, share = source[order], target[order], share[order]
    first = np.searchsorted(source, np.arange(n + 1))
    ready = np.flatnonzero(waiting == 0)
    while len(ready):
        counts = first[ready + 1] - first[ready]
        edges = np.repeat(first[ready] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        np.add.at(p, target[edges], share[edges] * p[source[edges]])
        hit, times = np.unique(target[edges], return_counts=True)
        waiting[hit] -= times
        ready = hit[waiting[hit] == 0]
    return p


def _flows(row: np.ndarray, col: np.ndarray, z: np.ndarray, angle: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """``flow_edges`` of a tile's ``own`` cells: number of source and target, share and down."""
    top, left = row.min() - 1, col.min() - 1
    number = np.full((row.max() - top + 2, col.max() - left + 2), -1)
    number[row - top, col - left] = np.arange(len(row))
    flows = np.flatnonzero(own & np.isfinite(angle))
    part = angle[flows] / QUARTER
    down = np.floor(part).astype(int)
    part = part - down
    source, target, share = [], [], []
    for turn, portion in ((0, 1 - part), (1, part)):
        step = np.array(STEPS)[(down + turn) % 8]
        to = number[row[flows] - top + step[:, 0], col[flows] - left + step[:, 1]]
        some = (to >= 0) & (portion > 0)
        source.append(flows[some])
        target.append(to[some])
        share.append(portion[some])
    source, target, share = (np.concatenate(x) for x in (source, target, share))
    return source, target, share, z[target] < z[source]


def accumulate(directed: DataFrame, value: str = "filled", size: int = TILE, max_rounds: int = 10_000) -> DataFrame:
    """(grid_id, row, col, cells): how many cells' flow passes each cell, itself included; NULL on nodata.

    Flow first goes down the edges that fall, to a fixpoint. What an edge that does not fall carries (the split in
    quarter turns can point up where cells are not square) is added at its end and goes no further.
    """
    known_cells = directed.filter(F.col(value).isNotNull() & F.col("grid_id").isNotNull()).select("grid_id", "row", "col", F.col(value).alias("z"), "angle")
    tiles = _dealt(T.whole(known_cells, ["grid_id"], ["z", "angle"], size, 1))

    def summed(row: np.ndarray, col: np.ndarray, at: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, ...]:
        hit, slot = np.unique(at, return_inverse=True)
        return row[hit], col[hit], np.bincount(slot, weights=flow, minlength=len(hit)).astype(float)

    def carry(tile: dict, last: bool) -> pa.RecordBatch | None:
        row, col = T.places([tile["at"].as_py()])
        z, angle = (T.numbers([tile[n].as_py()]) for n in ("z", "angle"))
        own = (row // size == tile["tile_row"].as_py()) & (col // size == tile["tile_col"].as_py())
        if not own.any():
            return None  # only what is around it
        source, target, share, down = _flows(row, col, z, angle, own)
        start = own.astype(float)
        at_row, at_col, flow = _what(tile)
        if len(flow):
            top, left = row.min(), col.min()
            number = np.full((row.max() - top + 1, col.max() - left + 1), -1)
            number[row - top, col - left] = np.arange(len(row))
            np.add.at(start, number[at_row - top, at_col - left], flow)
        inside = down & own[target]
        p = _carried(len(row), source[inside], target[inside], share[inside], start)
        if not last:
            over = down & ~own[target]
            to_row, to_col, flow = summed(row, col, target[over], share[over] * p[source[over]])
            return _rows(tile, row=to_row, col=to_col, flow=flow, from_row=np.full(len(flow), tile["tile_row"].as_py(), np.int32), from_col=np.full(len(flow), tile["tile_col"].as_py(), np.int32))
        up = ~down
        to_row, to_col, more = summed(row, col, target[up], share[up] * p[source[up]])
        here = np.flatnonzero(own)
        columns = [pa.array([tile[k].as_py()], t) for k, t in (("grid_id", tile["grid_id"].type), ("tile_row", pa.int32()), ("tile_col", pa.int32()))]
        columns += [pa.array([row[here].tobytes() + col[here].tobytes()], pa.binary()), pa.array([p[here].tobytes()], pa.binary())]
        ups = pa.StructArray.from_arrays([pa.array(to_row), pa.array(to_col), pa.array(more)], ["row", "col", "more"])
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(ups)], pa.int32()), ups))
        return pa.RecordBatch.from_arrays(columns, [*KEY, "at", "p", "ups"])

    kind = directed.schema["grid_id"].dataType.simpleString()
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    at = {"tile_row": tile("row"), "tile_col": tile("col")}
    inflow = known_cells.select("grid_id", "row", "col", F.lit(0.0).alias("flow")).limit(0).withColumns(at)
    work, near, known = tiles, inflow, None
    sent = f"grid_id {kind}, row int, col int, flow double, from_row int, from_col int"
    for _ in range(max_rounds):
        found = T.each(_with(work, near, "flow"), lambda t: carry(t, False), sent)
        if known is not None:
            again = woken.withColumnsRenamed({"tile_row": "from_row", "tile_col": "from_col"})
            found = known.join(again, ["grid_id", "from_row", "from_col"], "left_anti").select(*known.columns).unionByName(found)
        known = cut(found)
        arrived = cut(known.groupBy("grid_id", "row", "col").agg(F.sum("flow").alias("flow")).withColumns(at))
        before = inflow.select("grid_id", "row", "col", F.col("flow").alias("before"))
        moved = F.abs(F.col("flow") - F.coalesce("before", F.lit(0.0))) > 1e-12 * F.col("flow")
        woken = cut(arrived.join(before, ["grid_id", "row", "col"], "left").filter(moved).select(*KEY).distinct())
        inflow = arrived
        if woken.isEmpty():
            break
        work, near = tiles.join(woken, KEY, "left_semi"), inflow.join(woken, KEY, "left_semi")
    else:
        raise RuntimeError(f"accumulation did not settle in {max_rounds} rounds")
    passed = stored(T.each(_with(tiles, inflow, "flow"), lambda t: carry(t, True), f"grid_id {kind}, tile_row int, tile_col int, at binary, p binary, ups array<struct<row: int, col: int, more: double>>"))
    ups = passed.select("grid_id", F.explode("ups").alias("u")).select("grid_id", "u.*").withColumns(at)

    def added(tile: dict) -> pa.RecordBatch:
        row, col = T.places([tile["at"].as_py()])
        p, top, left = T.numbers([tile["p"].as_py()]), row.min(), col.min()
        more = np.zeros((row.max() - top + 1, col.max() - left + 1))
        at_row, at_col, flow = _what(tile)
        np.add.at(more, (at_row - top, at_col - left), flow)
        return _rows(tile, row=row, col=col, cells=p + more[row - top, col - left])

    return T.each(_with(passed.drop("ups"), ups, "more"), added, f"grid_id {kind}, row int, col int, cells double")


def specific_catchment_area(cells: DataFrame, dx: float, dy: float, size: int = TILE) -> DataFrame:
    """(grid_id, row, col, z, filled, angle, slope, sca): the whole chain; sca is area per width of contour, in metres."""
    directed = stored(flow_direction(fill_depressions(cells, size), dx, dy))
    passed = accumulate(directed, size=size)
    per_width: Column = F.col("cells") * (dx * dy) / (0.5 * (dx + dy))
    return directed.join(passed, ["grid_id", "row", "col"], "left").withColumn("sca", per_width).drop("cells")


# --- dependence ------------------------------------------------------------------------------------------------


def dependence(directed: DataFrame, targets: DataFrame, radius: int, halo: int = 1, value: str = "filled") -> DataFrame:
    """(target_id, row, col, dependence): the share of each cell's flow that reaches a target, in a window around it.

    ``targets`` (target_id, grid_id, row, col). The target and the cells up to ``halo`` around it have 1, the others
    the shares of their receivers', as far as these come before them in the order of height, row and column. One task
    holds one window at a time, and shares are carried up level by level.
    """
    window = F.explode(F.expr(f"flatten(transform(sequence(-{radius}, {radius}), r -> transform(sequence(-{radius}, {radius}), c -> struct(r AS dr, c AS dc))))"))
    around = targets.select("target_id", "grid_id", F.col("row").alias("t_row"), F.col("col").alias("t_col"), window.alias("o"))
    keyed = around.select("target_id", "grid_id", "t_row", "t_col", (F.col("t_row") + F.col("o.dr")).alias("row"), (F.col("t_col") + F.col("o.dc")).alias("col"))
    seen = keyed.join(directed.select("grid_id", "row", "col", F.col(value).alias("z"), "angle").filter("z IS NOT NULL"), ["grid_id", "row", "col"])
    kind = targets.schema["target_id"].dataType.simpleString()

    wide = 2 * radius + 1

    def climb(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["z", "row", "col"])
        n = len(own)
        r, c = (own[a].to_numpy(int) - own[b].to_numpy(int) for a, b in (("row", "t_row"), ("col", "t_col")))
        angle = own["angle"].to_numpy(float) / QUARTER
        start = (np.maximum(np.abs(r), np.abs(c)) <= halo).astype(float)
        flows = np.flatnonzero(np.isfinite(angle) & (start == 0))
        number = np.full((wide + 2, wide + 2), -1)
        number[r + radius + 1, c + radius + 1] = np.arange(n)
        down = np.floor(angle[flows]).astype(int)
        share = angle[flows] - down
        source, target, parts = [], [], []
        for turn, part in ((0, 1 - share), (1, share)):
            step = np.array(STEPS)[(down + turn) % 8]
            receiver = number[r[flows] + radius + 1 + step[:, 0], c[flows] + radius + 1 + step[:, 1]]
            known = (receiver >= 0) & (receiver < flows)
            source.append(receiver[known])
            target.append(flows[known])
            parts.append(part[known])
        p = _carried(n, *(np.concatenate(x) for x in (source, target, parts)), start)
        return pd.DataFrame({"target_id": own["target_id"].iloc[0], "row": own["row"], "col": own["col"], "dependence": p})

    return seen.groupBy("target_id").applyInPandas(climb, f"target_id {kind}, row int, col int, dependence double")
