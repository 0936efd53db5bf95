"""Polylines: lengths, cutting into pieces, cells along them, simplification and hulls."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid, asset_cell
from talweg.functions.scores import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, haversine_m

COORDS = "array<struct<lon:double,lat:double>>"
PIECE_M, TOLERANCE_M = 500.0, 15.0
PARTS = 64


def steps(coords: Column) -> Column:
    """The lengths in metres between neighbouring vertices."""
    later = F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0)))
    return F.transform(later, lambda b, i: haversine_m(F.get(coords, i)["lon"], F.get(coords, i)["lat"], b["lon"], b["lat"]))


def length_m(coords: Column) -> Column:
    return F.aggregate(steps(coords), F.lit(0.0), lambda s, d: s + d)


def pieces(lines: DataFrame, keep: list[str], limit_m: float = PIECE_M) -> DataFrame:
    """(keep, piece, coords): lines cut at the first vertex where a piece is ``limit_m`` long or longer.

    The vertex of a cut ends one piece and begins the next; what a cut at the last vertex would leave is no piece.
    A fold along each line's own array: nothing is exploded or shuffled.
    """
    start = F.struct(F.lit(0.0).alias("run"), F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("at"))

    def step(acc: Column, d: Column) -> Column:
        run, at = acc["run"] + d, acc["at"] + 1
        cut = run >= limit_m
        return F.struct(F.when(cut, F.lit(0.0)).otherwise(run).alias("run"), F.when(cut, F.array_append(acc["cuts"], at)).otherwise(acc["cuts"]).alias("cuts"), at.alias("at"))

    folded = lines.withColumn("f", F.aggregate(steps(F.col("coords")), start, step)).filter(F.size("coords") >= 2)
    last = F.size("coords") - 1
    bounds = F.when(F.element_at("f.cuts", -1) == last, F.col("f.cuts")).otherwise(F.array_append(F.col("f.cuts"), last))
    cut = folded.withColumn("bounds", bounds)
    parts = F.transform(F.slice("bounds", 2, F.size("bounds") - 1), lambda b, i: F.slice("coords", F.get("bounds", i) + 1, b - F.get("bounds", i) + 1))
    return cut.select(*keep, F.posexplode(parts).alias("piece", "coords"))


def line_cells(lines: DataFrame, grid: Grid, key: str = "asset_id") -> DataFrame:
    """(key, vertex, row, col): the cells of a line's vertices, each once, at its first vertex."""
    spread = lines.select(key, F.posexplode("coords").alias("vertex", "p"))
    row, col = asset_cell(F.col("p.lon"), F.col("p.lat"), grid)
    placed = spread.select(key, "vertex", row.alias("row"), col.alias("col")).filter("row IS NOT NULL AND col IS NOT NULL")
    return placed.groupBy(key, "row", "col").agg(F.min("vertex").alias("vertex")).select(key, "vertex", "row", "col")


def middle_vertex(coords: Column) -> Column:
    return F.get(coords, (F.size(coords) / 2).cast("int"))


def _simplified(lon: np.ndarray, lat: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether each vertex stays. All stretches between vertices that stay are split at once, round by round.

    A stretch is split at its farthest vertex from the chord, if that is farther than ``tolerance``.
    """
    n = len(lon)
    x = lon * (METRES_PER_DEGREE_LON * math.cos(math.radians(float(lat.mean()))) if n else 0.0)
    y = lat * METRES_PER_DEGREE_LAT
    stays = np.zeros(n, bool)
    stays[[0, -1] if n else []] = True
    while n > 2:
        ends = np.flatnonzero(stays)
        stretch = np.searchsorted(ends, np.arange(n), "right") - 1
        a, b = ends[stretch], ends[np.minimum(stretch + 1, len(ends) - 1)]
        across, up = x[b] - x[a], y[b] - y[a]
        chord = np.hypot(across, up)
        aside = np.abs(across * (y - y[a]) - up * (x - x[a]))
        away = np.where(chord > 0, aside / np.where(chord > 0, chord, 1.0), np.hypot(x - x[a], y - y[a]))
        away[stays] = 0.0
        order = np.lexsort((-np.arange(n), away, stretch))  # the farthest of each stretch comes last, the first of equal ones
        last = order[np.searchsorted(stretch[order], np.arange(len(ends)), "right") - 1]
        split = last[away[last] > tolerance]
        if not len(split):
            break
        stays[split] = True
    return stays


def simplify(lines: DataFrame, keep: list[str], tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """``keep`` and coords, thinned so that no dropped vertex lies farther than the tolerance from the line."""
    given = lines.select(*keep, F.col("coords").cast(COORDS).alias("coords"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("coords")
            out = []
            for coords in batch.column(at).to_pylist():
                lon, lat = (np.array([c[k] for c in coords or ()], float) for k in ("lon", "lat"))
                out.append(None if coords is None else [c for c, stays in zip(coords, _simplified(lon, lat, tolerance_m), strict=True) if stays])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return given.mapInArrow(run, given.schema)


def _hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of (n, 2) points, counter-clockwise from the leftmost one.

    An edge with points on its outer side gives way to two edges over the outermost of them, until none has any.
    """
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    left, right = points[0], points[-1]
    edges, ring = [(right, left, points), (left, right, points)], []
    while edges:
        a, b, near = edges.pop()
        outside = (b[1] - a[1]) * (near[:, 0] - a[0]) - (b[0] - a[0]) * (near[:, 1] - a[1])
        near, outside = near[outside > 0], outside[outside > 0]
        if len(near):
            top = near[outside.argmax()]
            edges += [(top, b, near), (a, top, near)]
        else:
            ring.append(a)
    return np.array(ring)


def hulls(points: DataFrame, key: str, padding_m: float = 250.0) -> DataFrame:
    """(key, hull): the convex hull of squares around a group's points.

    Hulls of parts have the whole's hull among their points, so each of a group's ``PARTS`` parts is reduced to its
    own hull first and no task holds a whole group.
    """
    kind = points.schema[key].dataType.simpleString()
    pad_lat = padding_m / METRES_PER_DEGREE_LAT
    pad_lon = F.lit(padding_m) / (METRES_PER_DEGREE_LON * F.cos(F.radians("lat")))
    corners = F.array(*[F.struct((F.col("lon") + x * pad_lon).alias("lon"), (F.col("lat") + y * pad_lat).alias("lat")) for x in (-1, 1) for y in (-1, 1)])
    spread = points.select(key, F.explode(corners).alias("p")).select(key, "p.lon", "p.lat")
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("lon", "lat"), F.lit(PARTS)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        ring = _hull(own[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame({key: [own[key].iloc[0]], "hull": [[{"lon": x, "lat": y} for x, y in ring.tolist()]]})

    schema = f"{key} {kind}, hull {COORDS}"
    parts = dealt.groupBy(key, "part").applyInPandas(run, schema)
    return parts.select(key, F.explode("hull").alias("p")).select(key, "p.lon", "p.lat").groupBy(key).applyInPandas(run, schema)
