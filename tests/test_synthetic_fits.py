import numpy as np
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid
from talweg.operators import fits, synthetic
from talweg.operators.stability import Soil


def terrain(spark, height=40, width=50):
    r, c = np.mgrid[:height, :width]
    z = 500 + 20.0 * r + 100 * np.sin(c / 5) + 3.0 * ((r * 7 + c * 3) % 11)
    return z, spark.createDataFrame([(0, int(a), int(b), float(z[a, b])) for a in range(height) for b in range(width)], "grid_id int, row int, col int, z double").repartition(3)


def test_exposure_lies_on_low_ground(spark):
    grid = Grid(84.0, 27.0, 84.5, 27.4, 0.01)
    z, cells = terrain(spark)
    settlements, roads = (df.collect() for df in synthetic.exposure(cells, grid))
    assert len(settlements) == 60 and {r.place for r in settlements} == {"hamlet", "village", "town", "city"}
    at = lambda lon, lat: (round((27.4 - lat) / 0.01 - 0.5), round((lon - 84.0) / 0.01 - 0.5))
    cut = np.percentile(z, 25)
    assert all(z[at(r.lon, r.lat)] <= cut for r in settlements)
    assert all(75 <= r.population <= 90_000 for r in settlements)
    assert len(roads) <= 4
    for r in roads:
        path = [z[at(p.lon, p.lat)] for p in r.coords]
        assert len(path) > 1 and all(a > b for a, b in zip(path, path[1:], strict=False))
    assert settlements == synthetic.exposure(cells.repartition(7), grid)[0].collect()


def test_inventory_follows_the_factors(spark):
    grid = Grid(84.0, 27.0, 84.5, 27.4, 0.01)
    _, cells = terrain(spark)
    layers = cells.withColumn("steep", (F.col("col") / 5).cast("double")).withColumn("cover", F.when(F.col("row") < 5, 0.0).otherwise(1.0)).withColumn("steep", F.when(F.col("row") != 39, F.col("steep")))
    found = synthetic.inventory(layers, grid, ["steep", "cover"], [3.0, 1.0], 200, zero=("cover",)).collect()
    assert len(found) == 200
    rows = [round((27.4 - r.lat) / 0.01 - 0.5) for r in found]
    assert min(rows) >= 5 and max(rows) < 39
    assert np.mean([r.lon for r in found]) > 84.3


def test_fits_are_stored_and_stand_in(spark, tmp_path):
    path = f"file://{tmp_path}/fit"
    assert fits.load_fit(spark, path, 7.0) == (Soil(), {}, 7.0)
    assert fits.load_fit(spark, None) == (Soil(), {}, None)
    soil, own = Soil((0.1, 0.2), (28.0, 40.0), (0.001, 0.003), 1.5), {4: Soil((0.0, 0.1))}
    fits.store_fit(spark, path, soil, own, 140.5)
    assert fits.load_fit(spark, path) == (soil, own, 140.5)
    fits.store_fit(spark, path, soil)
    assert fits.load_fit(spark, path, 9.0) == (soil, {}, 9.0)


def test_stages_are_made_again_when_a_cell_changes(spark, tmp_path):
    _, cells = terrain(spark)
    made = []

    def make(df):
        made.append(1)
        return df.select("row", "col", (F.col("z") * 2).alias("twice"))

    folder = f"file://{tmp_path}/stages"
    first = fits.staged(cells, ["z"], folder, "twice", {"a": 1}, make)
    assert first.count() == 2000 and fits.staged(cells.repartition(5), ["z"], folder, "twice", {"a": 1}, make).count() == 2000
    assert len(made) == 1
    moved = cells.withColumn("z", F.when((F.col("row") == 3) & (F.col("col") == 45), F.col("z") + 1e-9).otherwise(F.col("z")))
    fits.staged(moved, ["z"], folder, "twice", {"a": 1}, make)
    fits.staged(cells, ["z"], folder, "twice", {"a": 2}, make)
    assert len(made) == 3
    a, b = (fits.fingerprints(df, ["z"], 16) for df in (cells, moved))
    assert [tuple(r) for r in fits.changed_tiles(a, b).collect()] == [(0, 0, 2)]
    assert fits.changed_tiles(a, fits.fingerprints(cells.filter("row < 32"), ["z"], 16)).count() == 4
