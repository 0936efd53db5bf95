"""Made-up inputs over synthetic terrain, for demonstrations: layers, exposure and an inventory with a planted signal.

Draws are hashes of cells, so they depend on the seed alone and are made where the cells are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid, cell_centre
from talweg.functions.triggers import PERIODS
from talweg.operators import walks
from talweg.operators.quantiles import quantiles

# Land-cover codes by height, rock codes, shares of the year's rain by month, and how much wetter each
# pathway is by the last period.
GRASS, CROPS, TREES, SHRUBS, BARE, SNOW, WATER = 30, 40, 10, 20, 60, 70, 80
METAMORPHIC, SEDIMENT, PLUTONIC, WATER_BODY = 9, 2, 11, 15
MONTH_SHARES = [0.3, 0.35, 0.5, 0.8, 1.4, 2.6, 3.2, 3.0, 1.8, 0.9, 0.4, 0.3]
WETTING = {"ssp126": 1.04, "ssp245": 1.09, "ssp370": 1.14, "ssp585": 1.20}
OTHER_WETTING = 1.10
SETTLEMENTS = [("hamlet", 40, 150), ("village", 14, 1200), ("town", 5, 8000), ("city", 1, 60000)]
ROADS = 4


def landcover(z: Column, relief: Column) -> Column:
    """Codes by height; the lowest ground of ``relief`` (0 to 1) is water."""
    by_height = F.when(z >= 4800, SNOW).when(z >= 4000, BARE).when(z >= 2500, SHRUBS).when(z >= 800, TREES).when(z < 800, CROPS).otherwise(GRASS)
    return F.when(relief < 0.05, WATER).otherwise(by_height)


def lithology(noise: Column, cover: Column) -> Column:
    return F.when(cover == WATER, WATER_BODY).when(noise < 0.3, PLUTONIC).when(noise > 0.6, SEDIMENT).otherwise(METAMORPHIC)


def wetting(pathway: Column, period: Column) -> Column:
    """The factor of a future's rain: a pathway's full factor in the last period, less before; 1 for the present."""
    full = F.coalesce(F.create_map(*[F.lit(x) for pair in WETTING.items() for x in pair])[pathway], F.lit(OTHER_WETTING))
    place = F.array_position(F.array(*map(F.lit, PERIODS)), period)
    step = F.when(place > 0, place).otherwise(len(PERIODS))
    return F.when(pathway.isNull(), 1.0).otherwise(1 + (full - 1) * step / len(PERIODS))


def monthly_rain(cells: DataFrame, relief: str, factor: Column | float = 1.0) -> DataFrame:
    """``cells`` twelve times, with band (1 to 12) and mm."""
    shares = F.array(*[F.struct(F.lit(k + 1).alias("band"), F.lit(s).alias("share")) for k, s in enumerate(MONTH_SHARES)])
    base = (40 + 260 * F.col(relief)) * (factor if isinstance(factor, Column) else F.lit(factor))
    return cells.withColumn("m", F.explode(shares)).select(*cells.columns, F.col("m.band").alias("band"), (base * F.col("m.share")).alias("mm"))


def acceleration(col: Column, width: int, relief: Column) -> Column:
    """Ground acceleration that grows to the east and with the terrain."""
    return 0.05 + 0.5 * (col / max(width - 1, 1)) * (0.5 + 0.5 * relief)


def inputs(cells: DataFrame, width: int, relief: str = "relief", noise: str = "noise") -> DataFrame:
    """``cells`` (row, col, z, relief and noise from 0 to 1) with landcover, lithology and pga."""
    covered = cells.withColumn("landcover", landcover(F.col("z"), F.col(relief)))
    return covered.withColumn("lithology", lithology(F.col(noise), F.col("landcover"))).withColumn("pga", acceleration(F.col("col"), width, F.col(relief)))


def _chance(seed: int, salt: str) -> Column:
    """0 up to 1, by cell."""
    return F.pmod(F.xxhash64("row", "col", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _first(cells: DataFrame, n: int, seed: int, salt: str) -> DataFrame:
    return cells.orderBy(F.xxhash64("row", "col", F.lit(seed), F.lit(salt)), "row", "col").limit(n)


def exposure(cells: DataFrame, grid: Grid, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Settlements (name, lon, lat, place, population) in the lowest quarter of ``cells``, and roads (name, highway,
    coords) that follow the lowest neighbour down from four places there; walks are found by pointer doubling."""
    cut = quantiles(cells, [], "z", [0.25]).select(F.get("quantiles", F.lit(0)).alias("cutoff"))
    low = cells.crossJoin(F.broadcast(cut)).filter("z <= cutoff").select("row", "col")  # one row
    kinds = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(n).alias("people")) for p, count, n in SETTLEMENTS for _ in range(count)])
    total = sum(count for _, count, _ in SETTLEMENTS)
    picked = _first(low, total, seed, "settlement").withColumn("chance", _chance(seed, "people"))
    listed = picked.agg(F.sort_array(F.collect_list(F.struct("row", "col", "chance"))).alias("p")).select(F.posexplode("p").alias("k", "p"))  # 60 rows at most
    kind = F.get(kinds, F.col("k"))
    lon, lat = cell_centre(F.col("p.row"), F.col("p.col"), grid)
    name = F.format_string("Demo %s %02d", kind["place"], F.col("k") + 1)
    settlements = listed.select(name.alias("name"), lon.alias("lon"), lat.alias("lat"), kind["place"].alias("place"), F.floor(kind["people"] * (0.5 + F.col("p.chance"))).cast("long").alias("population"))
    starts = _first(low, ROADS, seed, "road").select(F.xxhash64("row", "col").alias("walk"), F.lit(0).alias("grid_id"), "row", "col")
    pointers = walks.receivers(cells.select(F.lit(0).alias("grid_id"), "row", "col", "z"))
    paths = walks.walks(pointers, starts, max(grid.width, grid.height))
    lines = walks.roads(paths, *cell_centre(F.col("row"), F.col("col"), grid))
    numbered = lines.agg(F.sort_array(F.collect_list(F.struct("walk", "coords"))).alias("r")).select(F.posexplode("r").alias("k", "r"))  # four rows at most
    highway = F.when(F.col("k") == 0, "primary").otherwise("secondary")
    return settlements, numbered.select(F.format_string("Demo highway %d", F.col("k") + 1).alias("name"), highway.alias("highway"), F.col("r.coords").alias("coords"))


def inventory(cells: DataFrame, grid: Grid, factors: list[str], weights: list[float], n: int, seed: int = 13, zero: tuple[str, ...] = ()) -> DataFrame:
    """(lon, lat) of at most ``n`` cells, likelier where the ``factors``' weighted logarithms are greater.

    A cell is kept with the logistic of its score over the median score of usable cells; cells without all factors,
    or with 0 in one of ``zero``, are not usable.
    """
    usable = cells
    for c in factors:
        usable = usable.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    for c in zero:
        usable = usable.filter(F.col(c) != 0)
    score = sum((F.lit(w) * F.log(F.col(c) + 1) for c, w in zip(factors, weights, strict=True)), F.lit(0.0))
    scored = usable.select("row", "col", score.alias("score"))
    middle = quantiles(scored, [], "score", [0.5]).select(F.get("quantiles", F.lit(0)).alias("middle"))
    kept = scored.crossJoin(F.broadcast(middle)).filter(_chance(seed, "keep") < 1 / (1 + F.exp(F.col("middle") - F.col("score"))))  # one row
    lon, lat = cell_centre(F.col("row"), F.col("col"), grid)
    return _first(kept.select("row", "col"), n, seed, "order").select(lon.alias("lon"), lat.alias("lat"))
