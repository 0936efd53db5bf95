"""Administrative units: selection, relief, work order, stage records and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.gridding import intersects
from talweg.functions.scores import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, is_mountainous, slug
from talweg.operators.quantiles import with_quantiles

LEAST_SPAN_DEG = 0.02
HIGH_M, RUGGED_M = 1000.0, 500.0
MAX_CELLS = 40_000_000


def select_units(units: DataFrame, box: tuple[float, float, float, float], countries: list[str] | None = None, names: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Named units that meet ``box``, clipped to it, ordered by country and name; filters ignore case.

    Units without a country pass the country filter; slivers of under 0.02 degrees are left out.
    """
    lower = lambda xs: [x.lower() for x in xs]
    found = units.filter(F.col("name").isNotNull() & (F.trim("name") != ""))
    if countries:
        found = found.filter(F.col("country").isNull() | F.lower("country").isin(lower(countries)))
    if names:
        found = found.filter(F.lower("name").isin(lower(names)))
    if exclude:
        found = found.filter(~F.lower("name").isin(lower(exclude)))
    found = found.filter(intersects(tuple(F.col(c) for c in ("west", "south", "east", "north")), tuple(F.lit(float(x)) for x in box)))
    clipped = found.withColumns({"west": F.greatest("west", F.lit(box[0])), "south": F.greatest("south", F.lit(box[1])), "east": F.least("east", F.lit(box[2])), "north": F.least("north", F.lit(box[3]))})
    wide = clipped.filter((F.col("east") - F.col("west") >= LEAST_SPAN_DEG) & (F.col("north") - F.col("south") >= LEAST_SPAN_DEG))
    return wide.withColumn("slug", slug(F.col("country"), F.col("name"))).orderBy("country", "name")


def buffered(box: tuple[Column, Column, Column, Column], degrees: float) -> list[Column]:
    return [box[0] - degrees, box[1] - degrees, box[2] + degrees, box[3] + degrees]


def relief_statistics(cells: DataFrame, res: float, keys: list[str] | None = None) -> DataFrame:
    """Per unit the mountain share and area, peak and median relief; ``cells`` (slug, lat, z, relief).

    A cell is mountain if it is high and its 3x3 range rugged; its area shrinks with the latitude.
    """
    keys = keys or ["slug"]
    mountain = (F.col("z") >= HIGH_M) & (F.col("relief") >= RUGGED_M)
    km2 = res * METRES_PER_DEGREE_LON * F.cos(F.radians("lat")) * res * METRES_PER_DEGREE_LAT / 1e6
    known = cells.filter(F.col("z").isNotNull())
    out = known.groupBy(*keys).agg(
        F.avg(F.when(mountain, 1.0).otherwise(0.0)).alias("mountain_fraction"),
        F.sum(F.when(mountain, km2).otherwise(0.0)).alias("mountain_area_km2"),
        F.max("z").alias("max_elevation_m"),
    )
    out = with_quantiles(out, known, keys, "relief", [0.5]).withColumn("median_local_relief_m", F.get("quantiles", F.lit(0))).drop("quantiles")
    return out.withColumn("mountainous", is_mountainous(F.col("mountain_fraction"), F.col("mountain_area_km2"), F.col("max_elevation_m")))


def unit_statistics(cells: DataFrame, keys: list[str], value: str = "probability") -> DataFrame:
    """Per unit its cells with data, the mean, the percentage over one half, and the 90th percentile."""
    v = F.col(value)
    known = cells.filter(v.isNotNull())
    found = known.groupBy(*keys).agg(F.count(v).alias("n_cells"), F.avg(v).alias("mean"), F.avg(F.when(v > 0.5, 100.0).otherwise(0.0)).alias("unstable_percent"))
    return with_quantiles(found, known, keys, value, [0.9]).withColumn("p90", F.get("quantiles", F.lit(0))).drop("quantiles")


def cost_plan(units: DataFrame, res: float, max_cells: int = MAX_CELLS) -> DataFrame:
    """Units by how many cells they need, the most first, and whether that is too many."""
    cells = (F.round((F.col("east") - F.col("west")) / res) * F.round((F.col("north") - F.col("south")) / res)).cast("long")
    return units.withColumn("n_cells", cells).withColumn("too_large", cells > max_cells).orderBy(F.desc("n_cells"), "slug")


def worst_first(units: DataFrame, known: DataFrame) -> DataFrame:
    """Units by the unstable share known from before, unknown ones last."""
    return units.join(known.select("slug", "unstable_percent"), "slug", "left").orderBy(F.desc_nulls_last("unstable_percent"), "slug")


def missing_stages(units: DataFrame, wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(slug, stage) that is still to do: every wanted stage of every unit, less those done without errors."""
    clean = done.filter(F.coalesce(F.size("errors"), F.lit(0)) <= 0).select("slug", "stage")
    return units.select("slug").join(F.broadcast(wanted.select("stage"))).join(clean, ["slug", "stage"], "left_anti")


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the record written last."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def merge_records(records: DataFrame, order: str = "written") -> DataFrame:
    """(slug, payload) of all stages' records (slug, stage, payload map, written): later ones win key by key."""
    spread = records.filter(F.col("payload").isNotNull()).select("slug", order, F.explode("payload").alias("k", "v"))
    return spread.groupBy("slug", "k").agg(F.max_by("v", order).alias("v")).groupBy("slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("payload"))


def to_prune(outputs: DataFrame, selected: DataFrame, by: str = "country_slug") -> DataFrame:
    """Outputs of countries that are not selected."""
    return outputs.join(selected.select(by).distinct(), by, "left_anti")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, at its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)


def pooled(inventories: dict[str, DataFrame]) -> DataFrame:
    """(lon, lat, source) of several inventories, one after the other."""
    out = None
    for name, points in inventories.items():
        part = points.select("lon", "lat", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def labelled(presence: DataFrame, background: DataFrame, columns: list[str]) -> DataFrame:
    """Both with y: true for presences."""
    return presence.select(*columns, F.lit(True).alias("y")).unionByName(background.select(*columns, F.lit(False).alias("y")))
