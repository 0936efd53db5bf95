"""Points and grids: sampling, masks, resampling, mosaics and burning polygons, all as equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.gridding import Grid, sample_cell
from talweg.session import stored

RINGS = "array<array<struct<lon:double,lat:double>>>"


def sample_layers(points: DataFrame, cells: DataFrame, grid: Grid, layers: list[str]) -> DataFrame:
    """``points`` (lon, lat) with the layers of their cells; NULL outside the grid or on nodata."""
    row, col = sample_cell(F.col("lon"), F.col("lat"), grid)
    placed = points.withColumns({"at_row": row, "at_col": col})
    values = cells.select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), *layers)
    return placed.join(values, ["at_row", "at_col"], "left").select(*points.columns, *layers)


def inside(cells: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose cell is in the mask, each once however often the mask has it."""
    return cells.join(mask.select(*keys), keys, "left_semi")


def outside(cells: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(mask.select(*keys), keys, "left_anti")


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite value in every column."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return rows.filter(F.coalesce(test, F.lit(False)))


def nearest_resample(cells: DataFrame, source: Grid, target: Grid, value: str) -> DataFrame:
    """(row, col, value) of the target grid: the source cell that its cells' centres lie in."""
    spark = cells.sparkSession
    lon = F.lit(target.west) + (F.col("col") + 0.5) * target.res
    lat = F.lit(target.north) - (F.col("row") + 0.5) * target.res
    row, col = sample_cell(lon, lat, source)
    wanted = target.cells(spark).withColumns({"at_row": row, "at_col": col})
    values = cells.select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col(value))
    return wanted.join(values, ["at_row", "at_col"], "left").select("row", "col", value)


def bilinear_resample(cells: DataFrame, source: Grid, target: Grid, value: str) -> DataFrame:
    """The same by the four source cells around a centre, weighted by nearness, over those with data."""
    spark = cells.sparkSession
    x = (F.lit(target.west) + (F.col("col") + 0.5) * target.res - source.west) / source.res - 0.5
    y = (F.lit(source.north) - (F.lit(target.north) - (F.col("row") + 0.5) * target.res)) / source.res - 0.5
    corners = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)])
    at = target.cells(spark).withColumns({"x": x, "y": y}).withColumn("k", F.explode(corners))
    part_x, part_y = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    weight = F.when(F.col("k.dx") == 1, part_x).otherwise(1 - part_x) * F.when(F.col("k.dy") == 1, part_y).otherwise(1 - part_y)
    keyed = at.select("row", "col", (F.floor("y") + F.col("k.dy")).cast("int").alias("at_row"), (F.floor("x") + F.col("k.dx")).cast("int").alias("at_col"), weight.alias("w"))
    values = cells.select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col(value).alias("v"))
    met = keyed.join(values, ["at_row", "at_col"], "left")
    used = F.when(F.col("v").isNotNull(), F.col("w"))
    return met.groupBy("row", "col").agg(F.try_divide(F.sum(used * F.col("v")), F.sum(used)).alias(value))


def mosaic(pieces: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per cell the value with data of the last source."""
    return pieces.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def even_odd(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether a point is inside closed rings: a ray to the east crosses their edges an odd number of times."""

    def crossings(ring: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            at = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
            return F.coalesce(spans & (lon < at), F.lit(False))

        return F.size(F.filter(pairs, crosses))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda n, k: n + k) % 2 == 1


def polygon_cells(polygons: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """(keep, row, col) of the cells whose centres lie in each polygon (``rings``), by rows of the grid.

    Each edge becomes a row for every row of cells whose centres' latitude it crosses, with the longitude where. The
    crossings of a polygon and row, in order, are where it is entered and left, which gives runs of cells. So the work
    goes with the outline and the result, not with the polygon's box, and no task holds a polygon's rings for long.
    """
    numbered = stored(polygons.select(*keep, "rings", F.monotonically_increasing_id().alias("polygon")))
    ring = numbered.select("polygon", F.explode("rings").alias("ring")).filter("size(ring) > 1")
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    edges = ring.select("polygon", F.explode(pairs).alias("e")).select("polygon", *[F.col(f"e.{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("lon", "lat")])
    centre = lambda k: F.lit(grid.north) - (k + 0.5) * grid.res
    row_of = lambda lat, more: F.least(F.greatest(F.floor((F.lit(grid.north) - lat) / grid.res - 0.5) + more, F.lit(0)), F.lit(grid.height - 1)).cast("int")
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    crossing = edges.filter(low < high).withColumn("row", F.explode(F.sequence(row_of(high, 0), F.greatest(row_of(low, 1), row_of(high, 0)))))
    lat = centre(F.col("row"))
    spans = (F.col("a_lat") > lat) != (F.col("b_lat") > lat)
    at = F.col("a_lon") + (lat - F.col("a_lat")) / (F.col("b_lat") - F.col("a_lat")) * (F.col("b_lon") - F.col("a_lon"))
    order = Window.partitionBy("polygon", "row").orderBy("x")  # the edges that one row of cells crosses
    ordered = crossing.filter(spans).select("polygon", "row", at.alias("x")).withColumns({"nth": F.row_number().over(order), "until": F.lead("x").over(order)})
    runs = ordered.filter("nth % 2 = 1 AND until IS NOT NULL")
    middle = lambda k: F.lit(grid.west) + (k + 0.5) * grid.res

    def first_from(x: Column) -> Column:
        """The first column whose centre is at ``x`` or east of it."""
        near = F.ceil((x - grid.west) / grid.res - 0.5)
        return F.when(middle(near - 1) >= x, near - 1).when(middle(near) < x, near + 1).otherwise(near)

    begin, end = F.greatest(first_from(F.col("x")), F.lit(0)), F.least(first_from(F.col("until")) - 1, F.lit(grid.width - 1))
    wide = runs.select("polygon", "row", begin.cast("int").alias("c0"), end.cast("int").alias("c1")).filter("c0 <= c1")
    cells = wide.select("polygon", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return cells.join(numbered.drop("rings"), "polygon").select(*keep, "row", "col")


def burn(polygons: DataFrame, grid: Grid, code: str, order: str) -> DataFrame:
    """(row, col, code): of the polygons over a cell the last one's code."""
    return polygon_cells(polygons, grid, [code, order]).groupBy("row", "col").agg(F.max_by(code, order).alias(code))


def representative_point(points: Column) -> Column:
    """The mean of all coordinates of a geometry (array of lon, lat), closing ones included."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.nullif(F.size(points), F.lit(0))
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def polygon_points(vertices: DataFrame, key: str, value: str = "z") -> DataFrame:
    """Per polygon its highest vertex (crown), the mean of those in its upper quarter, and its lowest (toe)."""
    cuts = vertices.groupBy(key).agg(F.percentile(value, F.lit(0.75)).alias("cut"))
    met = vertices.join(cuts, key)
    upper = F.col(value) >= F.col("cut")
    pick = lambda f, c: f(c, F.struct(value, "lon", "lat"))
    return met.groupBy(key).agg(
        *[pick(F.max_by, c).alias(f"crown_{c}") for c in ("lon", "lat")],
        *[F.avg(F.when(upper, F.col(c))).alias(f"upper_{c}") for c in ("lon", "lat")],
        *[pick(F.min_by, c).alias(f"toe_{c}") for c in ("lon", "lat")],
    )


#: Rows of one range of hashes that a task may put in order.
FEW = 100_000
#: Bits that a step narrows the hash by.
STEP_BITS = 16


def least_hashes(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows (all, if there are fewer) of least hash of (row, col), equal hashes by row and col.

    Hashes are counted by their first bits, which names the range that the n-th lies in, and then by the next ones,
    until that range is small. So only a few rows are ever put in order, whatever ``n`` is.
    """
    size = cells.count()
    if size <= n:
        return cells
    known = stored(cells.withColumn("hash", F.xxhash64("row", "col", F.lit(seed))))
    inside, below, left = known, None, n  # ``left`` rows are wanted of those ``inside``, and all ``below``
    for bits in range(64 - STEP_BITS, -1, -STEP_BITS):
        if size <= FEW:
            break
        range_ = F.shiftright("hash", bits)
        counts = inside.groupBy(range_.alias("at")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** STEP_BITS rows
        ahead = counts.withColumn("ahead", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        found = ahead.filter((F.col("ahead") < left) & (F.col("ahead") + F.col("n") >= left)).first()
        if found is None:  # none is wanted
            return known.limit(0).drop("hash")
        left, size = left - found["ahead"], found["n"]
        inside, below = known.filter(range_ == found["at"]), known.filter(range_ < found["at"])
    last = inside.orderBy("hash", "row", "col").limit(left)
    return (last if below is None else below.unionByName(last)).drop("hash")


def background_points(cells: DataFrame, grid: Grid, n: int, seed: int = 0) -> DataFrame:
    """(lon, lat) of ``n`` cells (all, if there are fewer) drawn evenly from ``cells`` (row, col), each at a random place inside.

    The cells of the least hashes are taken, so the draw does not depend on partitions.
    """
    chance = lambda salt: F.pmod(F.xxhash64("row", "col", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    taken = least_hashes(cells.select("row", "col"), n, seed)
    return taken.select((F.lit(grid.west) + (F.col("col") + chance("x")) * grid.res).alias("lon"), (F.lit(grid.north) - (F.col("row") + chance("y")) * grid.res).alias("lat"))


TARGET_GROUP_DEGREES = 0.15


def near_presence(cells: DataFrame, grid: Grid, presence: DataFrame, within: float = TARGET_GROUP_DEGREES) -> DataFrame:
    """The ``cells`` (row, col) whose centres lie within ``within`` degrees east-west and north-south of a presence (lon, lat).

    Background drawn from them is where observers of the presences were, so it shares their bias. Presences of one cell
    count once, at its centre; squares of the side ``within`` are joined with the nine around them on their numbers.
    """
    reach = round(within / grid.res, 9)  # in cells
    side = max(int(reach), 1)
    at = presence.select(F.floor((F.lit(grid.north) - F.col("lat")) / grid.res).alias("p_row"), F.floor((F.col("lon") - grid.west) / grid.res).alias("p_col")).distinct()
    steps = F.array(*[F.lit(k) for k in range(-1, 2)]) if reach >= 1 else F.array(F.lit(0))
    spread = at.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    spread = spread.select("p_row", "p_col", (F.floor(F.col("p_row") / side) + F.col("i")).alias("p_by"), (F.floor(F.col("p_col") / side) + F.col("j")).alias("p_bx"))
    near = (F.floor(F.col("row") / side) == F.col("p_by")) & (F.floor(F.col("col") / side) == F.col("p_bx"))
    near &= (F.abs(F.col("row") - F.col("p_row")) <= reach) & (F.abs(F.col("col") - F.col("p_col")) <= reach)
    # nine rows for each cell of a presence: by the size of the presences' table they would be sent to every task
    return cells.join(spread.hint("merge"), near, "left_semi")
