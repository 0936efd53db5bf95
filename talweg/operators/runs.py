"""Whole runs as single calls: units with buffers, trigger scenarios, climates, validation on held-out presences, and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import scores, triggers
from talweg.functions.gridding import Grid, asset_cell, sample_cell
from talweg.operators import hydrology, lines, ranking, reach, sampling, stability, units, validation
from talweg.operators.stability import Soil
from talweg.session import stored

BUFFER_DEG = 0.028
PATCH = 64  # cells of a side of the patches that units and cells are matched by
LEAST_COVERAGE, LEAST_BACKGROUND = 0.9, 2_000

Box = tuple[float, float, float, float]


# --- units -------------------------------------------------------------------------------------------------------


def unit_windows(boxes: DataFrame, grid: Grid, buffer_deg: float = BUFFER_DEG, region: Box | None = None) -> DataFrame:
    """``boxes`` (slug, west, south, east, north) with the grid's rows and columns of their buffered boxes.

    r0, r1, c0, c1 are the window's first and last row and column, inside the grid and ``region``; n_cells their number.
    """
    wide = units.buffered(tuple(F.col(c) for c in ("west", "south", "east", "north")), buffer_deg)
    limits = region or (grid.west, grid.south, grid.east, grid.north)
    west, south, east, north = (F.greatest(wide[0], F.lit(limits[0])), F.greatest(wide[1], F.lit(limits[1])), F.least(wide[2], F.lit(limits[2])), F.least(wide[3], F.lit(limits[3])))
    at = lambda x, most: F.least(F.greatest(F.round(x).cast("int"), F.lit(0)), F.lit(most))
    placed = boxes.withColumns({
        "r0": at((F.lit(grid.north) - north) / grid.res, grid.height), "r1": at((F.lit(grid.north) - south) / grid.res, grid.height) - 1,
        "c0": at((west - grid.west) / grid.res, grid.width), "c1": at((east - grid.west) / grid.res, grid.width) - 1,
    })
    return placed.withColumn("n_cells", F.greatest(F.col("r1") - F.col("r0") + 1, F.lit(0)).cast("long") * F.greatest(F.col("c1") - F.col("c0") + 1, F.lit(0)))


def windowed_cells(cells: DataFrame, windows: DataFrame, grid: Grid) -> DataFrame:
    """``cells`` (row, col, ...) once for each window that holds them: grid_id (the slug), row and col in the window,
    at_row and at_col in the grid, and ``own``, whether the cell's centre lies in the unit's box itself.

    Windows and cells meet by patches of the grid, so a cell only ever meets the windows near it.
    """
    patch = lambda a, b: F.sequence((F.col(a) / PATCH).cast("int"), (F.col(b) / PATCH).cast("int"))
    wanted = windows.filter("n_cells > 0").withColumn("patch_row", F.explode(patch("r0", "r1"))).withColumn("patch_col", F.explode(patch("c0", "c1")))
    keyed = cells.withColumns({"patch_row": (F.col("row") / PATCH).cast("int"), "patch_col": (F.col("col") / PATCH).cast("int")})
    met = keyed.join(wanted, ["patch_row", "patch_col"]).filter("row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
    lon, lat = F.lit(grid.west) + (F.col("col") + 0.5) * grid.res, F.lit(grid.north) - (F.col("row") + 0.5) * grid.res
    own = lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north"))
    rest = [c for c in cells.columns if c not in ("row", "col", "grid_id")]
    return met.select(F.col("slug").alias("grid_id"), (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), F.col("row").alias("at_row"), F.col("col").alias("at_col"), own.alias("own"), *rest)


def run_units(
    cells: DataFrame, boxes: DataFrame, grid: Grid, soil: Soil, buffer_deg: float = BUFFER_DEG, region: Box | None = None, n_draws: int = 100, seed: int = 0, max_cells: int = units.MAX_CELLS, tile: int = hydrology.TILE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maps, statistics and records of every unit (slug, west, south, east, north), all routed in the same jobs.

    Each unit is routed over its buffered box, so water enters from outside, and clipped to its own box afterwards.
    Maps are (slug, row, col, slope, sca, probability, class) of the units' own cells; statistics cells_in_unit,
    buffer_fraction, mean_probability, unstable_area_pct and p90_probability; records (slug, stage, errors): a unit that
    fails is recorded with the reason and holds no other up. If all fail, that is an error.
    """
    windows = stored(unit_windows(boxes, grid, buffer_deg, region))
    fits = windows.filter((F.col("n_cells") > 0) & (F.col("n_cells") <= max_cells))
    wide = stored(windowed_cells(cells.select("row", "col", F.col("z").cast("double").alias("z")), fits, grid))
    dx, dy = grid.metres()
    routed = hydrology.specific_catchment_area(wide.select("grid_id", "row", "col", "z"), dx, dy, tile)
    own = wide.filter("own").select("grid_id", "row", "col", "at_row", "at_col")
    inside = routed.select("grid_id", "row", "col", "slope", "sca").join(own, ["grid_id", "row", "col"])
    scored = stability.classes(inside, soil, stability.draws(soil, n_draws, seed))
    maps = stored(scored.select(F.col("grid_id").alias("slug"), F.col("at_row").alias("row"), F.col("at_col").alias("col"), "slope", "sca", "probability", "class"))
    counted = maps.groupBy("slug").agg(F.count(F.lit(1)).alias("cells_in_unit"))
    known = units.unit_statistics(maps, ["slug"])
    met = fits.select("slug", F.col("n_cells").alias("n_window")).join(counted, "slug", "left").join(known, "slug", "left")
    share = 1 - F.coalesce("cells_in_unit", F.lit(0)) / F.col("n_window")
    statistics = met.select("slug", F.coalesce("cells_in_unit", F.lit(0)).cast("long").alias("cells_in_unit"), share.alias("buffer_fraction"), F.col("mean").alias("mean_probability"), F.coalesce("unstable_percent", F.lit(0.0)).alias("unstable_area_pct"), F.col("p90").alias("p90_probability"))
    statistics = stored(statistics)
    reason = F.when(F.col("n_cells") <= 0, "outside the grid").when(F.col("n_cells") > max_cells, "too many cells").when(F.coalesce("cells_in_unit", F.lit(0)) <= 0, "no cell lies in the unit").when(F.col("mean_probability").isNull(), "no cell has data")
    records = windows.select("slug", "n_cells").join(statistics.select("slug", "cells_in_unit", "mean_probability"), "slug", "left")
    records = stored(records.select("slug", F.lit("susceptibility").alias("stage"), F.array_compact(F.array(reason)).alias("errors")))
    raise_if_all_failed(records)
    return maps, statistics, records


def raise_if_all_failed(records: DataFrame) -> None:
    """An error with some of the reasons, if there are records (slug, stage, errors) and every one has errors."""
    one = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("bad")).first()
    if one.n and one.n == one.bad:
        some = records.orderBy("slug", "stage").limit(5).collect()
        raise RuntimeError("every requested stage failed: " + "; ".join(f"{r.slug} {r.stage}: {', '.join(r.errors)}" for r in some))


# --- scenarios ---------------------------------------------------------------------------------------------------


def hazard_scenarios(spark, return_periods: list[float], accelerations: list[float]) -> DataFrame:
    """(scenario, trigger, multiplier, k_h, description): rainfall by return period and earthquakes by acceleration."""
    rows = [(f"rp{y:g}", "rainfall", float(y), None) for y in return_periods] + [(f"pga{a:g}", "earthquake", None, float(a)) for a in accelerations]
    asked = spark.createDataFrame(rows, "scenario string, trigger string, years double, pga double")
    kind, years, pga = F.col("trigger"), F.col("years"), F.col("pga")
    return asked.select("scenario", "trigger", triggers.recharge_term(kind, years).alias("multiplier"), triggers.shaking_term(kind, pga).alias("k_h"), triggers.describe_trigger(kind, years, pga).alias("description"))


def hazard_suite(layers: DataFrame, scenarios: DataFrame, table, depth_k: float = 0.0) -> DataFrame:
    """``layers`` (slope, sca and, if there, recharge) with scenario and probability: a row for each cell and trigger scenario."""
    terms = F.broadcast(scenarios.select("scenario", "multiplier", "k_h"))  # a row for each scenario asked for
    met = layers.crossJoin(terms).withColumn("recharge", F.col("multiplier") * (F.col("recharge") if "recharge" in layers.columns else F.lit(1.0)))
    return stability.failure_probability(met.drop("multiplier"), table, depth_k).drop("recharge", "k_h")


def twelve_months(bands: DataFrame, keys: list[str], month: str = "band") -> DataFrame:
    """``bands`` unchanged, if every key has exactly the months 1 to 12; else reading it is an error that names the key.

    The test is part of the plan: a key's distinct months are counted before its rows go on.
    """
    counts = bands.groupBy(*keys).agg(F.count_distinct(month).alias("n"), F.min(month).alias("low"), F.max(month).alias("high"))
    whole = (F.col("n") == 12) & (F.col("low") == 1) & (F.col("high") == 12)
    message = F.concat(F.lit("expected 12 months of "), F.to_json(F.struct(*keys)), F.lit(", got "), F.col("n").cast("string"))
    tested = counts.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.when(whole, True).otherwise(F.raise_error(message).cast("boolean")).alias("tested"))
    met = bands.join(F.broadcast(tested), [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys])  # a row for each scenario
    return met.filter("tested").select(*bands.columns)


def climate_run(layers: DataFrame, bands: DataFrame, table, depth_k: float = 0.0, baseline: str = "current", cell: tuple[str, ...] = ("row", "col")) -> tuple[DataFrame, DataFrame]:
    """Probabilities under the present and future climates, and a row of report for each.

    ``layers`` (cell, slope, sca) were routed once; ``bands`` (scenario, cell, band, mm) has twelve months of each scenario.
    Recharge is the wettest month over the *baseline's* reference for every scenario, so a wetter future shows as a
    shift. The first table is (cell, scenario, probability), the second (scenario, mean_probability,
    unstable_area_pct, mean_change, pct_more_likely), the baseline's changes 0.
    """
    rain = stored(stability.wettest_month(twelve_months(bands, ["scenario"]), ["scenario", *cell]))
    reference = stability.reference_recharge(rain.filter(F.col("scenario") == baseline))
    scaled = rain.crossJoin(F.broadcast(reference)).select("scenario", *cell, (F.col("mm") / F.col("reference")).alias("recharge"))  # one row
    met = layers.select(*cell, "slope", "sca").join(scaled, list(cell))
    scored = stored(stability.failure_probability(met, table, depth_k).select(*cell, "scenario", "probability"))
    means = scored.groupBy("scenario").agg(F.avg("probability").alias("mean_probability"))
    areas = stability.area_above(scored, ["scenario"]).withColumnRenamed("percent_above", "unstable_area_pct")
    moved = stability.change_statistics(stability.change(scored, list(cell), baseline))
    moved = moved.select("scenario", "mean_change", (100.0 * F.col("n_up") / F.col("n_cells")).alias("pct_more_likely"))
    zero = lambda c: F.when(F.col("scenario") == baseline, 0.0).otherwise(F.col(c)).alias(c)
    report = means.join(areas, "scenario").join(moved, "scenario", "left")
    return scored, report.select("scenario", "mean_probability", "unstable_area_pct", zero("mean_change"), zero("pct_more_likely"))


# --- validation --------------------------------------------------------------------------------------------------


def validation_run(cells: DataFrame, grid: Grid, presence: DataFrame, value: str = "probability", survey: DataFrame | None = None, classes: Column | None = None, seed: int = 0) -> DataFrame:
    """One row on how a map ranks held-out presences (lon, lat) over background: coverage, numbers, AUC, verdict.

    The map has to cover 0.9 of the presences, else that is an error: a few caught in a corner say nothing. Background
    are max(4 n, 2000) cells with data inside ``survey`` (row, col), if that is given, else of the whole map. Bins of
    equal area of the positive values, or ``classes``, give the ratios of presences to area.
    """
    share = validation.share_inside(presence, grid.west, grid.south, grid.east, grid.north).first()
    if not share.n or share.share < LEAST_COVERAGE:
        raise ValueError(f"the map covers {100 * (share.share or 0):.0f} % of the presences; 90 % are needed")
    known = stored(cells.filter(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("score")))
    row, col = sample_cell(F.col("lon"), F.col("lat"), grid)
    placed = presence.select(row.alias("row"), col.alias("col")).filter("row IS NOT NULL")
    # a table of few values is small on disk and of many rows in memory: by its size it would be sent to the driver
    hits = stored(placed.join(known.hint("merge"), ["row", "col"]))
    n = hits.count()
    if not n:
        raise ValueError("no presence lies on a cell with data")
    area = known if survey is None else sampling.inside(known, survey, ["row", "col"])
    drawn = sampling.least_hashes(area, max(4 * n, LEAST_BACKGROUND), seed)
    labelled = hits.select("score", F.lit(True).alias("y")).unionByName(drawn.select("score", F.lit(False).alias("y")))
    aucs = stored(ranking.auc(labelled, []))
    if classes is None:
        edges = validation.quantile_edges(area, "score")
        binned = lambda rows: rows.crossJoin(F.broadcast(edges)).withColumn("bin", validation.bin_of(F.col("score"), F.col("edges")))  # noqa: E731  one row
    else:
        binned = lambda rows: rows.withColumn("bin", classes)
    both = binned(area.select("score", F.lit(0).alias("hit"))).select("bin", "hit").unionByName(binned(hits.select("score", F.lit(1).alias("hit"))).select("bin", "hit"))
    counts = both.filter("bin IS NOT NULL").groupBy("bin").agg(F.count_if(F.col("hit") == 0).alias("n_cells"), F.count_if(F.col("hit") == 1).alias("n_presence"))
    total = counts.agg(F.sum("n_cells").alias("all_cells"), F.sum("n_presence").alias("all_presence"))
    shares = counts.crossJoin(F.broadcast(total)).select("bin", (100.0 * F.col("n_cells") / F.col("all_cells")).alias("area_percent"), (100.0 * F.col("n_presence") / F.col("all_presence")).alias("presence_percent"))  # one row
    ratios = shares.withColumn("ratio", F.try_divide("presence_percent", "area_percent"))
    judged = validation.verdict(ratios, aucs, "bin")
    return judged.crossJoin(aucs.select("n_pos", "n_neg")).select(F.lit(share.share).alias("coverage"), F.col("n_pos").alias("n_presence"), F.col("n_neg").alias("n_background"), "auc", "monotone", "top_presence_percent", "top_area_percent", "efficiency", "verdict")


# --- exposure ----------------------------------------------------------------------------------------------------


def exposure_run(
    settlements: DataFrame, roads: DataFrame, cells: DataFrame, probability: DataFrame, grid: Grid, radius_m: float = reach.MAX_RUN_M, piece_m: float = lines.PIECE_M, baseline: str = "current"
) -> tuple[DataFrame, DataFrame]:
    """Scores of settlements and stretches of road under every scenario, and their summary, in one call.

    ``settlements`` (asset_id, lon, lat, place, population), ``roads`` (asset_id, coords), ``cells`` (row, col, z) and
    ``probability`` (row, col, scenario, p). A settlement is its disc of cells, a road is cut into pieces first; all
    their cells are searched for what can reach them in one job. The first table is (kind, asset, scenario, score,
    on_site, reaching, band, people, km), the second per kind and scenario the number, those exposed, their people or
    kilometres, the mean score and the changes from the baseline. Assets outside the grid are left out.
    """
    dx, dy = grid.metres()
    row, col = asset_cell(F.col("lon"), F.col("lat"), grid)
    placed = settlements.withColumns({"row": row, "col": col}).filter("row IS NOT NULL AND col IS NOT NULL")
    named = placed.select(F.concat(F.lit("settlement-"), F.col("asset_id").cast("string")).alias("asset_id"), "place", "row", "col", F.col("population").cast("long").alias("people"))
    cut = lines.pieces(roads, ["asset_id"], piece_m)
    stretches = stored(cut.select(F.concat_ws("-", F.lit("road"), F.col("asset_id").cast("string"), F.col("piece").cast("string")).alias("asset_id"), "coords", (lines.length_m(F.col("coords")) / 1000).alias("km")))
    discs = reach.footprint(named, dx, dy, grid.height, grid.width)
    targets = stored(discs.unionByName(lines.line_cells(stretches, grid)))
    edges = reach.reach_edges(targets, cells, dx, dy, radius_m)
    vertices = stored(reach.vertex_scores(targets, edges, probability, dx * dy))
    columns = ["asset_id", "scenario", "score", "on_site", "reaching"]
    is_road = F.col("asset_id").startswith("road-")
    points = reach.footprint_scores(vertices.filter(~is_road)).select(*columns).join(named.select("asset_id", "people"), "asset_id")
    ways = reach.segment_scores(vertices.filter(is_road)).select(*columns).join(stretches.select("asset_id", "km"), "asset_id")
    both = points.withColumn("km", F.lit(None).cast("double")).unionByName(ways.withColumn("people", F.lit(None).cast("long")))
    kind = F.when(is_road, "roads").otherwise("settlements")
    assets = stored(both.select(kind.alias("kind"), F.col("asset_id").alias("asset"), *columns[1:], scores.band(F.col("score")).alias("band"), "people", "km"))
    exposed = F.col("score") >= scores.EXPOSED
    zero = lambda c, test=F.lit(True): F.sum(F.when(test, F.coalesce(F.col(c), F.lit(0))).otherwise(0))  # noqa: E731, B008
    totals = assets.groupBy("kind", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(exposed).alias("n_exposed"), F.avg("score").alias("mean_score"), zero("people").alias("people"), zero("people", exposed).alias("people_exposed"), zero("km").alias("km"), zero("km", exposed).alias("km_exposed")
    )
    return assets, reach.totals_change(totals, ["n_exposed", "people_exposed", "km_exposed"], baseline, ["kind"])
