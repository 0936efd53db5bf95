"""What larger tables showed: results held against brute force, and plans or figures that must not grow with the rows."""

import json
import math
import tracemalloc

from pyspark.sql import functions as F

from talweg.functions import scores as S
from talweg.functions.gridding import Grid
from talweg.operators import graph, hydrology, reach, runs, sampling, tiles
from talweg.plans import registry, views
from talweg.sources import json_arrays


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_discs_are_made_once(spark):
    rows = [(1, 5, 5, "hamlet"), (2, 0, 0, "village"), (3, 9, 9, None)]
    towns = spark.createDataFrame(rows, "asset_id long, row int, col int, place string")
    got = reach.footprint(towns, 60.0, 90.0, 10, 10)
    made = plan(got)
    assert "Generate" in made.partition("Join")[2] and "Generate" not in made.partition("Join")[0]  # not for each settlement
    assert "asset_id" not in made.rpartition("Generate")[2]
    found = sorted((r.asset_id, r.vertex, r.row, r.col) for r in got.collect())
    want = []
    for key, row, col, place in rows:
        radius = S.FOOTPRINT_M.get(place, S.DEFAULT_FOOTPRINT_M)
        around = [(dr, dc) for dr in range(-20, 21) for dc in range(-20, 21) if 0 < math.hypot(dr * 90.0, dc * 60.0) <= radius]
        want += [(key, k, row + dr, col + dc) for k, (dr, dc) in enumerate([(0, 0), *around]) if 0 <= row + dr < 10 and 0 <= col + dc < 10]
    assert found == sorted(want)


def test_least_hashes_are_the_first_in_order(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FEW", 3)
    cells = Grid(0.0, 0.0, 4.0, 3.0, 0.1).cells(spark)
    cells = cells.unionByName(cells.filter("row < 2"))  # equal hashes
    hashed = [tuple(r) for r in cells.select(F.xxhash64("row", "col", F.lit(5)), "row", "col").collect()]
    for n in (0, 1, 7, 400, len(hashed), 9_999):
        got = sampling.least_hashes(cells, n, 5)
        assert sorted((r.row, r.col) for r in got.collect()) == sorted(t[1:] for t in sorted(hashed)[:n])


def test_validation_sends_no_map_to_the_driver(spark, monkeypatch):
    grid = Grid(0.0, 0.0, 10.0, 10.0, 0.1)
    cells = grid.cells(spark, probability=(F.col("row") % 4) / 4)
    presence = cells.filter("row % 4 = 3").select(((F.col("col") + 0.5) / 10).alias("lon"), (10 - (F.col("row") + 0.5) / 10).alias("lat"))
    plans, before = [], runs.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df)

    monkeypatch.setattr(runs, "stored", seen)
    out = runs.validation_run(cells, grid, presence).first()
    assert (out.n_presence, out.n_background, out.auc) == (2_500, 10_000, 0.875)
    assert "SortMergeJoin" in plans[1] and not any("TakeOrdered" in p for p in plans)


def test_a_range_of_json_is_read_in_blocks():
    rows = [{"id": k, "tags": {"n": "a\"}]{" * (k % 5)}, "at": [[k, -k]] * (k % 9)} for k in range(9_000)]
    rows[4_000]["long"] = "x{" * 800_000
    body = json.dumps({"head": {"a": [1]}, "elements": rows}).encode()
    read = lambda at, size: body[at : at + size]
    found, state, depth, peak = [], json_arrays.OUTSIDE, 0, 0
    edges = [0, 999_999, len(body) // 2, len(body)]
    for start, stop in zip(edges, edges[1:], strict=False):
        found += [json.loads(o) for o in json_arrays.objects_in(read, start, stop, len(body), state, depth, 2)]
        ends, deeper = json_arrays.summed_up(read, start, stop)
        state, depth = ends[state], depth + deeper[state]
    assert found == rows and (state, depth) == (json_arrays.OUTSIDE, 0)
    many = body[:-2] + (b"," + json.dumps(rows[8]).encode()) * 200_000 + b"]}"
    assert len(many) > 16 << 20
    tracemalloc.start()
    n = sum(1 for _ in json_arrays.objects_in(lambda at, size: many[at : at + size], 0, 16 << 20, len(many), json_arrays.OUTSIDE, 0, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 100 << 20


def test_scores_by_tiles_are_those_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(reach, "TILE", 7)
    grid = Grid(0.0, 0.0, 3.0, 4.0, 0.1)
    z = F.when(F.col("row") * 31 + F.col("col") != 200, (F.col("row") * 37 + F.col("col") * 53 + F.col("row") * F.col("col")) % 97 * 3.0)
    cells = grid.cells(spark, z=z)
    p = cells.select("row", "col", F.explode(F.array(F.lit("dry"), F.lit("wet"))).alias("scenario"), (F.pmod(F.xxhash64("row", "col"), F.lit(11)) / 11.0).alias("p"))
    p = p.withColumn("p", F.when((F.col("scenario") == "dry") | (F.col("row") % 5 > 0), F.col("p")))
    targets = cells.filter("(row * 7 + col) % 3 = 0").select(F.concat_ws("-", "row", "col").alias("asset_id"), (F.col("col") % 2).alias("vertex"), "row", "col")
    targets = targets.unionByName(targets.limit(5).withColumn("asset_id", F.concat(F.lit("x"), "asset_id")))
    edges = reach.reach_edges(targets, cells, 26.0, 30.0, 120.0)
    got = reach.tile_scores(targets, cells, p, 26.0, 30.0, 120.0)
    key = lambda r: (r.asset_id, r.vertex, r.scenario)
    have, want = ({key(r): r for r in df.collect()} for df in (got, reach.reach_scores(edges, p, 780.0)))
    assert len(want) > 300 and set(have) == set(want)
    for k, r in want.items():
        assert (have[k].n_sources, have[k].reaching_max, have[k].source_relief_m, have[k].source_distance_m) == (r.n_sources, r.reaching_max, r.source_relief_m, r.source_distance_m)
        assert math.isclose(have[k].reaching, r.reaching) and math.isclose(have[k].delivering_m2, r.delivering_m2)
    have, want = ({key(r): (r.sector, round(r.sector_reaching, 9)) for r in df.collect()} for df in (reach.sectors_of(got), reach.worst_sector(edges, p)))
    assert have == want
    assert "Join" not in plan(got)  # no edge is shuffled


def test_squares_around_are_not_sent_to_every_task(spark):
    grid = Grid(0.0, 0.0, 3.0, 3.0, 0.1)
    cells = grid.cells(spark)
    points = cells.select((F.col("row") * 30 + F.col("col")).alias("asset_id"), (F.col("col") * 0.001).alias("lon"), (F.col("row") * 0.001).alias("lat"))
    near = sampling.near_presence(cells, grid, points.filter("asset_id = 0"))
    pairs = graph.pairs_within(points, 115.0, 0.0)
    for df, n in ((near, 2), (pairs, 2 * 29 * 30)):
        assert df.count() == n
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_routing_move_rows_of_tiles(spark, monkeypatch):
    grid = Grid(0.0, 0.0, 3.0, 4.0, 0.1)
    z = F.col("row") * 9.0 + (F.col("row") * 37 + F.col("col") * 53) % 29
    cells = grid.cells(spark, z=z).withColumn("grid_id", F.lit("a"))
    kept, before = [], hydrology.stored

    def seen(df):
        kept.append(before(df))
        return kept[-1]

    monkeypatch.setattr(hydrology, "stored", seen)
    whole = {(r.row, r.col): r.sca for r in hydrology.specific_catchment_area(cells, 26.0, 30.0).collect()}
    assert [t.count() for t in kept] == [1, 1_200, 4, 1]  # tiles, directions, tiles and what is around, flows
    kept.clear()
    found = {(r.row, r.col): r.sca for r in hydrology.specific_catchment_area(cells.repartition(5), 26.0, 30.0, 20).collect()}
    assert kept[0].count() == 4 and all(math.isclose(found[k], whole[k], rel_tol=1e-9) for k in whole) and len(found) == 1_200


def test_scores_with_sites_come_from_packed_cells(spark, monkeypatch):
    monkeypatch.setattr(reach, "TILE", 7)
    grid = Grid(0.0, 0.0, 3.0, 4.0, 0.1)
    z = F.when(F.col("row") * 31 + F.col("col") != 200, (F.col("row") * 37 + F.col("col") * 53 + F.col("row") * F.col("col")) % 97 * 3.0)
    cells = grid.cells(spark, z=z)
    p = cells.select("row", "col", F.explode(F.array(F.lit("dry"), F.lit("wet"))).alias("scenario"), (F.pmod(F.xxhash64("row", "col"), F.lit(11)) / 11.0).alias("p"))
    p = p.withColumn("p", F.when((F.col("scenario") == "dry") | (F.col("row") % 5 > 0), F.col("p"))).filter("scenario = 'wet' OR col % 4 > 0")
    targets = cells.filter("(row * 7 + col) % 3 = 0").select(F.concat_ws("-", "row", "col").alias("asset_id"), (F.col("col") % 2).alias("vertex"), "row", "col", F.when(F.col("col") > 3, F.col("row")).alias("people"))
    got = reach.tile_scores(targets, cells, p, 26.0, 30.0, 120.0, site=True)
    edges = reach.reach_edges(targets, cells, 26.0, 30.0, 120.0)
    columns = ["asset_id", "vertex", "scenario", "on_site", "reaching", "reaching_max", "n_sources", "delivering_m2", "source_relief_m", "source_distance_m", "score", "people"]
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()), key=str)
    want = rows(reach.vertex_scores(targets, edges, p, 780.0))
    assert len(want) > 600 and any(r[3] == 0 for r in want) and rows(got) == want
    assert "Join" not in plan(got)
    packed = tiles.pieces(p, ["scenario"], ["p"], 7, 7, 2, 2)
    assert 0 < packed.count() < p.count() / 4  # rows shuffled


def test_discs_are_neither_sent_to_the_driver_nor_made_rows(spark):
    query = registry.queries()["q_footprint_p90"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(query) and "Generate" not in plan(query)
    towns = spark.createDataFrame([(1, 5, 5, "hamlet")], "asset_id long, row int, col int, place string")
    met = reach.footprint(towns, 60.0, 90.0, 10, 10).join(Grid(0.0, 0.0, 1.0, 1.0, 0.1).cells(spark), ["row", "col"])
    assert met._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1  # the table of discs


def test_cells_of_footprints_by_rank_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(reach, "TILE", 1)
    monkeypatch.setattr(reach, "AT_ONCE", 500)
    dx, dy, height, width = 60.0, 90.0, 50, 45
    p = {(r, c): ((r * 31 + c * 17) % 7) / 7 for r in range(height) for c in range(width) if (r * 5 + c) % 11}
    rows = [(*k, v) for k, v in p.items()] + [(20, c, p[20, c]) for c in range(width) if (20, c) in p] + [(r, r * 2, None) for r in range(9)] + [(None, 3, 0.5)]
    rows = [t for t in rows if t[:2] not in {(r, r * 2) for r in range(9)} or t[2] is None]  # no value there
    places = [*S.FOOTPRINT_M, "other", None]
    towns = [(f"a{k}", (k * 13) % (height + 6) - 3, (k * 7) % (width + 6) - 3, places[k % 6]) for k in range(70)] + [("none", 5, None, "city"), ("far", 900, 900, "city")]
    towns += [("a1", *towns[1][1:3], "town"), ("a2", *towns[2][1:3], places[2])]  # rows of one asset count together
    given = spark.createDataFrame(rows, "row int, col int, p double").repartition(3)
    got = reach.footprint_cells(spark.createDataFrame(towns, "asset_id string, row int, col int, place string").repartition(3), given, dx, dy, "p")
    found = {}
    for key, row, col, place in towns:
        radius = S.FOOTPRINT_M.get(place, S.DEFAULT_FOOTPRINT_M)
        if col is not None:
            found.setdefault(key, []).extend((v, r, c) for r, c, v in rows if r is not None and v is not None and math.hypot((r - row) * dy, (c - col) * dx) <= radius)
    want = {(key, *sorted(met)[round(0.9 * (len(met) - 1))]) for key, met in found.items() if met}
    assert {(r.asset_id, r.p, r.row, r.col) for r in got.collect()} == want and got.count() == len(want) > 60


def test_footprints_are_those_of_the_place(spark):
    sf_dir = "/root/testdata/sf0.001"
    cells = [(r.p, r.row, r.col) for r in views.cells(spark, sf_dir).collect()]
    got = {r.asset_id: (r.score, r.row, r.col) for r in registry.queries()["q_footprint_p90"](spark, sf_dir).collect()}
    towns = views.settlements(spark, sf_dir).collect()
    assert {t.place for t in towns} == set(S.FOOTPRINT_M)
    for t in towns:
        met = sorted(c for c in cells if math.hypot((c[1] - t.row) * views.DY, (c[2] - t.col) * views.DX) <= S.FOOTPRINT_M[t.place])
        p, *cell = met[round(0.9 * (len(met) - 1))]
        assert got[t.asset_id] == (round(p, 6), *cell)
