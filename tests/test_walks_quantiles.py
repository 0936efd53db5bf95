import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talweg.operators import quantiles as Q
from talweg.operators import walks as W


def surface(seed, height, width):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(height, width)), 1)  # with ties


def frame(spark, z):
    rows = [(0, r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(z) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "grid_id int, row int, col int, z double").repartition(3)


def serial_walk(z, r, c, most=10**9):
    path = [(r, c)]
    while len(path) < most:
        best, nxt = np.inf, None
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                y, x = r + dr, c + dc
                if (dr or dc) and 0 <= y < z.shape[0] and 0 <= x < z.shape[1] and z[y, x] < best:
                    best, nxt = z[y, x], (y, x)
        if nxt is None or not best < z[r, c]:
            break
        r, c = nxt
        path.append(nxt)
    return path


@pytest.mark.parametrize("most", [None, 1, 3])
def test_walks_equal_serial_ones(spark, most):
    z = surface(1, 17, 13)
    z[4, 4] = np.nan
    starts = [(k, r, c) for k, (r, c) in enumerate((r, c) for r in range(0, 17, 2) for c in range(13) if not np.isnan(z[r, c]))]
    begin = spark.createDataFrame([(k, 0, r, c) for k, r, c in starts], "walk int, grid_id int, row int, col int")
    found = {}
    for x in W.walks(W.receivers(frame(spark, z)), begin, most).collect():
        found.setdefault(x.walk, {})[x.step] = (x.row, x.col)
    assert {k: [p[i] for i in range(len(p))] for k, p in found.items()} == {k: serial_walk(z, r, c, most or 10**9) for k, r, c in starts}


def test_ends_and_roads(spark):
    z = surface(2, 20, 20)
    pointers = W.receivers(frame(spark, z))
    got = {(r.row, r.col): (r.end_row, r.end_col) for r in W.ends(pointers).collect()}
    want = {(r, c): serial_walk(z, r, c) for r in range(20) for c in range(20)}
    assert got == {k: p[-1] for k, p in want.items() if len(p) > 1}
    begin = spark.createDataFrame([(1, 0, 3, 3), (2, 0, *next(k for k, p in want.items() if len(p) == 1))], "walk int, grid_id int, row int, col int")
    lines = W.roads(W.walks(pointers, begin), F.col("col") + 0.5, F.col("row") + 0.5).collect()
    assert [(r.walk, [(p.lon, p.lat) for p in r.coords]) for r in lines] == [(1, [(c + 0.5, r + 0.5) for r, c in want[3, 3]])] * (len(want[3, 3]) > 1)


def test_rounds_are_logarithmic(spark, monkeypatch):
    n = 300
    z = np.full((3, n), 1000.0)
    z[1] = np.arange(n, 0, -1)
    tables = []
    monkeypatch.setattr(W, "stored", lambda df, real=W.stored: tables.append(1) or real(df))
    begin = spark.createDataFrame([(0, 0, 1, 0)], "walk int, grid_id int, row int, col int")
    assert W.walks(W.receivers(frame(spark, z)), begin).count() == n
    assert len(tables) <= 2 + 2 * 10
    tables.clear()
    assert W.ends(W.receivers(frame(spark, z))).filter("row = 1 AND col = 0").first().end_col == n - 1
    assert len(tables) <= 1 + 10


def expected(values, fractions):
    v = np.sort(np.array(values))
    out = []
    for f in fractions:
        at = f * (len(v) - 1)
        k = int(np.floor(at))
        out.append(v[k] if at == k else v[k] * (1 - (at - k)) + v[k + 1] * (at - k))
    return out


@pytest.mark.parametrize(("bins", "few"), [(Q.BINS, Q.FEW), (9, 4)])
def test_quantiles_against_sorting(spark, monkeypatch, bins, few):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "FEW", few)
    rng = random.Random(bins)
    groups = {"ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(200)], "normal": [rng.gauss(0, 1) for _ in range(301)], "wide": [rng.choice([-1, 1]) * 10.0 ** (rng.randint(-300, 308) if bins > 9 else rng.randint(-1, 2)) for _ in range(150)], "one": [7.0], None: [1.0, 4.0, 9.0], "extremes": [-1.7e308, 1.7e308, 0.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("normal", None), ("normal", float("nan"))]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "unit string, v double").repartition(4)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.unit: r.quantiles for r in Q.quantiles(table, ["unit"], "v", fractions).collect()}
    assert found == {k: expected(vs, fractions) for k, vs in groups.items()}
    everything = [v for vs in groups.values() for v in vs]
    assert Q.quantiles(table, [], "v", fractions).first().quantiles == expected(everything, fractions)
    assert Q.quantiles(table.limit(0), [], "v", [0.5]).count() == 0
