"""Connected components and single-link clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.scores import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON
from talweg.operators.lines import hulls
from talweg.session import cut, stored

LINK_M = 2500.0
EDGES_A_TASK = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Large-star and small-star steps in turn. Each is an aggregation for the smallest neighbour and an equi-join,
    so a node of very many neighbours is combined map-side and split by skew handling, never gathered. Few edges are
    kept in few partitions, ``EDGES_A_TASK`` in each: the steps are many, and each would write as many files.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"))

    def signature(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def settled(e: DataFrame) -> DataFrame:
        return cut(e.coalesce(parts).distinct().coalesce(parts))

    seen = signature(now)
    parts = 1 + seen[0] // EDGES_A_TASK
    now = now.coalesce(parts)
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = settled(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v"))
        if (found := signature(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _metres(points: DataFrame, lat0: float) -> DataFrame:
    from math import cos, radians

    return points.withColumns({"x": F.col("lon") * METRES_PER_DEGREE_LON * cos(radians(lat0)), "y": F.col("lat") * METRES_PER_DEGREE_LAT})


def pairs_within(points: DataFrame, limit_m: float, lat0: float, key: str = "asset_id") -> DataFrame:
    """(a, b, dist): pairs of points at most ``limit_m`` apart on a plane about latitude ``lat0``; a < b.

    Squares of the limit's size are joined with the nine around them on their numbers.
    """
    placed = _metres(points, lat0).select(F.col(key).alias("id"), "x", "y")
    keyed = placed.withColumns({"bx": F.floor(F.col("x") / limit_m), "by": F.floor(F.col("y") / limit_m)})
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    spread = keyed.withColumn("o", around).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    to = keyed.select(F.col("id").alias("b"), F.col("x").alias("x"), F.col("y").alias("y"), "bx", "by")
    # by the size of the table that the points come from they would be sent to every task
    met = spread.join(to.hint("merge"), ["bx", "by"]).filter("a < b")
    dist = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    return met.select("a", "b", dist.alias("dist")).filter(F.col("dist") <= limit_m)


#: Into how many parts squares' sides are cut, step by step, before points are compared.
PARTS = (8, 64)
SLACK = 1e-9


def link_edges(points: DataFrame, limit_m: float, lat0: float, key: str = "asset_id") -> DataFrame:
    """(a, b): edges that connect what all pairs within ``limit_m`` connect, a few for each point.

    Points in one square of side limit / sqrt(2) are all within the limit, so they are chained. Two squares need one
    edge, if any two of their points are near enough. Their occupied parts, 64 a square at most, are compared first: two
    parts that lie within the limit as a whole are an edge, and parts that lie beyond it are out. Only where that
    leaves two squares undecided are their undecided parts cut into 64 again, and the points of what is then
    undecided compared, so dense squares do not meet point by point.
    """
    side = limit_m / 2**0.5
    at = lambda c, n, name: F.floor(F.col(c) / (side / n)).alias(name)
    keyed = stored(_metres(points, lat0).select(F.col(key).alias("id"), "x", "y", at("x", 1, "bx"), at("y", 1, "by")))
    before = F.lag("id").over(Window.partitionBy("bx", "by").orderBy("id"))
    chained = keyed.select(before.alias("a"), F.col("id").alias("b")).filter("a IS NOT NULL")

    # squares that can touch, each two once
    squares = keyed.select("bx", "by").distinct()
    around = F.explode(F.expr("filter(flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> struct(i AS i, j AS j)))), o -> o.i > 0 OR (o.i = 0 AND o.j > 0))"))
    asked = squares.withColumn("o", around).select("bx", "by", (F.col("bx") + F.col("o.i")).alias("cx"), (F.col("by") + F.col("o.j")).alias("cy"))
    pair = ["bx", "by", "cx", "cy"]
    open_ = asked.join(squares.select(F.col("bx").alias("cx"), F.col("by").alias("cy")), ["cx", "cy"]).select(*pair)
    edges, known = chained, []
    for n in PARTS:
        boxes = keyed.select("id", "bx", "by", at("x", n, "fx"), at("y", n, "fy"), *known).groupBy("bx", "by", "fx", "fy", *known).agg(F.min("id").alias("one"))
        other = boxes.select(F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("fx").alias("gx"), F.col("fy").alias("gy"), F.col("one").alias("two"), *[F.col(c).alias(f"to_{c}") for c in known])
        met = open_.join(boxes, ["bx", "by", *known]).join(other, ["cx", "cy", *[f"to_{c}" for c in known]])
        apart = lambda more: F.hypot(*[F.greatest(F.abs(F.col(a) - F.col(b)) + more, F.lit(0)) * (side / n) for a, b in (("fx", "gx"), ("fy", "gy"))])  # noqa: E731, B023
        met = stored(met.withColumn("most", apart(1)).filter(apart(-1) <= limit_m * (1 + SLACK)))
        sure = met.filter(F.col("most") <= limit_m * (1 - SLACK)).groupBy(*pair).agg(F.min(F.struct("one", "two")).alias("e"))
        sure = stored(sure)
        edges = edges.unionByName(sure.select(F.least("e.one", "e.two").alias("a"), F.greatest("e.one", "e.two").alias("b")))
        names = [f"x{n}", f"y{n}"]
        left = met.join(sure.select(*pair), pair, "left_anti")
        open_ = left.select(*pair, F.col("fx").alias(names[0]), F.col("fy").alias(names[1]), F.col("gx").alias(f"to_{names[0]}"), F.col("gy").alias(f"to_{names[1]}"))
        keyed = keyed.withColumns({names[0]: F.floor(F.col("x") / (side / n)), names[1]: F.floor(F.col("y") / (side / n))})
        known = names
    to = keyed.select(F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("id").alias("to_id"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), *[F.col(c).alias(f"to_{c}") for c in known])
    near = open_.join(keyed.select("bx", "by", "id", "x", "y", *known), ["bx", "by", *known]).join(to, ["cx", "cy", *[f"to_{c}" for c in known]])
    near = near.filter(F.hypot(F.col("x") - F.col("to_x"), F.col("y") - F.col("to_y")) <= limit_m)
    last = near.groupBy(*pair).agg(F.min(F.struct("id", "to_id")).alias("e"))
    return edges.unionByName(last.select(F.least("e.id", "e.to_id").alias("a"), F.greatest("e.id", "e.to_id").alias("b"))).distinct()


def clusters(points: DataFrame, lat0: float, limit_m: float = LINK_M, key: str = "asset_id") -> DataFrame:
    """``points`` with cluster_id, the smallest key that single links of ``limit_m`` reach."""
    nodes = connected_components(link_edges(points, limit_m, lat0, key))
    met = points.join(nodes, points[key] == nodes["node"], "left")
    return met.select(*points.columns, F.coalesce("root", F.col(key)).alias("cluster_id"))


def largest_clusters(clustered: DataFrame, n: int = 5, least: int = 2, name: str = "name", key: str = "asset_id") -> DataFrame:
    """The ``n`` largest clusters of ``least`` members or more: size, first named member, mean place and hull."""
    summed = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.min_by(name, F.when(F.col(name).isNotNull(), F.col(key))).alias("name"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")
    )
    top = summed.filter(F.col("size") >= least).orderBy(F.desc("size"), "cluster_id").limit(n)
    rings = hulls(clustered.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi"), "cluster_id")  # n rows
    return top.join(rings, "cluster_id")
