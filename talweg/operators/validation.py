"""Validation of a score against held-out presences: equal-area bins, frequency ratios and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.quantiles import with_quantiles


def quantile_edges(rows: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """One row ``edges``: the inner quantiles of the positive values, without repeats."""
    positive = rows.filter(F.col(value) > 0)
    found = with_quantiles(positive.agg(F.count(F.lit(1)).alias("n")), positive, [], value, [k / bins for k in range(1, bins)])
    return found.select(F.array_distinct("quantiles").alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """1 and up: one more than the edges at or under the value."""
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: e <= value)) + 1)


def frequency_ratios(rows: DataFrame, presence: Column, kind: str) -> DataFrame:
    """(kind, n_cells, n_presence, area_percent, presence_percent, ratio) of every class ``kind`` of ``rows``."""
    counted = rows.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.when(presence, 1).otherwise(0)).alias("n_presence"))
    everything = Window.partitionBy()  # a row for each class
    area = 100.0 * F.col("n_cells") / F.sum("n_cells").over(everything)
    share = 100.0 * F.col("n_presence") / F.nullif(F.sum("n_presence").over(everything), F.lit(0))
    out = counted.select(kind, "n_cells", "n_presence", area.alias("area_percent"), share.alias("presence_percent"))
    return out.withColumn("ratio", F.try_divide("presence_percent", "area_percent"))


def verdict(ratios: DataFrame, aucs: DataFrame, kind: str) -> DataFrame:
    """One row: whether ratios rise with the class, the top two classes' shares, their efficiency and a verdict."""
    order = Window.partitionBy().orderBy(kind)
    stepped = ratios.withColumn("falls", F.col("ratio") < F.lag("ratio").over(order) - 1e-9)
    top = Window.partitionBy().orderBy(F.desc(kind))
    placed = stepped.withColumn("place", F.row_number().over(top))
    one = placed.agg(
        (~F.coalesce(F.bool_or("falls"), F.lit(False))).alias("monotone"),
        F.sum(F.when(F.col("place") <= 2, F.col("presence_percent"))).alias("top_presence_percent"),
        F.sum(F.when(F.col("place") <= 2, F.col("area_percent"))).alias("top_area_percent"),
    ).withColumn("efficiency", F.try_divide("top_presence_percent", "top_area_percent"))
    joined = one.join(F.broadcast(aucs.select("auc")))
    good = (F.col("auc") >= 0.75) & F.col("monotone") & (F.col("efficiency") >= 1.5)
    fair = (F.col("auc") >= 0.65) & (F.col("efficiency") >= 1.5)
    return joined.withColumn("verdict", F.when(good, "good").when(fair, "fair").otherwise("poor"))


def share_inside(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """One row: how many points there are and the share inside a box, its edges included."""
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return points.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("share"))


def extent(points: DataFrame, padding: float = 0.0) -> DataFrame:
    return points.agg((F.min("lon") - padding).alias("west"), (F.min("lat") - padding).alias("south"), (F.max("lon") + padding).alias("east"), (F.max("lat") + padding).alias("north"))
