"""Comparisons of two runs, regional totals and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators.quantiles import with_quantiles
from talweg.session import stored


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], catchment: str, probability: str) -> DataFrame:
    """One row: how a run differs from one over a larger area.

    The median ratio of catchments, the percentage that lost over half, and the mean, the greatest and the share
    over 0.05 of the changes in probability.
    """
    met = a.select(*keys, F.col(catchment).alias("ca"), F.col(probability).alias("pa")).join(b.select(*keys, F.col(catchment).alias("cb"), F.col(probability).alias("pb")), keys)
    met = stored(met.select(F.try_divide(F.col("ca"), F.col("cb")).alias("ratio"), F.abs(F.col("pa") - F.col("pb")).alias("moved")))
    ratio, moved = F.col("ratio"), F.col("moved")
    found = met.agg(
        F.count(F.lit(1)).alias("n_cells"),
        (100 * F.avg(F.when(ratio < 0.5, 1.0).otherwise(0.0))).alias("percent_under_half"),
        F.avg(moved).alias("mean_change"),
        F.max(moved).alias("max_change"),
        (100 * F.avg(F.when(moved > 0.05, 1.0).otherwise(0.0))).alias("percent_over_005"),
    )
    return with_quantiles(found, met, [], "ratio", [0.5]).withColumn("median_ratio", F.get("quantiles", F.lit(0))).drop("quantiles")


def region_totals(units: DataFrame, sums: list[str], maxima: list[str], keys: list[str] | None = None) -> DataFrame:
    """Totals over units, per key if any; unknown values count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return units.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_units"), *[F.sum(zero(c)).alias(c) for c in sums], *[F.max(zero(c)).alias(c) for c in maxima])


def top(rows: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The ``n`` rows of the greatest value; equal ones by ``tie``, unknown ones last."""
    return rows.orderBy(F.desc_nulls_last(value), tie).limit(n)


def search_units(units: DataFrame, text: str, by: str = "name") -> DataFrame:
    """Units whose name contains ``text``, in any case."""
    return units.filter(F.lower(F.col(by)).contains(text.lower()))


def presence_by_class(points: DataFrame, kind: str, test: Column) -> DataFrame:
    """Presences and points per class, the most presences first."""
    return points.groupBy(kind).agg(F.count_if(test).alias("n_presence"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n_presence"), kind)
