"""Failure probability over random soil draws, stability classes, scenarios and the changes between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talweg.functions import mechanics as M
from talweg.operators.quantiles import with_quantiles


@dataclass(frozen=True)
class Soil:
    """Ranges of dimensionless cohesion, friction angle (degrees) and recharge over transmissivity."""

    cohesion: tuple[float, float] = (0.0, 0.25)
    friction_deg: tuple[float, float] = (30.0, 45.0)
    rt: tuple[float, float] = (0.0001, 0.01)
    depth_k: float = 0.0


def draws(soil: Soil, n: int, seed: int = 0) -> np.ndarray:
    """(n, 3) uniform draws: first all cohesions, then all friction angles, then all recharge ratios."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.uniform(low, high, n) for low, high in (soil.cohesion, soil.friction_deg, soil.rt)], axis=1)


def probability_builtin(table: list[tuple[float, float, float]], slope: Column, sca: Column, recharge: Column, k_h: Column, depth_k: float = 0.0) -> Column:
    """The share of draws that fail, as one expression; for short tables."""
    rows = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(float(p)).alias("p"), F.lit(float(r)).alias("r")) for c, p, r in table])
    failed = F.aggregate(rows, F.lit(0), lambda n, d: n + F.when(M.fails(M.factor_of_safety(slope, sca, d.c, d.p, d.r * recharge, k_h, depth_k)), 1).otherwise(0))
    return F.when(slope.isNotNull() & sca.isNotNull(), failed / F.lit(float(len(table))))


def failed_draws(slope: np.ndarray, sca: np.ndarray, recharge: np.ndarray, k_h: np.ndarray, table: np.ndarray, depth_k: float) -> np.ndarray:
    """Draws that fail for each cell; the same mechanics as the expressions, on arrays."""
    angle = np.arctan(slope)
    sine, cosine = np.sin(angle), np.cos(angle)
    driving = sine + k_h * cosine
    factor = np.exp(depth_k * (np.minimum(slope, M.TAN_60) - M.TAN_30)) if depth_k else np.ones_like(slope)
    count = np.zeros(len(slope), np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        for cohesion, friction, rt in table:  # a draw at a time keeps what is held to a few columns
            wet = np.where(sine > M.FLAT, np.clip(rt * recharge * sca / sine, 0, 1), np.nan)
            resisting = cohesion * factor + (cosine - k_h * sine - wet * M.DENSITY_RATIO * cosine) * np.tan(np.radians(friction))
            count += (driving > M.FLAT) & (resisting / driving < 1)
    return count


def failure_probability(cells: DataFrame, table: np.ndarray, depth_k: float = 0.0, name: str = "probability") -> DataFrame:
    """``cells`` (slope, sca and, if there, recharge and k_h) with the share of draws that fail; NULL without slope or sca.

    Every cell meets every draw inside its own task: no rows are multiplied and nothing is shuffled.
    """
    given = {c: F.col(c) if c in cells.columns else F.lit(default) for c, default in (("slope", None), ("sca", None), ("recharge", 1.0), ("k_h", 0.0))}
    work = cells.select("*", *[v.cast("double").alias(f"_{c}") for c, v in given.items()])
    shared = cells.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table, float))  # a few thousand triples
    keep, names = cells.columns, list(given)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(f"_{c}")).to_numpy(zero_copy_only=False).astype(float) for c in names}
            count = failed_draws(*columns.values(), shared.value, depth_k)
            valid = ~(np.isnan(columns["slope"]) | np.isnan(columns["sca"]))
            share = pa.array(count / len(shared.value), mask=~valid)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, share], [*keep, name])

    return work.mapInArrow(run, StructType([*cells.schema.fields, StructField(name, DoubleType())]))


def classes(cells: DataFrame, soil: Soil, table: np.ndarray) -> DataFrame:
    """``cells`` with probability and stability class."""
    known = failure_probability(cells, table, soil.depth_k)
    worst = M.factor_of_safety("slope", "sca", soil.cohesion[0], soil.friction_deg[0], soil.rt[1], 0.0, soil.depth_k)
    best = M.factor_of_safety("slope", "sca", soil.cohesion[1], soil.friction_deg[1], 0.0, 0.0, soil.depth_k)
    return known.withColumn("class", M.stability_class(F.col("probability"), worst, best))


def regional_probability(samples: DataFrame, parameters: DataFrame, fallback: tuple[float, float, float], slope: str = "slope", sca: str = "sca", region: str = "region") -> DataFrame:
    """``samples`` with the factor of safety under their region's (cohesion, friction_deg, rt), or the fall-back's."""
    p = parameters.select(F.col("region").alias("p_region"), "cohesion", "friction_deg", "rt")
    met = samples.join(p, F.col(region) == F.col("p_region"), "left")
    values = [F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("cohesion", "friction_deg", "rt"), fallback, strict=True)]
    fs = M.factor_of_safety(slope, sca, *values)
    return met.select(*samples.columns, F.when(F.col(region).isNotNull(), fs).alias("fs"))


def regional_failure_probability(
    samples: DataFrame, tables: dict[int, np.ndarray], fallback: np.ndarray, region: str = "region", depth_k: float = 0.0, name: str = "probability"
) -> DataFrame:
    """``samples`` (slope, sca and, if there, recharge and k_h) with the share of their region's draws that fail.

    ``tables`` holds a few draws for each region that has its own parameters; other regions take those of ``fallback``.
    NULL without slope, sca or region. A sample meets its region's draws inside its own task, as in ``failure_probability``.
    """
    given = {c: F.col(c) if c in samples.columns else F.lit(default) for c, default in (("slope", None), ("sca", None), ("recharge", 1.0), ("k_h", 0.0))}
    work = samples.select("*", *[v.cast("double").alias(f"_{c}") for c, v in given.items()], F.col(region).cast("long").alias("_region"))
    held = {int(r): np.ascontiguousarray(t, float) for r, t in tables.items()}
    shared = samples.sparkSession.sparkContext.broadcast((held, np.ascontiguousarray(fallback, float)))
    keep, names = samples.columns, list(given)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = shared.value
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(f"_{c}")).to_numpy(zero_copy_only=False).astype(float) for c in names]
            codes = batch.column(batch.schema.get_field_index("_region"))
            known = codes.is_valid().to_numpy(zero_copy_only=False)
            codes = codes.fill_null(0).to_numpy(zero_copy_only=False)
            share, left = np.zeros(len(codes)), known.copy()
            for r, table in own.items():
                here = known & (codes == r)
                share[here] = failed_draws(*[v[here] for v in values], table, depth_k) / len(table)
                left &= ~here
            share[left] = failed_draws(*[v[left] for v in values], others, depth_k) / len(others)
            missing = ~known | np.isnan(values[0]) | np.isnan(values[1])
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(share, mask=missing)], [*keep, name])

    return work.mapInArrow(run, StructType([*samples.schema.fields, StructField(name, DoubleType())]))


def reference_recharge(precipitation: DataFrame, value: str = "mm") -> DataFrame:
    """One row: the median of positive values, else the mean, else 1."""
    mean = precipitation.agg(F.avg(value).alias("a"))
    found = with_quantiles(mean, precipitation.filter(F.col(value) > 0), [], value, [0.5]).withColumn("m", F.get("quantiles", F.lit(0)))
    return found.select(F.coalesce(F.nullif("m", F.lit(0.0)), F.nullif("a", F.lit(0.0)), F.lit(1.0)).alias("reference"))


def wettest_month(precipitation: DataFrame, keys: list[str], value: str = "mm") -> DataFrame:
    """The largest monthly value per key; negative ones are missing."""
    return precipitation.groupBy(*keys).agg(F.max(F.when(F.col(value) >= 0, F.col(value))).alias(value))


def change(scored: DataFrame, keys: list[str], baseline: str = "current", value: str = "probability") -> DataFrame:
    """(keys, scenario, before, after, change) of every scenario but the baseline, where both are known."""
    base = scored.filter(F.col("scenario") == baseline).select(*keys, F.col(value).alias("before"))
    other = scored.filter(F.col("scenario") != baseline).select(*keys, "scenario", F.col(value).alias("after"))
    return other.join(base, keys).filter("before IS NOT NULL AND after IS NOT NULL").withColumn("change", F.col("after") - F.col("before"))


def change_statistics(changes: DataFrame) -> DataFrame:
    """Per scenario: cells compared, how many rose or fell by over 0.01, moved by over 0.10, and the mean change."""
    d = F.col("change")
    return changes.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(d > 0.01).alias("n_up"),
        F.count_if(d < -0.01).alias("n_down"),
        F.count_if(F.abs(d) > 0.10).alias("n_large"),
        F.avg(d).alias("mean_change"),
    )


def area_above(rows: DataFrame, keys: list[str], value: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Per key the percentage of known values over the threshold, 0 without any."""
    known = F.when(F.col(value).isNotNull(), F.when(F.col(value) > threshold, 100.0).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("percent_above"))


def raster_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count(v).alias("count"))
