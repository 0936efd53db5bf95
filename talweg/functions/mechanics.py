"""Infinite-slope mechanics as column expressions.

Nodata is NULL everywhere. Slope is rise over run; angles are in degrees where the name says so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
DENSITY_RATIO = 0.5  # of water to soil
FLAT = 1e-6  # sines and denominators up to this count as zero
TAN_30, TAN_60 = math.tan(math.radians(30)), math.tan(math.radians(60))

Value = Column | float


def _c(x: Value | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def wetness(slope: Value | str, sca: Value | str, rt: Value | str) -> Column:
    """Relative saturation ``rt * sca / sin(atan(slope))`` held to 0..1; NULL on flat ground."""
    sine = F.sin(F.atan(_c(slope)))
    ratio = _c(rt) * _c(sca) / sine
    return F.when(sine > FLAT, F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))))


def depth_factor(slope: Value | str, depth_k: Value | str) -> Column:
    """Cohesion's factor for soil that thins with the slope; 1 where ``depth_k`` is 0."""
    k = _c(depth_k)
    return F.when(k == 0, F.lit(1.0)).otherwise(F.exp(k * (F.least(_c(slope), F.lit(TAN_60)) - F.lit(TAN_30))))


def factor_of_safety(
    slope: Value | str,
    sca: Value | str,
    cohesion: Value | str,
    friction_deg: Value | str,
    rt: Value | str,
    k_h: Value | str = 0.0,
    depth_k: Value | str = 0.0,
    density_ratio: float = DENSITY_RATIO,
) -> Column:
    """Resisting over driving stress; infinite where nothing drives (flat ground without shaking)."""
    angle = F.atan(_c(slope))
    sine, cosine, k = F.sin(angle), F.cos(angle), _c(k_h)
    driving = sine + k * cosine
    normal = cosine - k * sine - wetness(slope, sca, rt) * density_ratio * cosine
    resisting = _c(cohesion) * depth_factor(slope, depth_k) + normal * F.tan(F.radians(_c(friction_deg)))
    return F.when(driving > FLAT, resisting / driving).when(driving.isNotNull(), F.lit(float("inf")))


def critical_acceleration(
    slope: Value | str, sca: Value | str, cohesion: Value | str, friction_deg: Value | str, rt: Value | str, depth_k: Value | str = 0.0, density_ratio: float = DENSITY_RATIO
) -> Column:
    """The horizontal acceleration, in g, at which the factor of safety is 1; negative where it is under 1 already."""
    angle = F.atan(_c(slope))
    sine, cosine, friction = F.sin(angle), F.cos(angle), F.tan(F.radians(_c(friction_deg)))
    held = _c(cohesion) * depth_factor(slope, depth_k) + cosine * (1 - wetness(slope, sca, rt) * density_ratio) * friction
    return (held - sine) / (cosine + sine * friction)


def fails(fs: Column) -> Column:
    """Whether a draw fails; an undefined factor of safety does not."""
    return F.coalesce(fs < 1, F.lit(False))


def stability_class(probability: Column, worst_fs: Column, best_fs: Column) -> Column:
    """Classes 1 (stable) to 6 (unstable even at its best); NULL where the probability is.

    6: fails at its best; 1: holds at its worst by over 1.5; 2: by over 1.25; then by probability 3, 4, 5.
    """
    finite = worst_fs.isNotNull() & (worst_fs < float("inf"))
    return (
        F.when(probability.isNull(), None)
        .when(fails(best_fs), 6)
        .when(finite & (worst_fs > 1.5), 1)
        .when(worst_fs > 1.25, 2)
        .when(probability <= 0, 3)
        .when(probability < 0.5, 4)
        .otherwise(5)
    )
