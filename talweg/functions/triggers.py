"""Rainfall, earthquake and climate terms of a scenario."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Euler's constant, the Gumbel scale, defaults of the scenarios.
EULER = 0.5772156649015329
GUMBEL_SCALE = math.sqrt(6) / math.pi
RAINFALL_CV = 0.30
PGA_FRACTION = 0.5
PERIODS = ["2021-2040", "2041-2060", "2061-2080", "2081-2100"]
PATHWAYS = {"ssp126": "SSP1-2.6", "ssp245": "SSP2-4.5", "ssp370": "SSP3-7.0", "ssp585": "SSP5-8.5"}
DEFAULT_PERIOD = "2041-2060"
CURRENT_NAMES = ["current", "baseline", "present", "now", "historical"]


def gumbel_factor(years: Column) -> Column:
    """The frequency factor of a return period over one year; others are an error."""
    factor = F.lit(GUMBEL_SCALE) * (-F.log(-F.log(1 - 1 / years)) - EULER)
    return F.when(years > 1, factor).otherwise(F.raise_error(F.lit("a return period must be over 1 year")).cast("double"))


def recharge_multiplier(years: Column, cv: float = RAINFALL_CV, reference_years: float = 2.0) -> Column:
    """Rainfall of a return period over that of the reference period."""
    reference = 1 + cv * GUMBEL_SCALE * (-math.log(-math.log(1 - 1 / reference_years)) - EULER)
    return (1 + cv * gumbel_factor(years)) / F.lit(reference)


def return_period(z: Column) -> Column:
    """Years between exceedances of a value ``z`` standard deviations over the mean."""
    below = F.exp(-F.exp(-(z / F.lit(GUMBEL_SCALE) + EULER)))
    return 1 / F.greatest(1 - below, F.lit(1e-9))


def seismic_coefficient(pga: Column, fraction: float = PGA_FRACTION) -> Column:
    return fraction * pga


def recharge_term(kind: Column, years: Column) -> Column:
    return F.when(kind == "rainfall", recharge_multiplier(years)).when(kind == "earthquake", F.lit(1.0)).otherwise(F.raise_error(F.concat(F.lit("unknown trigger "), kind)).cast("double"))


def shaking_term(kind: Column, pga: Column) -> Column:
    return F.when(kind == "earthquake", seismic_coefficient(pga)).when(kind == "rainfall", F.lit(0.0)).otherwise(F.raise_error(F.concat(F.lit("unknown trigger "), kind)).cast("double"))


def describe_trigger(kind: Column, years: Column, pga: Column) -> Column:
    return F.when(kind == "rainfall", F.format_string("rainfall, %d-year return period", years.cast("int"))).otherwise(F.format_string("earthquake, PGA %.2f g", pga))


def scenario_parts(text: Column) -> tuple[Column, Column]:
    """(pathway, period) that a scenario's text names; both NULL for the present."""
    low = F.lower(F.trim(text))
    pathway = F.split_part(low, F.lit(":"), F.lit(1))
    period = F.coalesce(F.nullif(F.split_part(low, F.lit(":"), F.lit(2)), F.lit("")), F.lit(DEFAULT_PERIOD))
    known = pathway.isin(list(PATHWAYS)) & period.isin(PERIODS)
    unknown = F.raise_error(F.concat(F.lit("unknown scenario "), text)).cast("string")
    present = low.isin(CURRENT_NAMES)
    return F.when(present, None).when(known, pathway).otherwise(unknown), F.when(present, None).when(known, period).otherwise(unknown)


def scenario_key(pathway: Column, period: Column) -> Column:
    return F.when(pathway.isNull(), "current").otherwise(F.concat_ws("_", pathway, period))


def short_label(pathway: Column, period: Column) -> Column:
    """Such as ``SSP2-4.5 2041-60``; ``present`` for the present."""
    names = F.create_map(*[F.lit(x) for pair in PATHWAYS.items() for x in pair])
    label = F.concat(names[pathway], F.lit(" "), F.substring(period, 1, 4), F.lit("-"), F.substring(period, 8, 2))
    return F.when(pathway.isNull(), "present").otherwise(label)
