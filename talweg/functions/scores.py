"""Scores of exposed assets, names, distances and class breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands of a score with their upper edges, and what counts as exposed.
BANDS = {"very low": 0.02, "low": 0.08, "moderate": 0.20, "high": 0.40, "very high": 1.01}
EXPOSED = 0.08
SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
EARTH_M = 6_371_000.0
METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 111_320.0, 110_540.0
FOOTPRINT_M = {"city": 1000.0, "town": 500.0, "village": 250.0, "hamlet": 100.0}
DEFAULT_FOOTPRINT_M = 250.0
DEFAULT_POPULATION = {"city": 100000, "town": 10000, "village": 1000, "hamlet": 100}  # for ranking only
STEEP_CUT_DEG, CHANNEL_SCA = 35.0, 5000.0


def band(score: Column) -> Column:
    """The first band whose upper edge is over the score; the last one beyond all edges."""
    out = None
    for name, edge in list(BANDS.items())[:-1]:
        out = F.when(score < edge, name) if out is None else out.when(score < edge, name)
    return F.when(score.isNotNull(), out.otherwise(list(BANDS)[-1]))


def octant(azimuth_deg: Column) -> Column:
    """0 for north, clockwise to 7; halves go to the even neighbour."""
    return F.pmod(F.bround(azimuth_deg / 45.0).cast("int"), F.lit(8))


def sector(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SECTORS]), number + 1)


def footprint_radius(place: Column) -> Column:
    radii = F.create_map(*[F.lit(x) for pair in FOOTPRINT_M.items() for x in pair])
    return F.coalesce(radii[place], F.lit(DEFAULT_FOOTPRINT_M))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def slug(country: Column, name: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore."""
    joined = F.concat_ws(" ", country, name)
    return F.regexp_replace(F.regexp_replace(F.lower(joined), r"(?U)[^\p{Alnum}]+", "_"), "^_|_$", "")


def is_mountainous(fraction: Column, area_km2: Column, peak_m: Column) -> Column:
    """A tenth of the unit, or 1,000 km2 of it under a peak of 1,400 m or more."""
    return (fraction >= 0.10) | ((area_km2 >= 1000) & (peak_m >= 1400))


def reclassify(value: Column, breaks: list[tuple[float, int]], inclusive: bool = True) -> Column:
    """The class of the first bound that the value does not pass; NULL over the last. Bounds rise."""
    out = None
    for bound, kind in breaks:
        hit = value <= bound if inclusive else value < bound
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def remap(value: Column, mapping: dict, default) -> Column:
    """``mapping`` of a category, else ``default``; also for NULL."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(table[value], F.lit(default))


# The colour ramp of a probability (share, red, green, blue).
RAMP = [(0.0, 247, 251, 255), (0.2, 198, 219, 239), (0.4, 107, 174, 214), (0.6, 253, 174, 97), (0.8, 240, 89, 40), (1.0, 153, 0, 13)]


def ramp(share: Column, channel: int) -> Column:
    """One channel (0 red, 1 green, 2 blue) of the colour of ``share``, held to 0..1, linear between the stops."""
    x = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    out = None
    for low, high in zip(RAMP, RAMP[1:], strict=False):
        value = low[channel + 1] + (x - low[0]) / (high[0] - low[0]) * (high[channel + 1] - low[channel + 1])
        out = F.when(x <= high[0], value) if out is None else out.when(x <= high[0], value)
    return F.when(share.isNotNull(), F.round(out).cast("int"))
