"""Column functions on coordinates. Constants are doubles, never decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landweave.operators.dual_tree import EARTH_M, haversine_m

EARTH_MILES = 3959.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2, EARTH_MILES)


def grid_cell(c: Column, metres: float) -> Column:
    """Integer cell of a coordinate on a grid of so many metres of latitude, rounded half to even."""
    return F.rint(c / F.lit(metres / 111000.0)).cast("long")


def adaptive_cell(lat: Column, lon: Column, miles: float) -> tuple[Column, Column]:
    """South-west corner of a cell of so many miles, the longitude's side widened by the latitude."""
    side = F.lit(miles / 69.0)
    wide = side / F.cos(F.radians(lat))
    return F.round(F.floor(lat / side) * side, 4), F.round(F.floor(lon / wide) * wide, 4)


def in_box(lat: Column, lon: Column, lat0: float, lon0: float, miles: float, buffer: float = 1.2) -> Column:
    """Whether a point is in the box around a circle, enlarged by ``buffer``; a range a scan can prune by."""
    import math

    dlat, dlon = miles * buffer / 69.0, miles * buffer / (69.0 * math.cos(math.radians(lat0)))
    return lat.between(lat0 - dlat, lat0 + dlat) & lon.between(lon0 - dlon, lon0 + dlon)


def acres(square_feet: Column) -> Column:
    return F.round(square_feet / F.lit(43560.0), 2)


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_xy(wkt: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a WKT point, further dimensions dropped; null for anything else."""
    part = [F.nullif(F.regexp_extract(wkt, r"^\s*(?i:POINT)(?:\s+(?i:ZM?|M))?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)*\s*\)\s*$", i), F.lit("")).try_cast("double") for i in (1, 2)]
    return part[0], part[1]


__all__ = ["EARTH_M", "acres", "adaptive_cell", "grid_cell", "haversine_m", "haversine_miles", "in_box", "wkt_point", "wkt_xy"]
