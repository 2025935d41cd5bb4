"""Great-circle distance and the cube cells used to block spatial joins.

A point on the unit sphere is put in a cube of side ``s``. Two points whose straight-line (chord) distance is
at most ``s`` lie in the same or in touching cubes, with no special case for the poles or the date line.

Arguments that name values are SQL text (a column name or a literal): one parsed expression per formula is much
cheaper to build from Python than dozens of nested function calls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import EARTH_RADIUS_KM

# Cube sides halve per level: level 0 holds the whole sphere, level 22 is about 6 m
TOP_SIDE = 4.0
FINEST = 22
# Finest level whose cubes fit a number together with four more bits
FINEST_NUMBERED = 20


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance in kilometres."""
    return F.expr(haversine_sql(lat1, lon1, lat2, lon2))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""{2 * EARTH_RADIUS_KM}D * asin(sqrt(least(1D, pow(sin(radians({lat2} - {lat1}) / 2), 2)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"""


def on_sphere(df: DataFrame, lat: str = "latitude", lon: str = "longitude", prefix: str = "") -> DataFrame:
    """Adds the point's place on the unit sphere as ``x, y, z``."""
    return df.withColumns({
        f"{prefix}x": F.expr(f"cos(radians({lat})) * cos(radians({lon}))"),
        f"{prefix}y": F.expr(f"cos(radians({lat})) * sin(radians({lon}))"), f"{prefix}z": F.expr(f"sin(radians({lat}))")})


def cube_side(level: int) -> str:
    return f"{TOP_SIDE / 2 ** level!r}D"


def box_gap_sql(cell: str, point: str, level: int) -> str:
    """Straight-line distance from a point ``<point>x, ...`` to a cube of the level; 0 inside."""
    side = cube_side(level)
    gaps = [f"pow(greatest(0D, {cell}.{i} * {side} - 1.5D - {point}{i}, {point}{i} - ({cell}.{i} + 1) * {side} + 1.5D), 2)"
            for i in "xyz"]
    return f"sqrt({' + '.join(gaps)})"


def box_span_sql(a: str, level_a: int, b: str, level_b: int) -> str:
    """Largest straight-line distance between points of two cubes on the unit sphere."""
    sa, sb = cube_side(level_a), cube_side(level_b)
    spans = [f"pow(greatest(({a}.{i} + 1) * {sa} - {b}.{i} * {sb}, ({b}.{i} + 1) * {sb} - {a}.{i} * {sa}), 2)" for i in "xyz"]
    return f"least(2D, sqrt({' + '.join(spans)}))"


def span_sql(a: str, b: str) -> str:
    """Straight-line distance between two places on the unit sphere."""
    return "sqrt(" + " + ".join(f"pow({a}{i} - {b}{i}, 2)" for i in "xyz") + ")"


def chord(km: float) -> float:
    """Straight-line distance on the unit sphere that spans ``km`` along the surface."""
    return 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def chord_sql(km: str) -> str:
    return f"(2D * sin(least({km} / {2 * EARTH_RADIUS_KM}D, {math.pi / 2}D)))"


def valid_point() -> Column:
    """Both coordinates present and inside the globe's ranges."""
    return F.expr("coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)")


def cell(lat: str, lon: str, level: str) -> Column:
    """Cube of the level that holds the point. The shift keeps coordinates positive, so level 0 is a single cube."""
    side = f"({TOP_SIDE}D / pow(2D, {level}))"
    x, y, z = f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", \
        f"sin(radians({lat}))"
    return F.expr(f"""named_struct('x', floor(({x} + 1.5D) / {side}), 'y', floor(({y} + 1.5D) / {side}),
        'z', floor(({z} + 1.5D) / {side}))""")


def touching_cells(cell_column: str) -> Column:
    """The cube and its 26 neighbours."""
    c = cell_column
    return F.expr(f"""flatten(flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> transform(
        array(-1, 0, 1), k -> named_struct('x', {c}.x + i, 'y', {c}.y + j, 'z', {c}.z + k))))))""")


def cell_number(cell_column: str) -> Column:
    """The cube, or one that touches it, as one number whose last four bits are free."""
    c = cell_column
    return F.expr(f"shiftleft({c}.x + 1, 44) | shiftleft({c}.y + 1, 24) | shiftleft({c}.z + 1, 4)")


def level_for(km: float) -> int:
    """Finest level whose cube side still covers the distance."""
    return max(0, min(FINEST, int(math.floor(math.log2(TOP_SIDE / max(chord(km), 1e-12))))))


def level_sql(km: str) -> Column:
    """The same for a column of distances."""
    return F.expr(f"""least({FINEST}, greatest(0, CAST(floor(log2({TOP_SIDE}D / greatest({chord_sql(km)}, 1e-12D)))
        AS INT)))""")


def bounding_box(lat0: float, lon0: float, radius_km: float) -> Column:
    """Cheap latitude/longitude pre-filter that no point inside the radius fails; pushed down to the scan."""
    angle = math.degrees(radius_km / EARTH_RADIUS_KM)
    box = F.col("latitude").between(lat0 - angle, lat0 + angle)
    if abs(lat0) + angle < 90:
        ratio = math.sin(math.radians(angle)) / math.cos(math.radians(lat0))
        width = math.degrees(math.asin(min(1.0, ratio)))
        if lon0 - width >= -180 and lon0 + width <= 180:
            box = box & F.col("longitude").between(lon0 - width, lon0 + width)
    return box


def in_disc(lat0: float, lon0: float, radius_km: float) -> Column:
    """No farther than the radius from a point, with the box first."""
    km = haversine_km(f"{float(lat0)}D", f"{float(lon0)}D", "latitude", "longitude")
    return bounding_box(lat0, lon0, radius_km) & (km <= radius_km)
