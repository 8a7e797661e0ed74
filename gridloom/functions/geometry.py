"""Column expressions over grid, map and scene coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validity import clip, finite

# The ellipsoid and the polar stereographic projection's standard parallel and central meridian.
SEMI_MAJOR, ECCENTRICITY = 6378137.0, 0.08181919084262157
STANDARD_PARALLEL, CENTRAL_MERIDIAN = math.radians(70.0), math.radians(-45.0)
SECTORS = 8


def half_up(v: Column) -> Column:
    """rounds halves up."""
    return F.floor(v + 0.5)


def cell_index(target: Column, start: Column | float, step: Column | float) -> Column:
    """The nearest cell of a coordinate, halves to even; not clipped."""
    return F.rint((target - F.lit(start)) / F.lit(step)).cast("long")


def inside(i: Column, count: Column | int) -> Column:
    """Index within an axis."""
    return (i >= 0) & (i < F.lit(count))


def fractional(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Grid coordinates (column, row) of a map point."""
    return (x - x0) / dx, (y - y0) / dy


def scene(col: Column, row: Column, height: Column, nx: int, ny: int, dx: float, dy: float, across: float, up: float) -> tuple[Column, Column, Column]:
    """Scene coordinates of a grid cell; ``across`` and ``up`` are metres a unit."""
    return (col - (nx - 1) / 2) * dx / across, height / up, (row - (ny - 1) / 2) * abs(dy) / across


def lift(stride: Column | int, layer: str, below: Column | float = 0.0) -> Column:
    """P25: metres that a layer floats above the surface; channels also clear the pressure layer below them."""
    s = F.lit(stride) - 1
    base = {"velocity": (18, 72), "pressure": (10, 64), "channel": (14, 76), "friction": (12, 64)}[layer]
    own = F.lit(base[0]) + s * base[1]
    return F.greatest(F.lit(below) + 24, own) if layer == "channel" else own


def rotate(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """A vector turned counter-clockwise by the grid's angle."""
    return u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle)


def sector(x: Column, y: Column) -> Column:
    """Eighth of the circle, counter-clockwise from the x axis; 0 for a point that isn't finite."""
    s = F.floor(F.pmod(F.atan2(y, x), F.lit(2 * math.pi)) / F.lit(2 * math.pi / SECTORS))
    return F.when(finite(x) & finite(y), F.greatest(F.lit(0), F.least(F.lit(SECTORS - 1), s))).otherwise(0).cast("int")


def _t(phi):
    e, s = ECCENTRICITY, F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))


def polar_stereographic(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Forward projection of degrees to metres, north pole."""
    e, p = ECCENTRICITY, STANDARD_PARALLEL
    m = math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    rho = _t(F.radians(lat)) * (SEMI_MAJOR * m / t)
    turn = F.radians(lon) - CENTRAL_MERIDIAN
    return rho * F.sin(turn), -rho * F.cos(turn)


def metres_per_degree_lat(lat: Column) -> Column:
    """F13. The coefficients are fixed values."""
    p = F.radians(lat)
    return F.lit(111132.92) - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)


def metres_per_degree_lon(lat: Column) -> Column:
    """F13. The coefficients are fixed values."""
    p = F.radians(lat)
    return 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)


def turn_angle(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """degrees between two steps in a row; NULL if one has no length."""
    ax, ay, bx, by = x1 - x0, y1 - y0, x2 - x1, y2 - y1
    norm = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(norm > 0, F.degrees(F.acos(clip(F.try_divide(ax * bx + ay * by, norm), -1, 1))))


def terrain_depth(h: Column, zice: Column, zeta: Column, s: Column, c: Column, hc: float) -> Column:
    """Depth of a terrain-following level under a free surface and an ice draft; never negative."""
    if not (math.isfinite(hc) and hc > 0):
        raise ValueError("critical depth must be finite and positive")
    z0 = (s * hc + h * c) / (h + hc)
    return F.greatest(F.lit(0.0), -(zeta + (zeta + h) * z0 + zice * (1 + z0)))


def proxy_depth(top: Column, bottom: Column, fraction: float, clearance: float = 20.0) -> Column:
    """A depth at a fraction of the water column, clear of both ends."""
    return F.greatest(F.least(top + fraction * (bottom - top), bottom - clearance), top + clearance)


def unit_hash(*key: Column) -> Column:
    """A reproducible uniform number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") / float(1 << 52)
