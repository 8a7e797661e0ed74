"""Colour scales as column expressions: colour stops, lookup tables, and the scales of each layer.

The stops below, their colours and the scales' knees and limits are fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validity import finite

VELOCITY = [(0.0, (0.06, 0.2, 0.5)), (0.35, (0.08, 0.62, 0.86)), (0.65, (0.95, 0.9, 0.27)), (1.0, (0.9, 0.2, 0.12))]
FRICTION = [(0.0, (0.047, 0.118, 0.259)), (0.26, (0.125, 0.478, 0.678)), (0.52, (0.88, 0.91, 0.79)), (0.78, (0.851, 0.545, 0.188)), (1.0, (0.588, 0.094, 0.114))]
PRESSURE = [(0.0, (0.9, 0.95, 0.95)), (1.0, (0.21, 0.05, 0.14))]
CHANNEL = [(0.0, (0.06, 0.16, 0.38)), (0.3, (0.05, 0.5, 0.74)), (0.62, (0.73, 0.85, 0.25)), (1.0, (0.86, 0.24, 0.1))]
VELOCITY_KNEE, VELOCITY_MAX = 20.0, 3000.0
FRICTION_KNEE, FRICTION_MAX = 0.015, 0.3
PRESSURE_REFERENCE = 5e6
DISCHARGE_MIN, DISCHARGE_MAX = 1e-3, 100.0
CORNERS = {"cold fresh": (0.0, 0.87, 0.99), "cold salty": (0.23, 0.11, 0.88), "warm fresh": (0.0, 0.76, 0.2), "warm salty": (0.99, 0.28, 0.0)}
THETA_RANGE, SALINITY_RANGE = (-2.0, 8.0), (30.0, 35.0)


def clamp01(v: Column) -> Column:
    """into [0, 1]; 0 for what isn't finite."""
    return F.when(finite(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).otherwise(0.0)


def clamp(v: Column, low: float, high: float) -> Column:
    """into [low, high]; low for what isn't finite."""
    return F.when(finite(v), F.greatest(F.lit(low), F.least(F.lit(high), v))).otherwise(F.lit(low))


def lerp(a: Column | float, b: Column | float, t: Column) -> Column:
    return F.lit(a) + (F.lit(b) - F.lit(a)) * t


def hex_rgb(c: Column) -> Column:
    """ARRAY<INT> of the three channels of #rrggbb."""
    h = F.regexp_replace(c, "^#+", "")
    return F.array(*(F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (1, 3, 5)))


def stops(t: Column, table: list[tuple[float, tuple[float, ...]]]) -> Column:
    """a colour between the stops around t; at a stop, its own colour. ARRAY<DOUBLE>."""
    x = clamp01(t)

    def channel(k: int) -> Column:
        out = F.when(x <= table[0][0], F.lit(table[0][1][k]))
        for (t0, c0), (t1, c1) in zip(table, table[1:], strict=False):
            out = out.when(x <= t1, lerp(c0[k], c1[k], (x - t0) / max(1e-6, t1 - t0)))
        return out.otherwise(F.lit(table[-1][1][k]))

    return F.array(*(channel(k) for k in range(3)))


def palette(t: Column, table: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """byte colours; the bracket is found from the right, so a stop starts the next stretch. ARRAY<INT>."""
    x = F.greatest(F.lit(table[0][0]), F.least(F.lit(table[-1][0]), t))

    def channel(k: int) -> Column:
        out = None
        for (t0, c0), (t1, c1) in zip(table, table[1:], strict=False):
            v = lerp(float(c0[k]), float(c1[k]), (x - t0) / max(1e-12, t1 - t0))
            out = F.when(x < t1, v) if out is None else out.when(x < t1, v)
        v = F.lit(float(table[-1][1][k])) if out is None else out.otherwise(F.lit(float(table[-1][1][k])))
        return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")

    return F.array(*(channel(k) for k in range(3)))


def lookup(t: Column, table: Column) -> Column:
    """a colour from ARRAY<ARRAY<DOUBLE>> of evenly spaced entries; black for an empty table."""
    n = F.size(table)
    at = clamp01(t) * (n - 1)
    i0 = F.floor(at).cast("int")
    i1 = F.least(n - 1, i0 + 1)
    a, b = F.try_element_at(table, i0 + 1), F.try_element_at(table, i1 + 1)
    return F.when(n > 0, F.zip_with(a, b, lambda p, q: p + (q - p) * (at - i0))).otherwise(F.array(*[F.lit(0.0)] * 3))


def velocity_scale(speed: Column) -> Column:
    """logarithmic; not clamped here."""
    v = F.when(finite(speed), F.greatest(F.lit(0.0), speed)).otherwise(0.0)
    return F.log1p(v / VELOCITY_KNEE) / math.log1p(VELOCITY_MAX / VELOCITY_KNEE)


def friction_scale(mpa: Column) -> Column:
    """F16."""
    v = F.least(F.lit(FRICTION_MAX), F.when(finite(mpa), F.greatest(F.lit(0.0), mpa)).otherwise(0.0))
    return F.log1p(v / FRICTION_KNEE) / math.log1p(FRICTION_MAX / FRICTION_KNEE)


def pressure_scale(pa: Column) -> Column:
    """F17."""
    return clamp01(F.when(finite(pa), F.greatest(F.lit(0.0), pa)).otherwise(0.0) / PRESSURE_REFERENCE)


def discharge_scale(q: Column) -> Column:
    """logarithmic between the limits; 0 for no discharge."""
    low, high = math.log10(DISCHARGE_MIN), math.log10(DISCHARGE_MAX)
    v = F.greatest(F.lit(DISCHARGE_MIN), F.least(F.lit(DISCHARGE_MAX), q))
    return F.when(finite(q) & (q > 0), (F.log10(v) - low) / (high - low)).otherwise(0.0)


def ocean_colour(theta: Column, salinity: Column, theta_range=THETA_RANGE, salinity_range=SALINITY_RANGE) -> Column:
    """four corner colours blended by temperature and salinity, a little brighter when warm."""
    span = lambda v, r: clamp01((v - r[0]) / max(1e-6, r[1] - r[0]))
    a, b = span(theta, theta_range), span(salinity, salinity_range)
    shine = 0.022 + a * 0.018
    c = CORNERS
    return F.array(*(
        clamp01(lerp(lerp(c["cold fresh"][k], c["warm fresh"][k], a), lerp(c["cold salty"][k], c["warm salty"][k], a), b) + shine * w)
        for k, w in enumerate((1.0, 0.65, 0.18))))


def value_position(v: Column, field: str, low: float, high: float) -> Column:
    """F32: place of a value on its palette: melt is split at zero, drafts count from the deep end, else linear."""
    if field == "ismr":
        below, above = clamp01((v - low) / max(1e-6, -low)), clamp01(v / max(1e-6, high))
        return F.when(v <= 0, 0.5 * below).otherwise(0.5 + 0.5 * above)
    if field == "zice":
        return clamp01(-v / max(1e-6, abs(low)))
    return clamp01((v - low) / max(1e-6, high - low))


def mask_rgba(mask: Column, colours: dict[int, tuple[int, int, int]]) -> Column:
    """ARRAY<INT> of a class's colour and opacity; class 0 and unknown ones are clear."""
    pairs = [F.lit(k).cast("int") for k in ()]
    for k, c in colours.items():
        pairs += [F.lit(k), F.array(*map(F.lit, (*c, 0 if k == 0 else 255)))]
    return F.coalesce(F.create_map(*pairs)[mask.cast("int")], F.array(*[F.lit(0)] * 4))
