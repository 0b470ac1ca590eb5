"""Interpolation, weights and hydraulics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..params import DIAMETERS

# Roughness of design pipes, water, gravity, least wall shear (Pa).
ROUGHNESS, DENSITY, GRAVITY, LEAST_SHEAR = 0.012, 1000.0, 9.81, 2.0
#: Central angle (radians) of greatest discharge in a part-full circular pipe.
PEAK_ANGLE = 5.3784


def rounded(c: Column, digits: int) -> Column:
    """Rounded in binary, by the nearest whole multiple, as C and the SQL do; F.round goes by the shortest decimal instead."""
    return F.round(c * 10.0**digits) / 10.0**digits


def interpolate(x: Column, xs, ys, left=None, right=None) -> Column:
    """Piecewise linear through (xs, ys) (ascending xs); left and right of them the given values, else the end values."""
    out = F.when(x < xs[0], F.lit(float(ys[0] if left is None else left))).when(x > xs[-1], F.lit(float(ys[-1] if right is None else right)))
    for (a, c), (b, d) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        out = out.when(x <= b, F.lit(float(c)) + (x - float(a)) * (float(d) - float(c)) / (float(b) - float(a)))
    return out


def slope_cost(slope: Column) -> Column:
    """Cost 0..1 of a surface slope: 0 between 0.3 % and 0.7 %, rising to 1 at -1 % and 10 %."""
    return interpolate(slope * 100, (-1, 0.3, 0.7, 10), (1, 0, 0, 1), 1, 1)


def turn_cost(angle: Column) -> Column:
    """Cost of a turn: 1 below 30 degrees, 0.2 at right angles, 0 straight on; the jump at 135 degrees is meant."""
    return F.when(angle < 30, F.lit(1.0)).when(angle < 135, 0.8 * F.abs(angle - 90) / 60 + 0.2).otherwise(0.4 * F.abs(180 - angle) / 90)


def scaled(x: Column, low: Column, high: Column, exponent: float, scale: float) -> Column:
    """Share of x between low and high, to a power, scaled; 0 for a constant column."""
    share = F.greatest((x - low) / (high - low), F.lit(2.22e-16))
    return F.when(low == high, F.lit(0.0)).otherwise(F.pow(share, F.lit(float(exponent))) * scale)


def cost_usd(volume: Column, diameter: Column) -> Column:
    return 1.32 / 2000 * (9579.31 * F.pow(diameter, F.lit(0.5737)) + 1163.77 * F.pow(volume, F.lit(1.31)))


def filling_ratio(d: Column) -> Column:
    return F.when(d <= 0.6, F.lit(0.7)).when(d <= 1.5, F.lit(0.8)).otherwise(F.lit(0.85))


def slope_of(v: Column, r: Column, n: float = ROUGHNESS) -> Column:
    """Manning slope of a velocity at a hydraulic radius."""
    return F.pow(v * n / F.pow(r, F.lit(2 / 3)), F.lit(2.0))


def velocity_of(slope: Column, r: Column, n: float = ROUGHNESS) -> Column:
    return F.sqrt(slope) * F.pow(r, F.lit(2 / 3)) / n


def shear(r: Column, slope: Column) -> Column:
    return DENSITY * GRAVITY * r * slope


def full_capacity(d: Column, slope: Column, n: float = ROUGHNESS) -> Column:
    """Discharge (m3/s) of a full circular pipe."""
    return velocity_of(slope, d / 4, n) * math.pi * d * d / 4


def _discharge(angle: Column, d: Column, slope: Column, n: float) -> Column:
    area = d * d / 8 * (angle - F.sin(angle))
    radius = d / 4 * (1 - F.sin(angle) / angle)
    return area * F.pow(radius, F.lit(2 / 3)) * F.sqrt(slope) / n


def part_full(q: Column, d: Column, slope: Column, n: float = ROUGHNESS) -> Column:
    """(fill, area, radius, velocity) at normal depth, by 60 bisections of the central angle."""
    start = F.struct(F.lit(1e-9).alias("lo"), F.lit(PEAK_ANGLE).alias("hi"))

    def halve(t, _):
        mid = (t["lo"] + t["hi"]) / 2
        low = _discharge(mid, d, slope, n) < q
        return F.struct(F.when(low, mid).otherwise(t["lo"]).alias("lo"), F.when(low, t["hi"]).otherwise(mid).alias("hi"))

    angle = F.when(q >= _discharge(F.lit(PEAK_ANGLE), d, slope, n), F.lit(2 * math.pi)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda t: (t["lo"] + t["hi"]) / 2))
    area = d * d / 8 * (angle - F.sin(angle))
    found = F.struct(((1 - F.cos(angle / 2)) / 2).alias("fill"), area.alias("area"), (area / (d * angle / 2)).alias("radius"), (q / area).alias("velocity"))
    none = F.struct(*[F.lit(0.0).alias(x) for x in ("fill", "area", "radius", "velocity")])
    return F.when((q <= 0) | (d <= 0) | (slope <= 0), none).otherwise(found)


def first_diameter(need, least: Column | None = None, diameters=DIAMETERS) -> Column:
    """The first diameter, from `least` on, for which need(diameter) holds; the largest if none."""
    fit = F.filter(F.array(*[F.lit(float(d)) for d in diameters]), lambda d: need(d) & (d >= (F.lit(0.0) if least is None else least)))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(float(diameters[-1])))


def channel_width(area_m2: Column, p) -> Column:
    km2 = F.greatest(area_m2 / 1e6, F.lit(0.01))
    return F.least(F.lit(float(p.max_width)), F.greatest(F.lit(float(p.min_width)), p.width_coeff * F.pow(km2, F.lit(float(p.width_exponent)))))


def channel_depth(width: Column, p) -> Column:
    return F.least(F.lit(float(p.max_depth)), F.greatest(F.lit(float(p.min_depth)), p.depth_ratio * width))


def weir_coefficient(cw: float, units: Column) -> Column:
    """Weir coefficient in the units of the flow: as given for US units, times sqrt(0.3048) else."""
    return F.when(F.upper(units).isin("CFS", "GPM", "MGD"), F.lit(cw)).otherwise(F.lit(cw * math.sqrt(0.3048)))
