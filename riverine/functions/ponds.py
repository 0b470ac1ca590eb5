"""Pond sizing as column expressions; stage-area curves are array<struct<depth:double,area:double>>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..params import FOOT3, INCH, SQFT, Ponds


def kind(water: Column, area: Column, p: Ponds) -> Column:
    """lake by tag, else by size."""
    return F.when(F.coalesce(F.lower(water).isin(*p.lake_tags), F.lit(False)), F.lit("lake")).when(area <= p.max_pond_area_m2, F.lit("pond")).otherwise(F.lit("lake"))


def volume(area: Column, p: Ponds) -> Column:
    """Volume (m3) by regression on the surface."""
    return F.greatest((p.fdot_intercept + p.fdot_slope * area * SQFT) / FOOT3, F.lit(0.0))


def _side(area: Column, below: Column, p: Ponds) -> Column:
    """Side of the square water surface at `below` m under the top."""
    return F.greatest(F.sqrt(area) - 2 * (100 / p.side_slope_pct) * below, p.bottom_area_min_ratio * F.sqrt(area))


def bottom_area(area: Column, depth: Column, p: Ponds) -> Column:
    return F.pow(_side(area, depth, p), F.lit(2.0))


def curve(area: Column, depth: Column, p: Ponds) -> Column:
    n = p.n_curve_points
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * depth / (n - 1)).alias("depth"), F.pow(_side(area, depth - i * depth / (n - 1), p), F.lit(2.0)).alias("area")))



def curve_volume(c: Column) -> Column:
    """Trapezoids under the curve; 0 with fewer than two points."""
    step = lambda t, i: t + (F.get(c, i)["area"] + F.get(c, i - 1)["area"]) / 2 * (F.get(c, i)["depth"] - F.get(c, i - 1)["depth"])
    return F.when(F.size(c) < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0), step))


def volume_below(c: Column, limit: Column) -> Column:
    """Volume under a depth, the segment it cuts taken in part."""

    def step(t, i):
        a, b = F.get(c, i - 1), F.get(c, i)
        top = F.least(b["depth"], limit)
        area = a["area"] + F.when(b["depth"] > a["depth"], (top - a["depth"]) / (b["depth"] - a["depth"])).otherwise(0.0) * (b["area"] - a["area"])
        return t + F.when(top > a["depth"], (a["area"] + area) / 2 * (top - a["depth"])).otherwise(0.0)

    return F.when(F.size(c) < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0), step))


def max_depth(area: Column, target: Column, p: Ponds) -> Column:
    """Depth whose curve holds the target volume: bisection to within 5 % (30 steps at most), the best middle counts."""
    mean, cap = target / F.greatest(area, F.lit(1.0)), F.lit(float(p.max_depth_m))
    lo, hi = F.greatest(mean * 0.5, F.lit(0.1)), F.least(mean * 3, cap)
    start = F.struct(lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("best"), F.lit(float("inf")).alias("err"), F.lit(False).alias("done"))

    def halve(t, _):
        mid = (t["lo"] + t["hi"]) / 2
        v = curve_volume(curve(area, mid, p))
        err = F.abs(v - target) / F.greatest(target, F.lit(1.0))
        now = F.struct(
            F.when(v < target, mid).otherwise(t["lo"]).alias("lo"),
            F.when(v < target, t["hi"]).otherwise(mid).alias("hi"),
            F.when(err < t["err"], mid).otherwise(t["best"]).alias("best"),
            F.least(err, t["err"]).alias("err"),
            (err < 0.05).alias("done"),
        )
        return F.when(t["done"], t).otherwise(now)

    return F.when(mean >= cap, cap).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, halve, lambda t: t["best"]))


def volume_error_pct(c: Column, target: Column) -> Column:
    return F.when((F.size(c) < 2) | (target <= 0), F.lit(0.0)).otherwise(F.abs(curve_volume(c) - target) / target * 100)


def orifice(v: Column) -> Column:
    """Orifice diameter (m) by volume."""
    cuft = v * FOOT3
    return F.when(cuft < 50_000, F.lit(8 * INCH)).when(cuft < 200_000, F.lit(12 * INCH)).when(cuft < 400_000, F.lit(18 * INCH)).otherwise(F.lit(24 * INCH))


def weir_length(area: Column, p: Ponds) -> Column:
    return F.when(area > 0, F.least(F.greatest(F.lit(3.0), 0.10 * F.sqrt(area)), F.lit(10.0))).otherwise(F.lit(p.weir_length_m))


def extend(c: Column, top: Column, p: Ponds) -> Column:
    """Four more points up to `top`, the sides going on at their slope; unchanged if it isn't above."""
    last = F.element_at(c, -1)
    more = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda i: F.struct((last["depth"] + (top - last["depth"]) * i / 4).alias("depth"), F.pow(F.sqrt(F.greatest(last["area"], F.lit(0.0))) + 2 * (100 / p.side_slope_pct) * (top - last["depth"]) * i / 4, F.lit(2.0)).alias("area")),
    )
    return F.when(top <= last["depth"], c).otherwise(F.concat(c, more))


def checks(area: Column, bottom: Column, c: Column, depth: Column, diameter: Column, crest: Column, p: Ponds) -> Column:
    """(bottom_ratio, activation, drawdown_h, bottom_flag, activation_flag, drawdown_flag)."""
    ratio = bottom / area
    total = curve_volume(c)
    activation = volume_below(c, crest) / F.when(total > 0, total)
    hours = total / F.when(diameter > 0, p.orifice_cd * math.pi * diameter * diameter / 4 * F.sqrt(9.81 * depth) * 3600)
    flag = F.when(ratio < 0.20, F.lit("fail")).when(ratio < 0.30, F.lit("warn")).otherwise(F.lit("pass"))
    return F.struct(ratio.alias("bottom_ratio"), activation.alias("activation"), hours.alias("drawdown_h"), flag.alias("bottom_flag"), (activation < 0.85).alias("activation_flag"), (~hours.between(24, 72)).alias("drawdown_flag"))


def required_orifice(q: Column, head: Column, p: Ponds) -> Column:
    """The next standard diameter that lets q through at a head, within the largest allowed."""
    need = F.sqrt(4 * q / (math.pi * p.orifice_cd * F.sqrt(2 * 9.81 * head)))
    sizes = [i * INCH for i in p.orifice_inches if i * INCH <= p.max_orifice_diameter_m]
    fit = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda d: d >= need)
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(sizes[-1]))
