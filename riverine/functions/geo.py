"""Geometry as column expressions: lines and rings are array<struct<x:double,y:double>>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def point(x, y) -> Column:
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once: what a lambda mentions is evaluated anew at each mention, for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(g: Column) -> Column:
    """Array of (ax, ay, bx, by) of consecutive points."""
    pair = lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))
    return bound(g, lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - 1, F.lit(1))), lambda i: pair(F.get(g, i - 1), F.get(g, i))))


def length(g: Column) -> Column:
    return F.aggregate(segments(g), F.lit(0.0), lambda t, s: t + F.coalesce(distance(s["ax"], s["ay"], s["bx"], s["by"]), F.lit(0.0)))


def is_closed(g: Column) -> Column:
    return F.element_at(g, 1) == F.element_at(g, -1)


def reverse(g: Column) -> Column:
    return F.reverse(g)


def ring_area(g: Column) -> Column:
    """Shoelace area of a ring (closed or not)."""
    twice = F.aggregate(
        F.sequence(F.lit(0), F.size(g) - 1),
        F.lit(0.0),
        lambda t, i: t + F.get(g, i)["x"] * F.get(g, (i + 1) % F.size(g))["y"] - F.get(g, (i + 1) % F.size(g))["x"] * F.get(g, i)["y"],
    )
    return F.abs(twice) / 2


def in_ring(px: Column, py: Column, g: Column) -> Column:
    """Ray casting: whether the point lies inside the ring."""
    crossings = F.aggregate(
        F.sequence(F.lit(0), F.size(g) - 1),
        F.lit(0),
        lambda t, i: t + F.when(_ray(px, py, F.get(g, i), F.get(g, (i + 1) % F.size(g))), 1).otherwise(0),
    )
    return crossings % 2 == 1


def _ray(px, py, a, b) -> Column:
    spans = (a["y"] > py) != (b["y"] > py)
    return spans & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) + a["x"])


def side(ax, ay, bx, by, px, py) -> Column:
    """Sign of the point's side of the line a-b."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crosses(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Segments a-b and c-d cross at an inner point of both."""
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def along(px, py, ax, ay, bx, by) -> Column:
    """Share (0..1) of a-b at which the point nearest to p lies."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def nearest_on(px, py, g: Column) -> Column:
    """(distance, x, y) of the point of the line nearest to p; ties go to the earlier segment."""
    found = F.transform(
        segments(g),
        lambda s: F.struct(
            segment_distance(px, py, s["ax"], s["ay"], s["bx"], s["by"]).alias("distance"),
            (s["ax"] + along(px, py, s["ax"], s["ay"], s["bx"], s["by"]) * (s["bx"] - s["ax"])).alias("x"),
            (s["ay"] + along(px, py, s["ax"], s["ay"], s["bx"], s["by"]) * (s["by"] - s["ay"])).alias("y"),
        ),
    )
    return F.array_min(found)


def at_share(g: Column, share: Column) -> Column:
    """The point at a share of a straight line's length (its first and last point)."""
    a, b = F.element_at(g, 1), F.element_at(g, -1)
    return F.struct((a["x"] + share * (b["x"] - a["x"])).alias("x"), (a["y"] + share * (b["y"] - a["y"])).alias("y"))


def segmentize(g: Column, longest: float) -> Column:
    """The line with points put in so that no segment is longer than `longest`."""
    count = lambda s: F.greatest(F.ceil(distance(s["ax"], s["ay"], s["bx"], s["by"]) / longest), F.lit(1))
    at = lambda s, i, n: F.struct((s["ax"] + (s["bx"] - s["ax"]) * i / n).alias("x"), (s["ay"] + (s["by"] - s["ay"]) * i / n).alias("y"))
    cut = lambda s: bound(count(s), lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: at(s, i, n)))
    return bound(g, lambda g: F.concat(F.slice(g, 1, 1), F.flatten(F.transform(segments(g), cut))))


def collapse(g: Column, shortest: float) -> Column:
    """Drops inner points nearer than `shortest` to the last kept one; the ends stay."""
    near = lambda q, p: distance(q["x"], q["y"], p["x"], p["y"]) < shortest
    kept = lambda g: F.aggregate(F.slice(g, 2, F.greatest(F.size(g) - 2, F.lit(0))), F.slice(g, 1, 1), lambda t, p: F.when(near(F.element_at(t, -1), p), t).otherwise(F.concat(t, F.array(p))))
    return bound(g, lambda g: F.when(F.size(g) < 2, g).otherwise(F.concat(kept(g), F.slice(g, -1, 1))))


def join_lines(lines: Column) -> Column:
    """Consecutive lines as one; the first point of each further line, shared with the one before, is dropped."""
    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.element_at(lines, 1), lambda t, g: F.concat(t, F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0)))))


def point_key(x: Column, y: Column, digits: int = 3) -> Column:
    """Rounded coordinates as a key for snapping."""
    return F.concat_ws(",", F.format_string(f"%.{digits}f", F.round(x, digits)), F.format_string(f"%.{digits}f", F.round(y, digits)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position in degrees."""
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + zone).cast("int")


def turn_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Degrees at b between the ways to a and to c: 180 straight on, 0 back; null if points coincide or lack."""
    m = distance(ax, ay, bx, by) * distance(cx, cy, bx, by)
    cos = ((ax - bx) * (cx - bx) + (ay - by) * (cy - by)) / F.when(m == 0, F.lit(None)).otherwise(m)
    return F.when(cos.isNull(), F.lit(None).cast("double")).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


# The ellipsoid of GPS and the scale of UTM's middle meridian.
_AXIS, _FLAT, _SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RADIUS = _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """(x, y) in metres of a position in degrees, in the UTM zone of an EPSG code, by Krueger's series (millimetres within a zone)."""
    zone, south = epsg % 100, epsg >= 32700
    k = 2 * _N**0.5 / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    off = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORTH, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + _SCALE * _RADIUS * east).alias("x"), (F.when(south, 10_000_000.0).otherwise(0.0) + _SCALE * _RADIUS * north).alias("y"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """(lon, lat) in degrees of a position in a UTM zone."""
    zone, south = epsg % 100, epsg >= 32700
    xi = (y - F.when(south, 10_000_000.0).otherwise(0.0)) / (_SCALE * _RADIUS)
    eta = (x - 500_000) / (_SCALE * _RADIUS)
    a, b = xi, eta
    for j, c in enumerate(_BACK, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.struct((F.degrees(F.atan2(F.sinh(b), F.cos(a))) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))


def centroid(g: Column) -> Column:
    """Centre of gravity of a ring; of a ring without area the mean of its corners."""
    at = lambda i: (F.get(g, i), F.get(g, (i + 1) % F.size(g)))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "x", "y")])

    def step(t, i):
        p, q = at(i)
        w = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((t["a"] + w).alias("a"), (t["x"] + (p["x"] + q["x"]) * w).alias("x"), (t["y"] + (p["y"] + q["y"]) * w).alias("y"))

    s = F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)
    mean = lambda c: F.aggregate(g, F.lit(0.0), lambda t, p: t + p[c]) / F.size(g)
    return F.struct(F.when(s["a"] == 0, mean("x")).otherwise(s["x"] / (3 * s["a"])).alias("x"), F.when(s["a"] == 0, mean("y")).otherwise(s["y"] / (3 * s["a"])).alias("y"))


def is_valid_ring(g: Column) -> Column:
    """At least three different corners, some area, and no two sides that cross."""
    n = F.size(g)
    side = lambda i: (F.get(g, i), F.get(g, (i + 1) % n))

    def hits(i, j):
        (a, b), (c, d) = side(i), side(j)
        return crosses(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"], d["x"], d["y"])

    index = F.sequence(F.lit(0), n - 1)
    knot = F.exists(index, lambda i: F.exists(index, lambda j: (j > i) & hits(i, j)))
    return F.coalesce((F.size(F.array_distinct(g)) >= 3) & (ring_area(g) > 0) & ~knot, F.lit(False))


def simplified(g: Column, tolerance: float) -> Column:
    """The line without points that lie within a tolerance of the chord from the last kept point to the next one (ends stay)."""
    inner = F.sequence(F.lit(1), F.greatest(F.size(g) - 2, F.lit(1)))

    def step(t, i):
        p, a, b = F.get(g, i), F.element_at(t, -1), F.get(g, i + 1)
        return F.when(segment_distance(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"]) <= tolerance, t).otherwise(F.concat(t, F.array(p)))

    return F.when(F.size(g) < 3, g).otherwise(F.concat(F.aggregate(inner, F.slice(g, 1, 1), step), F.slice(g, -1, 1)))
