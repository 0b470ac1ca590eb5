"""Spatial joins: a grid of tiles makes each an equi-join, an exact predicate follows.

Rows spread over tiles are far more than the optimizer reckons, so joins with them are merged and never broadcast by estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo


def tile(c: Column, size: float) -> Column:
    return F.floor(c / size)


def around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Each row in its own tile and the eight about it (i, j)."""
    i, j = tile(F.col(x), size), tile(F.col(y), size)
    return df.withColumn("i", F.explode(F.sequence(i - 1, i + 1))).withColumn("j", F.explode(F.sequence(j - 1, j + 1)))


def near_points(left: DataFrame, right: DataFrame, within: float) -> DataFrame:
    """Pairs of points (left: x, y; right: x2, y2) at most `within` apart, with their distance."""
    at = right.withColumn("i", tile(F.col("x2"), within)).withColumn("j", tile(F.col("y2"), within))
    return around(left, "x", "y", within).join(at, ["i", "j"]).drop("i", "j").withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).where(F.col("distance") <= within)


def nearest_points(left: DataFrame, right: DataFrame, within: float, key: str, other: str) -> DataFrame:
    """For each key the nearest other within a distance; ties: the smaller other."""
    pairs = near_points(left, right, within)
    return pairs.groupBy(key).agg(F.min(F.struct("distance", other)).alias("m")).select(key, f"m.{other}", "m.distance")


def line_tiles(lines: DataFrame, x0: str, y0: str, x1: str, y1: str, size: float, bounds: DataFrame | None = None) -> DataFrame:
    """Segments in every tile that their box touches (i, j); bounds (y_lo, y_hi: one row) clip overlong ones first."""
    lo, hi = F.least(y0, y1), F.greatest(y0, y1)
    if bounds is not None:
        lines = lines.crossJoin(F.broadcast(bounds))
        lo, hi = F.greatest(lo, F.col("y_lo")), F.least(hi, F.col("y_hi"))
        lines = lines.where(lo <= hi)
    out = lines.withColumn("i", F.explode(F.sequence(tile(F.least(x0, x1), size), tile(F.greatest(x0, x1), size))))
    out = out.withColumn("j", F.explode(F.sequence(tile(lo, size), tile(hi, size))))
    return out.drop("y_lo", "y_hi")


def nearest_lines(points: DataFrame, lines: DataFrame, within: float) -> DataFrame:
    """(node_id, river_id, distance, x, y) of the nearest segment (river_id, x0, y0, x1, y1) within a distance of each point; ties: smaller id."""
    bounds = points.agg((F.min("y") - within).alias("y_lo"), (F.max("y") + within).alias("y_hi"))
    tiled = line_tiles(lines, "x0", "y0", "x1", "y1", within, bounds)
    pairs = around(points.select("node_id", F.col("x").alias("px"), F.col("y").alias("py")), "px", "py", within).join(tiled.hint("merge"), ["i", "j"])
    t = geo.along(*[F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")])
    pairs = pairs.withColumn("x", F.col("x0") + t * (F.col("x1") - F.col("x0"))).withColumn("y", F.col("y0") + t * (F.col("y1") - F.col("y0")))
    pairs = pairs.withColumn("distance", geo.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"))).where(F.col("distance") <= within)
    return pairs.groupBy("node_id").agg(F.min(F.struct("distance", "river_id", "x", "y")).alias("m")).select("node_id", "m.*")


def crossing(segments: DataFrame, lines: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Keys of segments (ax, ay, bx, by) that cross a line (x0, y0, x1, y1) at an inner point."""
    bounds = segments.agg(F.min(F.least("ay", "by")).alias("y_lo"), F.max(F.greatest("ay", "by")).alias("y_hi"))
    both = line_tiles(segments, "ax", "ay", "bx", "by", size).join(line_tiles(lines, "x0", "y0", "x1", "y1", size, bounds), ["i", "j"])
    return both.where(geo.crosses(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x0", "y0", "x1", "y1")])).select(key).distinct()


def containing(points: DataFrame, rings: DataFrame, size: float, key: str, other: str) -> DataFrame:
    """(key, other) of points (x, y) inside rings (ring: array of points)."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = rings.withColumns({"x_lo": F.array_min(xs), "x_hi": F.array_max(xs), "y_lo": F.array_min(ys), "y_hi": F.array_max(ys)})
    tiled = boxed.withColumn("i", F.explode(F.sequence(tile(F.col("x_lo"), size), tile(F.col("x_hi"), size))))
    tiled = tiled.withColumn("j", F.explode(F.sequence(tile(F.col("y_lo"), size), tile(F.col("y_hi"), size))))
    at = points.withColumn("i", tile(F.col("x"), size)).withColumn("j", tile(F.col("y"), size))
    both = at.join(tiled.hint("merge"), ["i", "j"]).where("x between x_lo and x_hi and y between y_lo and y_hi")
    return both.where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select(key, other)


def keep_larger(boxes: DataFrame, share: float = 0.5, rounds: int = 1000) -> DataFrame:
    """Boxes (box_id, x0, y0, x1, y1, area): from the largest down (ties: smaller id) one goes if a kept one that comes
    before covers more than `share` of it.  A box settles once all before it that would remove it are settled."""
    from .iterate import cut

    size = boxes.agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).alias("s")).first()["s"] or 1.0
    tiled = boxes.withColumn("i", F.explode(F.sequence(tile(F.col("x0"), size), tile(F.col("x1"), size)))).withColumn("j", F.explode(F.sequence(tile(F.col("y0"), size), tile(F.col("y1"), size))))
    o = tiled.select(*[F.col(c).alias(f"o_{c}") if c not in ("i", "j") else F.col(c) for c in tiled.columns])
    w = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    h = F.least("y1", "o_y1") - F.greatest("y0", "o_y0")
    pairs = tiled.join(o, ["i", "j"]).where((F.struct(-F.col("o_area"), "o_box_id") < F.struct(-F.col("area"), "box_id")) & (w > 0) & (h > 0) & (w * h > share * F.col("area")))
    pairs = cut(pairs.select("box_id", F.col("o_box_id").alias("by_id")).distinct())
    state = cut(boxes.select("box_id", F.lit(None).cast("boolean").alias("kept")))
    for _ in range(rounds):
        seen = pairs.join(state.withColumnsRenamed({"box_id": "by_id", "kept": "by_kept"}), "by_id").groupBy("box_id").agg(F.bool_or(F.coalesce("by_kept", F.lit(False))).alias("hit"), F.bool_or(F.col("by_kept").isNull()).alias("open"))
        now = state.join(seen, "box_id", "left").select("box_id", F.coalesce("kept", F.when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))).alias("kept"))
        state = cut(now)
        if not state.where("kept is null").take(1):
            return boxes.join(state.where("kept").select("box_id"), "box_id", "left_semi")
    raise RuntimeError("overlaps did not settle")
