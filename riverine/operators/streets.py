"""Street cleanup: parallels, close ends, direction, attachment to major lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from . import graph, spatial


def keep_longest(lines: DataFrame, digits: int = 3) -> DataFrame:
    """Of lines between the same two (snapped) ends, either way, the longest stays (ties: smaller id)."""
    a, b = F.element_at("geometry", 1), F.element_at("geometry", -1)
    ka, kb = geo.point_key(a["x"], a["y"], digits), geo.point_key(b["x"], b["y"], digits)
    l = lines.withColumn("ka", F.least(ka, kb)).withColumn("kb", F.greatest(ka, kb)).withColumn("len_", geo.length(F.col("geometry")))
    return l.groupBy("ka", "kb").agg(F.min_by(F.struct(*lines.columns), F.struct(-F.col("len_"), "id")).alias("m")).select("m.*")


def mean_parallel(lines: DataFrame, n: int = 10) -> DataFrame:
    """(u, v, geometry): parallels from u to v as the mean of n points at equal shares of each line's length."""
    g = F.col("geometry")
    cum = F.aggregate(geo.segments(g), F.array(F.lit(0.0)), lambda t, x: F.concat(t, F.array(F.element_at(t, -1) + geo.distance(x["ax"], x["ay"], x["bx"], x["by"]))))
    want = [F.col("total") * i / (n - 1) for i in range(n)]
    find = lambda w: F.greatest(F.least(F.size(F.filter("cum", lambda c: c <= w)) - 1, F.size(g) - 2), F.lit(0))
    # each step is a column of its own: what a lambda mentions is evaluated anew for each element
    l = lines.select("u", "v", "geometry", cum.alias("cum"), geo.length(g).alias("total"))
    l = l.select("*", *[find(w).alias(f"k{i}") for i, w in enumerate(want)])

    def at(i, c):
        k = F.col(f"k{i}")
        lo, hi = F.get("cum", k), F.get("cum", k + 1)
        share = F.when(hi > lo, F.least((want[i] - lo) / (hi - lo), F.lit(1.0))).otherwise(0.0)
        p, q = F.get(g, k)[c], F.get(g, k + 1)[c]
        return p + share * (q - p)

    mean = [F.struct(*[F.avg(at(i, c)).alias(c) for c in ("x", "y")]) for i in range(n)]
    return l.groupBy("u", "v").agg(F.array(*mean).alias("geometry"))


def merge_close(points: DataFrame, within: float) -> DataFrame:
    """(node_id, into): points (node_id, x, y) less than `within` apart, in chains, go to the least id of their cluster."""
    p = points.select("node_id", "x", "y")
    pairs = spatial.near_points(p, p.select(F.col("node_id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), within).where((F.col("node_id") < F.col("b")) & (F.col("distance") < within))
    c = graph.components(pairs.select(F.col("node_id").alias("a"), "b"))
    return c.where("node <> root").select(F.col("node").alias("node_id"), F.col("root").alias("into"))


def big_components(edges: DataFrame, more_than: int = 2) -> DataFrame:
    """Edges of connected components of more than so many lines."""
    c = graph.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnsRenamed({"node": "u", "root": "part"})
    e = edges.join(c, "u")
    return e.join(e.groupBy("part").count().where(F.col("count") > more_than).select("part"), "part", "left_semi").drop("part")


def orient(edges: DataFrame) -> DataFrame:
    """Edges turned so that they lead away from the least leaf of their component, by breadth-first depth (ties: as they are)."""
    c = graph.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
    start = c.join(degree, "node").groupBy("root").agg(F.min(F.struct((F.col("count") > 1).alias("inner"), "node")).alias("m")).select(F.col("m.node").alias("node"))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    depth = graph.reach(both, start).select("node", "hops")
    e = edges.join(depth.withColumnsRenamed({"node": "u", "hops": "hu"}), "u").join(depth.withColumnsRenamed({"node": "v", "hops": "hv"}), "v")
    turn = F.col("hu") > F.col("hv")
    cells = {"u": F.when(turn, F.col("v")).otherwise(F.col("u")), "v": F.when(turn, F.col("u")).otherwise(F.col("v"))}
    if "geometry" in edges.columns:
        cells["geometry"] = F.when(turn, geo.reverse(F.col("geometry"))).otherwise(F.col("geometry"))
    return e.select(*[cells.get(x, F.col(x)).alias(x) for x in edges.columns])


def attach(ends: DataFrame, major: DataFrame, within: float) -> DataFrame:
    """(node_id, river_id, distance, x, y): the nearest point on a major line (river_id: its id) of each local end within a distance."""
    return spatial.nearest_lines(ends, major, within)


def covers(edges: DataFrame, lane_width: float) -> DataFrame:
    """(id, ring): each straight pipe edge (ax, ay, bx, by, lanes_n) as a flat-ended rectangle of its lanes' width."""
    d = geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    w = F.col("lanes_n") * lane_width
    nx, ny = (F.col("by") - F.col("ay")) / d * w, (F.col("ax") - F.col("bx")) / d * w
    p = lambda x, y, s: F.struct((F.col(x) + s * nx).alias("x"), (F.col(y) + s * ny).alias("y"))
    return edges.where(d > 0).select("id", F.array(p("ax", "ay", 1), p("bx", "by", 1), p("bx", "by", -1), p("ax", "ay", -1)).alias("ring"))
