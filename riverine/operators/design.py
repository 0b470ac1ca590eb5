"""Hydraulic design: pipe series, channels, outfall slopes, resizing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric
from ..params import Channels, Hydraulics
from . import graph
from .iterate import cut


def channels(nodes: DataFrame, p: Channels) -> DataFrame:
    """width, depth and invert of the channel at each node (total: drained m2, z: surface)."""
    out = nodes.withColumn("width", numeric.channel_width(F.col("total"), p))
    out = out.withColumn("depth", numeric.channel_depth(F.col("width"), p))
    return out.withColumn("invert", F.col("z") - F.col("depth"))


def outfall_slopes(edges: DataFrame, p: Hydraulics) -> DataFrame:
    """Outfalls (zu, zv, length): too steep ones get longer, those without a fall get a lower sink."""
    drop = F.col("zu") - F.col("zv")
    out = edges.withColumn("sink_invert", F.when(drop <= 0, F.col("zu") - p.min_positive_slope * F.col("length")).otherwise(F.col("zv")))
    return out.withColumn("length", F.when((drop > 0) & (drop / F.col("length") > p.max_outfall_slope), drop / p.max_outfall_slope).otherwise(F.col("length")))


def manhole_drop(drop: Column, p: Hydraulics) -> Column:
    return F.when(drop > 0, F.least(F.lit(p.manhole_drop_m), 0.5 * drop)).otherwise(0.0)


def connector_geometry(outfalls: DataFrame, feeders: DataFrame) -> DataFrame:
    """Outfall connectors (u, v, zu, zv): as wide as the widest pipe into u, 0.3 m at least; adverse ones start higher."""
    widest = feeders.groupBy(F.col("v").alias("u")).agg(F.max("diameter").alias("d"))
    out = outfalls.join(widest, "u", "left").withColumn("diameter", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(0.3))).drop("d")
    return out.withColumn("in_offset", F.greatest(F.col("zv") - F.col("zu"), F.lit(0.0)))


def river_areas(inflow: DataFrame, rivers: DataFrame, sampled: DataFrame) -> DataFrame:
    """(node, area): the raster's drained area where known, else what outfalls and rivers above bring."""
    given = rivers.join(inflow, "node", "left").withColumn("amount", F.coalesce("area", F.lit(0.0))).select("node", "next", "amount")
    total = graph.accumulate(given)
    return total.join(sampled.where("area > 0").withColumnRenamed("area", "seen"), "node", "left").select("node", F.coalesce("seen", "total").alias("area"))


def resize(edges: DataFrame, flows: DataFrame, p: Hydraulics) -> DataFrame:
    """Diameters that carry the re-accumulated flows (u, q) with the safety factor, never smaller than before nor than the widest above."""
    need = edges.join(flows, "u").withColumn("need", numeric.first_diameter(lambda d: numeric.full_capacity(d, F.greatest("slope", F.lit(p.min_positive_slope))) >= F.col("q") * p.flat_terrain_capacity_factor, F.col("diameter"), p.diameters))
    above = graph.reach_max(need.select(F.col("u").alias("node"), F.col("v").alias("next"), F.col("need").alias("amount")))
    return need.drop("need").join(above.withColumnRenamed("node", "u"), "u").withColumn("diameter", F.greatest("diameter", "most")).drop("most", "q")


def pipe_by_pipe(edges: DataFrame, nodes: DataFrame, p: Hydraulics, block: int = 20_000, rounds: int = 10_000) -> DataFrame:
    """u, v, diameter, slope, velocity, fill, cost_usd, us_invert, ds_invert of every pipe (u, v, length) of an acyclic network.

    Inverts depend on all pipes above, in order.  A weakly connected component
    of up to `block` nodes is sized in one task; larger ones are cut into
    blocks of neighbouring nodes (x, y), a task each, which take what pipes
    from other blocks brought in the last round as given, and are sized again
    while that changes.
    """
    part = graph.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("node", "node_id")
    big = cut(part.join(part.groupBy("root").count().where(F.col("count") > block).select("root"), "root", "left_semi"))
    tiles = None
    if "x" in nodes.columns and big.take(1):
        tiles = graph.blocks(nodes.join(big, "node_id", "left_semi").select("node_id", "x", "y"), block).select(F.col("node").alias("node_id"), "tile")
    at = part.withColumn("tile", F.lit(0)) if tiles is None else part.join(tiles, "node_id", "left").withColumn("tile", F.coalesce("tile", F.lit(0)))
    n = nodes.select("node_id", F.col("surface_elevation").alias("z"), F.col("contributing_area").alias("area")).join(at, "node_id")
    end = lambda c: n.withColumnsRenamed({"node_id": c, "z": f"z{c}", "area": f"a{c}", "tile": f"t{c}", "root": f"r{c}"})
    arcs = cut(edges.join(end("u"), "u").join(end("v"), "v").drop("rv"))
    rows = arcs.withColumnsRenamed({"ru": "root", "tu": "tile"})
    rim = cut(arcs.where("tu <> tv").select("u", "v", F.col("ru").alias("root"), F.col("tv").alias("tile")))
    kinds = "root long, tile int, u long, v long, diameter double, slope double, velocity double, fill double, cost_usd double, us_invert double, ds_invert double, flow double"

    def size(key, inside: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        found = design_component(inside, p, given)
        return pd.DataFrame([(*key, *x) for x in found], columns=["root", "tile", "u", "v", "diameter", "slope", "velocity", "fill", "cost_usd", "us_invert", "ds_invert", "flow"])

    on = ["root", "tile"]
    state, active = edges.sparkSession.createDataFrame([], kinds), None
    for _ in range(rounds):
        some = rows if active is None else rows.join(active, on, "left_semi")
        given = rim.join(state.select("u", "v", "diameter", "ds_invert", "flow"), ["u", "v"])
        given = given if active is None else given.join(active, on, "left_semi")
        sized = cut(some.groupBy(*on).cogroup(given.groupBy(*on)).applyInPandas(size, kinds))
        rest = state if active is None else state.join(active, on, "left_anti")
        now, was = (x.select("u", "v", F.struct("diameter", "ds_invert", "flow").alias(c)) for x, c in ((sized, "now"), (state, "was")))
        moved = rim.join(now, ["u", "v"]).join(was, ["u", "v"], "left").where(~F.col("was").eqNullSafe(F.col("now")))
        active = cut(moved.select(*on).distinct())
        state = cut(rest.unionByName(sized))
        if not active.take(1):
            return state.drop("root", "tile", "flow")
    raise RuntimeError("pipes did not settle: is there a cycle?")


def _normal_depth(q: float, d: float, s: float) -> tuple[float, float, float]:
    """(fill, hydraulic radius, velocity) at normal depth."""
    if q <= 0 or s <= 0:
        return 0.0, 0.0, 0.0

    def area(t):
        return d * d / 8 * (t - math.sin(t))

    def flow(t):
        return area(t) * (d / 4 * (1 - math.sin(t) / t)) ** (2 / 3) * math.sqrt(s) / numeric.ROUGHNESS

    low, high = 1e-9, numeric.PEAK_ANGLE
    if q >= flow(high):
        t = 2 * math.pi
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if flow(mid) < q else (low, mid)
        t = (low + high) / 2
    a = area(t)
    return (1 - math.cos(t / 2)) / 2, a / (d * t / 2), q / a


def _manning_slope(v: float, r: float) -> float:
    return (v * numeric.ROUGHNESS / r ** (2 / 3)) ** 2


def _candidate(q, d, length, start, z_down, p: Hydraulics):
    """(slope, downstream depth, limited) of a diameter, or None where the ground leaves no fall."""
    r, limit = d / 4, 0.7 if d <= 0.6 else 0.8 if d <= 1.5 else 0.85
    least, most = _manning_slope(p.min_v, r), _manning_slope(p.max_v, r)
    slope = min(_manning_slope(q / (limit * math.pi * d * d / 4), r), most) if q > 0 else least
    slope = max(least, slope)
    depth = z_down - (start - slope * length)
    bounded = min(max(depth, p.min_depth), p.max_depth)
    if bounded == depth:
        return slope, depth, False
    slope = (start - (z_down - bounded)) / length
    return (slope, bounded, True) if slope > 0 else None


def _fits(q, d, slope, limited, p: Hydraulics):
    """(fill, velocity) if a pipe meets the rules at its design depth, else None."""
    fill, radius, v = _normal_depth(q, d, slope)
    if fill > (0.7 if d <= 0.6 else 0.8 if d <= 1.5 else 0.85):
        return None
    if limited:
        full = math.sqrt(slope) * (d / 4) ** (2 / 3) / numeric.ROUGHNESS * math.pi * d * d / 4
        return None if p.flat_terrain_capacity_factor > 1 and q * p.flat_terrain_capacity_factor > full else (fill, v)
    if q > 0 and not p.min_v <= v <= p.max_v:
        return None
    if q > 0 and d >= 0.45 and numeric.DENSITY * numeric.GRAVITY * radius * slope < numeric.LEAST_SHEAR:
        return None
    return fill, v


def design_component(group: pd.DataFrame, p: Hydraulics, given: pd.DataFrame | None = None) -> list[tuple]:
    """Pipes of one component or block, upstream first: the first feasible diameter that no pipe above exceeds, and the flow in each.

    given: what pipes from other blocks (v, diameter, ds_invert, flow) bring.
    """
    z, area, out, waits = {}, {}, {}, {}
    for r in group.sort_values(["u", "v"]).itertuples():
        z[r.u], z[r.v], area[r.u], area[r.v] = r.zu, r.zv, r.au, r.av
        out.setdefault(r.u, []).append((r.v, r.length))
        waits[r.v] = waits.get(r.v, 0) + 1
    flow = dict(area)
    floor, least, found = {}, {}, []
    if given is not None:
        for v, d, bottom, more in sorted(zip(*[given[c].tolist() for c in ("v", "diameter", "ds_invert", "flow")], strict=True)):
            floor[v], least[v] = max(floor.get(v, -math.inf), bottom), max(least.get(v, 0), d)
            if v in flow:
                flow[v] += more
    ready = sorted(n for n in z if not waits.get(n))
    while ready:
        node = ready.pop(0)
        start0 = floor.setdefault(node, z[node] - p.min_depth)
        for down, length in out.get(node, ()):
            q = flow[node] * p.precipitation / 3600
            start = max(start0, z[node] - p.max_depth)
            wanted = z[down] + p.min_positive_slope * length
            if start < wanted:  # a fall towards the street below needs a higher start, but not above ground
                start = min(wanted, z[node] - 0.01)
                floor[node] = start0 = max(start0, start)
            chosen = None
            for d in p.diameters:
                if d < least.get(node, 0):
                    continue
                if (c := _candidate(q, d, length, start, z[down], p)) and (f := _fits(q, d, c[0], c[2], p)):
                    chosen = (d, c[0], c[1], *f)
                    break
            if chosen is None:  # the largest, on the least positive slope if need be
                d = p.diameters[-1]
                slope = max((start - (z[down] - p.max_depth)) / length, p.min_positive_slope)
                fill, _, v = _normal_depth(q, d, slope)
                chosen = (d, slope, z[down] - (start - slope * length), fill, v)
            d, slope, depth, fill, v = chosen
            volume = max(length * (d + 0.3) * ((z[node] - start + depth) / 2 + 0.1), 0)
            cost = 1.32 / 2000 * (9579.31 * d**0.5737 + 1163.77 * volume**1.31)
            end = start - slope * length
            floor[down] = max(floor.get(down, -math.inf), end)
            least[down] = max(least.get(down, 0), d)
            flow[down] += flow[node]
            found.append((node, down, d, slope, v, fill, cost, start, end, flow[node]))
            waits[down] -= 1
            if not waits[down]:
                ready.append(down)
    return found
