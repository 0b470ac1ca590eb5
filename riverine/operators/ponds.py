"""Ponds in the network: anchors, outlets, capacity, partition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import numeric, ponds as fn
from ..params import INCH, Ponds
from . import graph, raster, spatial


def sized(ponds: DataFrame, p: Ponds) -> DataFrame:
    """Ponds (pond_id, area_m2, water) with kind, volume, depth, bottom, curve, orifice and weir."""
    out = ponds.withColumn("kind", fn.kind(F.col("water"), F.col("area_m2"), p)).withColumn("volume", fn.volume(F.col("area_m2"), p))
    out = out.withColumn("depth", fn.max_depth(F.col("area_m2"), F.col("volume"), p))
    out = out.withColumn("bottom", fn.bottom_area(F.col("area_m2"), F.col("depth"), p)).withColumn("curve", fn.curve(F.col("area_m2"), F.col("depth"), p))
    return out.withColumn("orifice", fn.orifice(F.col("volume"))).withColumn("weir_length", fn.weir_length(F.col("area_m2"), p)).withColumn("weir_crest", p.weir_crest_ratio * F.col("depth"))


def claim(pairs: DataFrame) -> DataFrame:
    """(pond_id, target) of one-to-one claims: the largest pond (ties: smaller id) has its target first; later ones lose it.

    pairs(pond_id, area_m2, target).
    """
    k = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("area_m2"), "pond_id"))
    return pairs.withColumn("k", k).where("k = 1").select("pond_id", "target")


def anchors(ponds: DataFrame, containing: DataFrame, near_rivers: DataFrame, near_nodes: DataFrame) -> DataFrame:
    """(pond_id, anchor, how): the outlet of the subcatchment it lies in, else the nearest river node, else the nearest node; others lack."""
    out = ponds.join(containing.withColumnRenamed("target", "a"), "pond_id", "left").join(near_rivers.select("pond_id", F.col("node_id").alias("b")), "pond_id", "left").join(near_nodes.select("pond_id", F.col("node_id").alias("c")), "pond_id", "left")
    how = F.when(F.col("a").isNotNull(), "sub").when(F.col("b").isNotNull(), "river").when(F.col("c").isNotNull(), "node")
    return out.select("pond_id", F.coalesce("a", "b", "c").alias("anchor"), how.alias("how")).where("anchor is not null")


def capacity_fill(offers: DataFrame) -> DataFrame:
    """(pond_id, sub_id) taken: each pond takes subcatchments nearest first (ties: smaller id) while they fit what is left;
    one that doesn't fit is skipped and uses nothing.  offers(pond_id, capacity, sub_id, distance, area); captured, if there,
    is what a pond holds before; a capacity of 0 or less is no limit.

    A pond's offers lie within a bounded distance, so its list is bounded.
    """
    had = F.col("captured") if "captured" in offers.columns else F.lit(0.0)
    room = F.when(F.col("capacity") > 0, F.col("capacity") - F.coalesce(had, F.lit(0.0))).otherwise(float("inf"))
    lists = offers.withColumn("room", room).groupBy("pond_id").agg(F.first("room").alias("left"), F.array_sort(F.collect_list(F.struct("distance", "sub_id", "area"))).alias("o"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("got"))
    step = lambda t, x: F.when(x["area"] <= t["left"], F.struct((t["left"] - x["area"]).alias("left"), F.concat(t["got"], F.array(x["sub_id"])).alias("got"))).otherwise(t)
    return lists.select("pond_id", F.explode(F.aggregate("o", start, step, lambda t: t["got"])).alias("sub_id"))


def reroute_offers(subs: DataFrame, ponds: DataFrame, drained: DataFrame, rivers: DataFrame, p: Ponds) -> DataFrame:
    """(pond_id, capacity, captured, sub_id, distance, area) for capacity_fill: each subcatchment (sub_id, x, y, area) that
    drains to no pond yet (drained: sub_id, pond_id) with its nearest pond (pond_id, x, y, volume) within reach.

    It doesn't go to a pond where a river line (river_id, x0, y0, x1, y1) is nearer and no farther than the river front, nor over a river.
    """
    free = subs.join(drained.select("sub_id"), "sub_id", "left_anti")
    at = ponds.select("pond_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = spatial.near_points(free.select("sub_id", "x", "y"), at, p.sub_reroute_max)
    near = near.groupBy("sub_id").agg(F.min(F.struct("distance", "pond_id", "x", "y", "x2", "y2")).alias("m")).select("sub_id", "m.*")
    river = spatial.nearest_lines(free.select(F.col("sub_id").alias("node_id"), "x", "y"), rivers, p.river_front_m).select(F.col("node_id").alias("sub_id"), F.col("distance").alias("to_river"))
    near = near.join(river, "sub_id", "left").where(F.col("to_river").isNull() | (F.col("to_river") >= F.col("distance")))
    over = spatial.crossing(near.select(F.col("sub_id").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")), rivers, p.sub_reroute_max)
    near = near.join(over.withColumnRenamed("id", "sub_id"), "sub_id", "left_anti")
    held = drained.join(subs.select("sub_id", "area"), "sub_id").groupBy("pond_id").agg(F.sum("area").alias("captured"))
    cap = ponds.select("pond_id", (p.capacity_multiplier * F.coalesce("volume", F.lit(0.0)) / (0.0254 * 0.5)).alias("capacity")).join(held, "pond_id", "left")
    return near.join(subs.select("sub_id", "area"), "sub_id").join(cap, "pond_id").select("pond_id", "capacity", F.coalesce("captured", F.lit(0.0)).alias("captured"), "sub_id", "distance", "area")


def moved_areas(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes(node_id, contributing_area, ...) after the areas of outlets (sub_id) went to ponds (pond_id)."""
    m = moves.select(F.col("sub_id").alias("node_id"), "pond_id")
    given = m.join(nodes.select("node_id", F.col("contributing_area").alias("a")), "node_id").groupBy(F.col("pond_id").alias("node_id")).agg(F.sum("a").alias("more"))
    out = nodes.join(m, "node_id", "left").join(given, "node_id", "left")
    area = F.when(F.col("pond_id").isNotNull(), 0.0).otherwise(F.coalesce("contributing_area", F.lit(0.0))) + F.coalesce("more", F.lit(0.0))
    return out.withColumn("contributing_area", area).drop("pond_id", "more")


def drainable_anchors(ponds: DataFrame, nodes: DataFrame, rivers: DataFrame, within: float, slope: float = 0.001) -> DataFrame:
    """(pond_id, near_id, near_dist, near_invert): the nearest node (node_id, x, y, invert) that lies low enough to drain a pond
    (pond_id, x, y, top) by a least slope, without a river (river_id, x0, y0, x1, y1) between; ties: smaller id."""
    n = nodes.select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2"), "invert")
    pairs = spatial.near_points(ponds.select("pond_id", "x", "y", "top"), n, within).where(F.col("invert") + slope * F.col("distance") < F.col("top"))
    pairs = pairs.withColumn("id", F.struct("pond_id", "node_id"))
    over = spatial.crossing(pairs.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")), rivers, within)
    return pairs.join(over, "id", "left_anti").groupBy("pond_id").agg(F.min(F.struct("distance", "node_id", "invert")).alias("m")).select("pond_id", F.col("m.node_id").alias("near_id"), F.col("m.distance").alias("near_dist"), F.col("m.invert").alias("near_invert"))


def outlet_tiers(ponds: DataFrame, p: Ponds, slope: float = 0.001) -> DataFrame:
    """ponds with tier, target (its id; null: the canal), tx, ty, target_invert and depth.

    Needs top, depth, x, y; anchor, anchor_invert, anchor_type, ax, ay; near_id,
    near_dist, near_invert, nx, ny; canal_dist, canal_stage, canal_x, canal_y.
    A pond whose anchor lies no lower than its top is led to the nearer of the
    drainable node and the canal; else it is deepened, if that helps within
    the greatest depth; else it has no outlet but seepage (closed).
    """
    top = F.col("top")
    stuck = F.coalesce((F.col("anchor_invert") >= top) & ~F.col("anchor_type").eqNullSafe(F.lit("river_outfall")), F.lit(False))
    canal = F.coalesce((F.col("canal_dist") <= p.downstream_search_max_m) & (F.col("near_dist").isNull() | (F.col("canal_dist") < F.col("near_dist"))) & (F.col("canal_stage") + slope * F.col("canal_dist") < top), F.lit(False))
    fall = slope * F.greatest(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) * 0.9, F.lit(1.0))
    deeper = top - (F.col("anchor_invert") - fall)
    deepen = (top > F.col("anchor_invert") + fall) & (deeper > F.col("depth")) & (deeper <= p.max_depth_m)
    tier = F.when(~stuck, "anchor").when(canal, "canal").when(F.col("near_id").isNotNull(), "rerouted").when(deepen, "deepened").otherwise("closed")
    out = ponds.withColumn("tier", tier)
    pick = lambda a, b, c: F.when(F.col("tier") == "canal", F.col(a)).when(F.col("tier") == "rerouted", F.col(b)).otherwise(F.col(c))
    out = out.withColumn("target", F.when(F.col("tier") == "canal", F.lit(None).cast("long")).when(F.col("tier") == "rerouted", F.col("near_id")).otherwise(F.col("anchor")))
    out = out.withColumn("tx", pick("canal_x", "nx", "ax")).withColumn("ty", pick("canal_y", "ny", "ay")).withColumn("target_invert", pick("canal_stage", "near_invert", "anchor_invert"))
    return out.withColumn("depth", F.when(F.col("tier") == "deepened", deeper).otherwise(F.col("depth")))


def outlet_links(tiers: DataFrame, p: Ponds, slope: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): each pond's outlet junction at a tenth of the way, its orifice and weir to it, and the outflow on, whose upper
    end is lifted where its target lies too high; a canal's own sink is a node as well.  Needs what outlet_tiers gives, orifice and weir_crest."""
    out, sink = -F.col("pond_id"), -F.col("pond_id") - outfall_ids()
    ox, oy = F.col("x") + (F.col("tx") - F.col("x")) * 0.1, F.col("y") + (F.col("ty") - F.col("y")) * 0.1
    t = tiers.withColumn("out", out).withColumn("v", F.coalesce("target", sink)).withColumn("ox", ox).withColumn("oy", oy).withColumn("invert", F.col("top") - F.col("depth"))
    nodes = t.select(F.col("out").alias("node_id"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.lit("outlet_junction").alias("node_type"), F.col("top").alias("surface_elevation"), F.col("invert").alias("chamber_floor_elevation"))
    canal = t.where("tier = 'canal'").select(F.col("v").alias("node_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit("river_outfall").alias("node_type"), F.col("target_invert").alias("surface_elevation"), F.col("target_invert").alias("chamber_floor_elevation"))
    short = F.greatest(F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")), F.lit(0.1))
    on = F.greatest(F.hypot(F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy")), F.lit(1.0))
    low = F.coalesce("target_invert", "invert")
    lift = F.when(F.col("invert") < low + slope * on, low - F.col("invert") + slope * on).otherwise(0.0)
    nothing = F.lit(None).cast("double")

    def edge(u, v, suffix, kind, **cells):
        names = ("length", "orifice_diam_m", "orifice_cd", "orifice_offset", "weir_crest_m", "weir_length_m", "in_offset", "channel_width", "channel_depth")
        name = F.concat(F.col(u).cast("string"), F.lit("-"), F.col(v).cast("string"), F.lit(suffix))
        return t.select(F.col(u).alias("u"), F.col(v).alias("v"), name.alias("id"), F.lit(kind).alias("edge_type"), *[cells.get(c, nothing).alias(c) for c in names])

    edges = edge("pond_id", "out", "-orifice", "orifice", length=short, orifice_diam_m=F.col("orifice"), orifice_cd=F.lit(p.orifice_cd), orifice_offset=F.lit(p.orifice_crest_offset_m))
    edges = edges.unionByName(edge("pond_id", "out", "-weir", "weir", length=short, weir_crest_m=F.when(F.col("tier") == "deepened", p.weir_crest_ratio * F.col("depth")).otherwise(F.col("weir_crest")), weir_length_m=fn.weir_length(F.col("area_m2"), p)))
    edges = edges.unionByName(edge("out", "v", "", "pond_outflow", length=on, in_offset=lift, channel_width=F.greatest(F.sqrt("area_m2") * 0.1, F.lit(1.0)), channel_depth=F.col("depth")))
    return nodes.unionByName(canal), edges


def outfall_ids() -> int:
    """What parts the ids of canal sinks from those of outlet junctions."""
    from .outfalls import SINK

    return SINK


def orphan_ponds(ponds: DataFrame, edges: DataFrame) -> DataFrame:
    """Ponds (pond_id) that have no orifice: they lost their outlet."""
    return ponds.join(edges.where("edge_type = 'orifice'").select(F.col("u").alias("pond_id")), "pond_id", "left_anti")


def partition(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node, hops, source): the sink each node drains to in the fewest hops (ties: smaller sink)."""
    return graph.reach(edges, sinks, backwards=True)


def pondsheds(parts: DataFrame, subs: DataFrame) -> DataFrame:
    """pond_id, n_subcatchments, area_m2 of the subcatchments whose outlet drains to the pond."""
    j = subs.join(parts.select(F.col("node").alias("outlet_id"), F.col("source").alias("pond_id")), "outlet_id")
    return j.groupBy("pond_id").agg(F.count("*").alias("n_subcatchments"), F.sum("area").alias("area_m2"))


def outlet_rows(ponds: DataFrame, anchor: DataFrame, p: Ponds) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each pond's outlet: a junction at a tenth of the way, orifice and weir to it, and an outflow on to the anchor."""
    j = ponds.join(anchor, "pond_id").withColumn("outlet", -F.col("pond_id"))
    nodes = j.select(F.col("outlet").alias("node_id"), (F.col("x") + 0.1 * (F.col("ax") - F.col("x"))).alias("x"), (F.col("y") + 0.1 * (F.col("ay") - F.col("y"))).alias("y"), F.lit("outlet_junction").alias("node_type"))
    name = lambda s: F.concat(F.col("pond_id").cast("string"), F.lit(s)).alias("id")
    nothing = F.lit(None).cast("double")
    edge = lambda u, v, s, t, d, c: j.select(F.col(u).alias("u"), F.col(v).alias("v"), name(s), F.lit(t).alias("edge_type"), d.alias("orifice_diam_m"), c.alias("weir_crest_m"))
    edges = edge("pond_id", "outlet", "-orifice", "orifice", F.col("orifice"), nothing).unionByName(edge("pond_id", "outlet", "-weir", "weir", nothing, F.col("weir_crest"))).unionByName(edge("outlet", "anchor", "-outflow", "pond_outflow", nothing, nothing))
    return nodes, edges


def viable(edges: DataFrame, ponds: DataFrame, terminals: DataFrame, p: Ponds, stage_drop: float = 0.1, stage_slope: float = 0.001) -> DataFrame:
    """Ponds (pond_id, head) from which some terminal (node, invert, is_stage) lies low enough: by the least head drop, or for
    water surfaces by a drop that grows with the shortest way there.  edges(u, v, length)."""
    from .iterate import cut

    e = cut(edges.select("u", "v", "length"))
    front = cut(ponds.select("pond_id", "head", F.col("pond_id").alias("node"), F.lit(0.0).alias("far")))
    state = front
    while front.take(1):
        step = front.join(e, front.node == e.u).groupBy("pond_id", "head", F.col("v").alias("node")).agg(F.min(F.col("far") + F.col("length")).alias("far"))
        old = state.groupBy("pond_id", "node").agg(F.min("far").alias("was"))
        front = cut(step.join(old, ["pond_id", "node"], "left").where("was is null or far < was").select("pond_id", "head", "node", "far"))
        state = cut(state.unionByName(front))
    t = state.groupBy("pond_id", "head", "node").agg(F.min("far").alias("far")).join(terminals, "node")
    fine = F.when(F.col("is_stage"), F.col("head") - F.col("invert") >= stage_drop + stage_slope * F.col("far")).otherwise(F.col("head") - F.col("invert") >= p.min_outfall_head_drop_m)
    return ponds.join(t.where(fine).select("pond_id").distinct(), "pond_id", "left_semi")


def carriers(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """(node): everything that a pond's outflow passes, from its outlet (node) down."""
    return graph.reach(edges, outlets).select("node")


def routed_inflows(pipes: DataFrame, sinks: DataFrame, carriers: DataFrame) -> DataFrame:
    """Pipes (u, v) into an outlet junction become inflows of its pond, unless u carries a pond's own outflow; sinks(node, pond_id)."""
    into = sinks.select(F.col("node").alias("v"), "pond_id")
    c = carriers.select(F.col("node").alias("u"), F.lit(True).alias("carries"))
    j = pipes.join(into, "v", "left").join(c, "u", "left")
    move = F.col("pond_id").isNotNull() & F.col("carries").isNull()
    keep = [x for x in pipes.columns if x not in ("v", "edge_type", "id")]
    return j.select(*keep, F.when(move, F.col("pond_id")).otherwise(F.col("v")).alias("v"), F.when(move, F.lit("pond_inflow")).otherwise(F.col("edge_type")).alias("edge_type"), F.when(move, F.concat("id", F.lit("-pond_inflow"))).otherwise(F.col("id")).alias("id"))


def inflow_tiers(feeders: DataFrame, p: Ponds, slope: float = 0.001) -> DataFrame:
    """feeders with tier, pond_invert, in_offset and out_offset of pipes led into ponds.

    Needs u_invert, d_invert (of the node the pipe went to), p_invert and
    p_top of the pond, length, out_offset.  A pond that lies above the pipe's
    old end is deepened to it, as far as the greatest depth allows (tier 2);
    the pipe ends above the pond's bottom by the inflow offset; where that
    leaves no fall its upper end is lifted (tier 3).
    """
    low = F.greatest(F.col("d_invert"), F.col("p_top") - p.max_depth_m)
    deeper = (F.col("p_invert") > F.col("d_invert")) & (low < F.col("p_invert"))
    f = feeders.withColumn("pond_invert", F.when(deeper, low).otherwise(F.col("p_invert"))).withColumn("in_offset", F.greatest(F.col("d_invert") - F.col("pond_invert"), F.lit(0.0)) + p.inflow_offset_m)
    length, out = F.greatest(F.coalesce("length", F.lit(0.0)), F.lit(1.0)), F.coalesce("out_offset", F.lit(0.0))
    flat = ((F.col("u_invert") + out) - (F.col("pond_invert") + F.col("in_offset"))) / length < slope
    lift = (F.col("pond_invert") + F.col("in_offset") + slope * length) - (F.col("u_invert") + out)
    return f.withColumn("tier", F.when(flat, 3).when(deeper, 2).otherwise(1)).withColumn("out_offset", F.when(flat, out + lift).otherwise(out))


def pipe_caps(outflows: DataFrame, pipes: DataFrame, floors: DataFrame, least_slope: float = 0.001) -> DataFrame:
    """(pond_id, cap): what the street pipes below a pond's outlets (pond_id, node) can carry: of the pipes (u, v, diameter, length,
    in_offset, out_offset) out of a node the least, of several outlets the most; ponds without such pipes lack."""
    z = floors.select("node_id", F.col("chamber_floor_elevation").alias("z"))
    e = pipes.where("diameter is not null and length > 0").join(z.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(z.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v").where("zu is not null and zv is not null")
    fall = (F.col("zu") + F.coalesce("in_offset", F.lit(0.0)) - F.col("zv") - F.coalesce("out_offset", F.lit(0.0))) / F.col("length")
    cap = e.withColumn("cap", numeric.full_capacity(F.col("diameter"), F.greatest(fall, F.lit(least_slope)))).groupBy(F.col("u").alias("node")).agg(F.min("cap").alias("cap"))
    return outflows.join(cap, "node").groupBy("pond_id").agg(F.max("cap").alias("cap")).where("cap > 0")


def resized_orifices(ponds: DataFrame, p: Ponds) -> DataFrame:
    """(pond_id, diameter): orifices (orifice, depth, closed, q_in: peak inflow, cap: of the pipe below, or null) that are too small
    for the flow aimed at grow to the next standard size, up to the largest allowed; none shrinks."""
    head = F.greatest(F.col("depth") + F.when(F.coalesce("closed", F.lit(False)), float(p.closed_basin_sur_depth_m)).otherwise(0.0), F.lit(0.1))
    q = F.when(F.col("cap") > 0, F.least(F.col("q_in") * p.peak_margin, F.col("cap") * p.pipe_fraction)).otherwise(F.col("q_in") * p.peak_margin)
    jet = p.orifice_cd * F.sqrt(2 * 9.81 * head)
    enough = q <= jet * math.pi * F.col("orifice") * F.col("orifice") / 4
    need = F.least(F.sqrt(4 * (q / jet) / math.pi), F.lit(p.max_orifice_diameter_m))
    sizes = [i * INCH for i in p.orifice_inches if i * INCH <= p.max_orifice_diameter_m + 1e-9]
    fit = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda d: (d >= need) & (d > F.col("orifice")))
    largest = F.greatest(F.col("orifice"), F.lit(sizes[-1]))
    return ponds.select("pond_id", F.when(enough, F.col("orifice")).otherwise(F.coalesce(F.get(fit, F.lit(0)), largest)).alias("diameter"))


def release_capacity(ponds: DataFrame) -> DataFrame:
    """(pond_id, release): orifice and weir of a full pond (orifice, depth, weir_length, weir_crest), the weir under half a metre at most."""
    jet = 0.65 * math.pi * F.col("orifice") * F.col("orifice") / 4 * F.sqrt(2 * 9.81 * F.col("depth"))
    over = F.greatest(F.least(F.col("depth") - F.coalesce("weir_crest", F.lit(0.0)), F.lit(0.5)), F.lit(0.0))
    weir = 3.0 * F.coalesce("weir_length", F.lit(0.0)) * F.pow(over, F.lit(1.5))
    return ponds.select("pond_id", F.when((F.col("orifice") > 0) & (F.col("depth") > 0), jet + weir).otherwise(0.0).alias("release"))


def gap_reroutes(labels: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """(sub_id, pond_id): subcatchments bound for an outfall whose centre's cell (sub_id, row_, col_) lies in a gap that a closing by
    `reach` cells adds to a pond's catchment cells (row_, col_, id); of several ponds the first by id."""
    gap = raster.enclosed(labels, None, reach)
    return centres.join(gap, ["row_", "col_"]).join(labels.select("row_", "col_"), ["row_", "col_"], "left_anti").select("sub_id", F.col("id").alias("pond_id"))


def intake_cycles(intakes: DataFrame, edges: DataFrame) -> DataFrame:
    """Intake edges (u, v: street to pond) that close a cycle: their street is reachable from the pond.

    Each pond is searched for its own street by forward frontiers.
    """
    from .iterate import cut

    e = cut(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    front = cut(intakes.select("v", F.col("v").alias("at")).distinct())
    seen = front
    while front.take(1):
        step = front.join(e, front["at"] == e.a).select("v", F.col("b").alias("at")).distinct()
        front = cut(step.join(seen, ["v", "at"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return intakes.join(seen.withColumnRenamed("at", "u"), ["u", "v"], "left_semi")
