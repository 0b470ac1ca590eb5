"""The steps from streets and rivers to a sized drainage network, each a function of (Network, Parameters).

A step that needs what the network doesn't have (an elevation grid, ponds,
subcatchments) leaves it as it is.  meta may hold: cells (row_, col_, value:
elevations) and size (m), imperv (row_, col_, value: percent), rail (row_,
col_), waters (pond_id, ring), ponds (pond_id, x, y, area_m2, water); steps add labels
(row_, col_, id: whose subcatchment a cell is) and street_cover.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, numeric
from ..network import Network
from ..operators import design, dual, graph, network as net, outfalls, ponds, raster, simplify, spatial, streets, subcatchments
from ..operators.iterate import cut
from ..params import Parameters
from ..sources import readers, writers

CURVE = "array<struct<depth:double,area:double>>"
NODES = {
    "node_id": "bigint", "x": "double", "y": "double", "node_type": "string", "surface_elevation": "double", "chamber_floor_elevation": "double", "contributing_area": "double", "wb_area_m2": "double", "wb_volume_m3": "double", "wb_max_depth": "double",
    "wb_orifice_diam_m": "double", "wb_weir_crest_m": "double", "wb_embankment_elev": "double", "wb_closed_basin": "boolean", "wb_curve": CURVE,
}
EDGES = {
    "u": "bigint", "v": "bigint", "key": "int", "id": "string", "edge_type": "string", "length": "double", "highway": "string", "lanes": "string", "geometry": readers.LINE, "surface_slope": "double", "chahinian_slope": "double", "weight": "double",
    "contributing_area": "double", "diameter": "double", "cost_usd": "double", "roughness": "double", "in_offset": "double", "out_offset": "double", "channel_width": "double", "channel_depth": "double", "orifice_diam_m": "double", "orifice_cd": "double",
    "orifice_offset": "double", "orifice_type": "string", "flap_gate": "string", "weir_crest_m": "double", "weir_length_m": "double", "pond_intake": "boolean", "is_trunk": "boolean",
}
#: Depth (m) of streets burnt into the elevations, and of a chamber under the street.
BURN, CHAMBER = 2.0, 3.0


def _with(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with exactly the columns of kinds, those it lacks null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def shaped(n: Network) -> Network:
    """All columns that steps read or write, in their kinds."""
    e = _with(n.edges, EDGES)
    return n.with_nodes(_with(n.nodes, NODES)).with_edges(e.withColumn("key", F.coalesce("key", F.lit(0))).withColumn("edge_type", F.coalesce("edge_type", F.lit("pipe"))))


def _nodes(n: Network, more: DataFrame) -> Network:
    return n.with_nodes(n.nodes.unionByName(_with(more, NODES)))


def _edges(n: Network, more: DataFrame) -> Network:
    return n.with_edges(n.edges.unionByName(_with(more, EDGES).withColumn("key", F.coalesce("key", F.lit(0)))))


def _meta(n: Network, **values) -> Network:
    from dataclasses import replace

    return replace(n, meta={**n.meta, **values})


def _set(df: DataFrame, key: str, new: DataFrame, *columns: str) -> DataFrame:
    """df with columns taken from new (key, columns) where that has a row and a value."""
    j = df.join(new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns]), key, "left")
    return j.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def _both(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def _pipes(n: Network) -> DataFrame:
    return n.edges.where("edge_type = 'pipe'")


def _lines(n: Network) -> DataFrame:
    """Edges with a geometry, their own or the chord."""
    return writers.edge_geometry(n.edges, n.nodes).select(*n.edges.columns)


def _segments(edges: DataFrame, key: str = "id") -> DataFrame:
    """(river_id, x0, y0, x1, y1) of the sides of lines."""
    s = edges.select(F.col(key).alias("river_id"), F.explode(geo.segments(F.col("geometry"))).alias("s"))
    return s.select("river_id", F.col("s.ax").alias("x0"), F.col("s.ay").alias("y0"), F.col("s.bx").alias("x1"), F.col("s.by").alias("y1"))


def assign_ids(n: Network, p: Parameters) -> Network:
    return n.with_edges(net.assign_ids(n.edges))


def remove_unwanted(n: Network, p: Parameters) -> Network:
    return n.with_edges(net.without_highways(n.edges, p.topology.omit_edges)).drop_isolated()


def clean_streets(n: Network, p: Parameters) -> Network:
    """Of streets between the same ends the longest stays; ends nearer than the elevation grid is fine are one."""
    lines = cut(_lines(n))
    pipes = lines.where("edge_type = 'pipe'")
    kept = streets.keep_longest(pipes.select("id", "geometry")).select("id")
    ends = n.nodes.join(pipes.select(F.explode(F.array("u", "v")).alias("node_id")).distinct(), "node_id", "left_semi")
    moves = streets.merge_close(ends, p.subcatchments.dem_resolution)
    edges = lines.where("edge_type <> 'pipe'").unionByName(pipes.join(kept, "id", "left_semi"))
    return n.with_edges(net.relabel(edges, moves).select(*n.edges.columns)).drop_isolated()


def street_cover(n: Network, p: Parameters) -> Network:
    """The ground under the streets goes to meta; the network stays."""
    from ..functions.text import street_width

    e = _both(_pipes(n).select("id", "u", "v", "lanes"), n.nodes, "x", "y").withColumnsRenamed({"u_x": "ax", "u_y": "ay", "v_x": "bx", "v_y": "by"})
    return _meta(n, street_cover=streets.covers(e.withColumn("lanes_n", street_width(F.col("lanes"), lane_width=1.0)), p.subcatchments.lane_width))


def to_undirected(n: Network, p: Parameters) -> Network:
    """Streets without direction: the smaller end first, each line once."""
    swap = (F.col("edge_type") == "pipe") & (F.col("u") > F.col("v"))
    turned = {"u": F.when(swap, F.col("v")).otherwise(F.col("u")), "v": F.when(swap, F.col("u")).otherwise(F.col("v")), "geometry": F.when(swap, geo.reverse(F.col("geometry"))).otherwise(F.col("geometry"))}
    return n.with_edges(n.edges.select(*[turned.get(c, F.col(c)).alias(c) for c in n.edges.columns]).dropDuplicates(["u", "v", "id"]))


def split_long(n: Network, p: Parameters) -> Network:
    """Streets in pieces of the greatest length at most; nodes get new numbers, and keep what is known of them by their place."""
    longest = p.subcatchments.max_street_length
    lines = cut(_lines(n))
    pipes = lines.where("edge_type = 'pipe'")
    if not pipes.where(F.col("length") > longest).take(1):
        return n
    parts = net.split_long(pipes.select("id", "geometry"), longest)
    piece = F.array(geo.point("ax", "ay"), geo.point("bx", "by"))
    parts = parts.select("id", F.col("part").alias("key"), piece.alias("geometry")).join(pipes.drop("key", "geometry", "u", "v", "length"), "id").withColumn("id", F.lit(None).cast("string"))
    whole = parts.unionByName(lines.where("edge_type <> 'pipe'").drop("u", "v", "length"))
    nodes, edges = readers.graph_from_lines(whole)
    name = lambda df: df.withColumn("at", geo.point_key(F.col("x"), F.col("y"), 2))
    known = name(n.nodes).drop("node_id", "x", "y").dropDuplicates(["at"])
    return n.with_nodes(_with(name(nodes).join(known, "at", "left"), NODES)).with_edges(edges.select(*n.edges.columns))


def merge_short(n: Network, p: Parameters) -> Network:
    moves = net.short_clusters(_pipes(n), n.nodes)
    return n.with_edges(net.relabel(n.edges, moves).select(*n.edges.columns)).drop_isolated()


def _grid(n: Network) -> tuple[DataFrame, float] | None:
    return (n.meta["cells"], float(n.meta["size"])) if "cells" in n.meta else None


def _street_cells(n: Network, size: float) -> DataFrame:
    """Cells that streets run through."""
    points = writers.edge_geometry(_pipes(n), n.nodes).select(F.explode(geo.segmentize(F.col("geometry"), size / 2)).alias("p"))
    return points.select(F.floor(F.col("p.y") / size).cast("long").alias("row_"), F.floor(F.col("p.x") / size).cast("long").alias("col_")).distinct()


def contributing_area(n: Network, p: Parameters) -> Network:
    """Subcatchments of the nodes by the elevation grid with streets (and rail) burnt in, their impervious share, and each node's impervious area."""
    if (grid := _grid(n)) is None:
        return n.with_nodes(n.nodes.withColumn("contributing_area", F.coalesce("contributing_area", F.lit(0.0))))
    cells, size = grid
    filled = cut(raster.fill_gaps(cells))
    low = _street_cells(n, size)
    if "rail" in n.meta:
        low = low.unionByName(n.meta["rail"].select("row_", "col_"))
    way = cut(raster.breach(raster.burn(filled, low, BURN)))
    pointer = filled.select("row_", "col_").join(way, ["row_", "col_"], "left")
    slope = raster.slope_pct(filled, size).withColumnRenamed("slope", "value")
    least = math.ceil(p.subcatchments.min_drainage_area_m2 / size**2)
    subs, labels = subcatchments.derive(pointer, n.nodes, slope, size, least)
    if "imperv" in n.meta:
        subs = subcatchments.impervious(subs, raster.zonal_mean(labels, n.meta["imperv"]))
    else:
        subs = subs.withColumn("rc", F.lit(100.0)).withColumn("impervious_area", F.col("area"))
    subs = cut(subs)
    own = subs.select(F.col("sub_id").alias("node_id"), F.col("impervious_area").alias("area"))
    nodes = n.nodes.drop("contributing_area").join(own, "node_id", "left").withColumn("contributing_area", F.coalesce("area", F.lit(0.0))).select(*n.nodes.columns)
    return _meta(n.with_nodes(nodes).with_subs(subs), labels=labels)


def insert_ponds(n: Network, p: Parameters) -> Network:
    """Ponds of meta become storage nodes with a connector to their anchor: the outlet of the subcatchment they lie in, which the
    largest pond in it claims, else the nearest river node, else the nearest node within reach; those without one are left out.

    A pond takes its subcatchment's area and becomes its outlet.
    """
    given = n.meta.get("ponds")
    if given is None:
        return n
    sized = cut(ponds.sized(given.where(F.col("area_m2") >= p.ponds.min_area_m2), p.ponds).where("kind = 'pond'"))
    xy = n.nodes.select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    on_river = n.edges.where("edge_type = 'river'").select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    near = lambda to: spatial.nearest_points(sized.select("pond_id", "x", "y"), to, p.ponds.max_snap, "pond_id", "node_id").select("pond_id", "node_id")
    inside = sized.select("pond_id", "area_m2").limit(0).withColumn("target", F.lit(None).cast("long"))
    if n.subs is not None and "labels" in n.meta:
        size = float(n.meta["size"])
        at = sized.select("pond_id", "area_m2", F.floor(F.col("y") / size).cast("long").alias("row_"), F.floor(F.col("x") / size).cast("long").alias("col_"))
        inside = at.join(n.meta["labels"], ["row_", "col_"]).select("pond_id", "area_m2", F.col("id").alias("target"))
    claimed = ponds.claim(inside)
    found = ponds.anchors(sized, claimed, near(xy.join(on_river, "node_id", "left_semi")), near(xy))
    won = cut(ponds.claim(found.join(sized.select("pond_id", "area_m2"), "pond_id").select("pond_id", "area_m2", F.col("anchor").alias("target"))))
    z = n.nodes.select(F.col("node_id").alias("target"), "surface_elevation", F.col("x").alias("ax"), F.col("y").alias("ay"))
    placed = sized.join(won, "pond_id").join(z, "target")
    nodes = placed.select(
        F.col("pond_id").alias("node_id"), "x", "y", "surface_elevation", F.lit(0.0).alias("contributing_area"), F.lit("water_body").alias("node_type"), F.col("area_m2").alias("wb_area_m2"), F.col("volume").alias("wb_volume_m3"),
        F.col("depth").alias("wb_max_depth"), F.col("orifice").alias("wb_orifice_diam_m"), F.col("weir_crest").alias("wb_weir_crest_m"), F.col("curve").alias("wb_curve"), F.lit(False).alias("wb_closed_basin"),
    )
    far = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    links = placed.select(F.col("pond_id").alias("u"), F.col("target").alias("v"), F.concat(F.col("pond_id").cast("string"), F.lit("-connector")).alias("id"), F.lit("pond_connector").alias("edge_type"), far.alias("length"))
    out = _edges(_nodes(n, nodes), links)
    taken = won.join(claimed, ["pond_id", "target"], "left_semi").select(F.col("target").alias("sub_id"), "pond_id")
    out = out.with_nodes(ponds.moved_areas(out.nodes, taken).select(*out.nodes.columns))
    if n.subs is None:
        return out
    return out.with_subs(n.subs.join(taken.withColumnsRenamed({"sub_id": "outlet_id", "pond_id": "into"}), "outlet_id", "left").withColumn("outlet_id", F.coalesce("into", "outlet_id")).select(*n.subs.columns))


def elevation(n: Network, p: Parameters) -> Network:
    """Surface elevations of the grid, in gaps those of the nearest cell with data; chambers lie three metres under them."""
    nodes = n.nodes
    if (grid := _grid(n)) is not None:
        cells, size = grid
        z = raster.sample(nodes, cut(raster.fill_gaps(cells)), size).select("node_id", F.col("value").alias("surface_elevation")).where("surface_elevation is not null")
        mean = cells.agg(F.avg("value").alias("mean"))
        nodes = _set(nodes, "node_id", z, "surface_elevation").crossJoin(F.broadcast(mean)).withColumn("surface_elevation", F.coalesce("surface_elevation", "mean")).drop("mean")
    floor = F.when(F.col("node_type") == "water_body", F.col("surface_elevation") - F.col("wb_max_depth")).otherwise(F.col("surface_elevation") - CHAMBER)
    return n.with_nodes(nodes.withColumn("chamber_floor_elevation", floor).select(*n.nodes.columns))


def both_ways(n: Network, p: Parameters) -> Network:
    """Streets in both directions, rivers downhill, connectors from the pond."""
    rivers, rest = n.edges.where("edge_type = 'river'"), n.edges.where("edge_type not in ('pipe', 'river')")
    return n.with_edges(net.double_directed(_pipes(n)).unionByName(net.orient_downhill(rivers, n.nodes)).unionByName(rest))


def fix_geometries(n: Network, p: Parameters) -> Network:
    e = _both(_lines(n), n.nodes, "x", "y").withColumnsRenamed({"u_x": "ux", "u_y": "uy", "v_x": "vx", "v_y": "vy"})
    return n.with_edges(net.fix_geometry(e).select(*n.edges.columns))


def no_crossings(n: Network, p: Parameters) -> Network:
    """Pipes that cross a river go; their nodes stay."""
    e = _both(n.edges, n.nodes, "x", "y").withColumnsRenamed({"u_x": "ax", "u_y": "ay", "v_x": "bx", "v_y": "by"})
    rivers = _segments(_lines(n.with_edges(n.edges.where("edge_type = 'river'"))))
    hit = spatial.crossing(e.where("edge_type = 'pipe'").select("id", "ax", "ay", "bx", "by"), rivers, p.subcatchments.max_street_length * 2)
    return n.with_edges(n.edges.join(hit, "id", "left_anti"))


def surface_slope(n: Network, p: Parameters) -> Network:
    e = _both(n.edges, n.nodes, "surface_elevation")
    return n.with_edges(e.withColumn("surface_slope", (F.col("u_surface_elevation") - F.col("v_surface_elevation")) / F.nullif("length", F.lit(0.0))).select(*n.edges.columns))


def slope_cost(n: Network, p: Parameters) -> Network:
    return n.with_edges(n.edges.withColumn("chahinian_slope", numeric.slope_cost(F.col("surface_slope"))))


def weights(n: Network, p: Parameters) -> Network:
    """Scaled shares of the parameter columns between their bounds, summed; the bounds are one row."""
    t = p.topology
    e = n.edges.drop("contributing_area", "weight").join(n.nodes.select(F.col("node_id").alias("v"), "contributing_area"), "v")
    bounds = e.agg(*[f(c).alias(f"{c}_{k}") for c in t.weights for k, f in (("lo", F.min), ("hi", F.max))])
    parts = [numeric.scaled(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), t.exponent[c], t.scaling[c]) for c in t.weights]
    return n.with_edges(e.crossJoin(F.broadcast(bounds)).withColumn("weight", sum(parts[1:], parts[0])).select(*n.edges.columns))


def identify_outfalls(n: Network, p: Parameters) -> Network:
    """Sinks at rivers, water bodies and dummies with the connectors that lead there, and intakes of ponds where they are asked for."""
    rivers = _segments(_lines(n.with_edges(n.edges.where("edge_type = 'river'"))))
    grid, footprints = _grid(n), None
    if p.outfalls.online_pond_intake and "basins" in n.meta:
        storages = n.nodes.where("node_type = 'water_body'").select(F.col("node_id").alias("pond_id"), "x", "y", F.col("wb_area_m2").alias("area_m2"))
        footprints = outfalls.storage_basins(storages, n.meta["basins"], p.outfalls)
    sinks, links = outfalls.identify(n.nodes, n.edges, rivers, p.outfalls, n.meta.get("waters"), grid[0] if grid else None, grid[1] if grid else 1, footprints)
    out = _edges(_nodes(n, sinks), links)
    z = n.nodes.select(F.col("node_id").alias("u"), F.col("surface_elevation").alias("su"), F.col("chamber_floor_elevation").alias("cu"))
    unknown = links.where("not pond_intake").join(z, "u").groupBy(F.col("v").alias("node_id")).agg(F.min("su").alias("low_s"), F.min("cu").alias("low_c"))
    nodes = out.nodes.join(unknown, "node_id", "left").withColumn("surface_elevation", F.coalesce("surface_elevation", "low_s")).withColumn("chamber_floor_elevation", F.coalesce("chamber_floor_elevation", "low_c"))
    return out.with_nodes(nodes.select(*n.nodes.columns))


def derive(n: Network, p: Parameters) -> Network:
    """Of the streets those of the turn-aware forest to the outfalls stay; rivers, connectors and outfalls are kept beside it."""
    pipes, rest = _pipes(n), n.edges.where("edge_type <> 'pipe'")
    roots = n.edges.where("edge_type = 'outfall'").select(F.col("u").alias("node")).unionByName(n.nodes.where("node_type like '%outfall'").select(F.col("node_id").alias("node")))
    roots = roots.unionByName(n.edges.where("edge_type = 'river'").select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    f = graph.turn_forest(pipes.select("u", "v", "weight"), n.nodes, roots, p.topology.angle_scaling)
    kept = f.where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))
    one = pipes.join(kept, ["u", "v"], "left_semi").dropDuplicates(["u", "v"]).select(*n.edges.columns)
    at = f.select(F.col("node").alias("u"))
    rest = rest.where("edge_type <> 'outfall'").unionByName(rest.where("edge_type = 'outfall'").join(at, "u", "left_semi").select(*n.edges.columns))
    return n.with_edges(one.unionByName(rest)).drop_isolated()


def connect_components(n: Network, p: Parameters) -> Network:
    """Pipe components within reach are joined by trunks; each is left at its outfalls' streets, else at its lowest node."""
    if not p.trunks.enabled:
        return n
    pipes = _pipes(n)
    part = cut(graph.components(pipes.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    z = n.nodes.select(F.col("node_id").alias("node"), "surface_elevation")
    low = part.join(z, "node").groupBy("root").agg(F.min(F.struct("surface_elevation", "node")).alias("m")).select("root", "m.node")
    out = part.join(n.edges.where("edge_type = 'outfall'").select(F.col("u").alias("node")).distinct(), "node").select("root", "node")
    sources = out.unionByName(low.join(out.select("root").distinct(), "root", "left_anti"))
    t = outfalls.trunk_bridges(part, sources, n.nodes, p.trunks.max_trunk_length_m)
    name = F.concat(F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"), F.lit("-trunk"))
    return _edges(n, t.select("u", "v", name.alias("id"), F.lit("pipe").alias("edge_type"), F.col("distance").alias("length"), F.lit(p.trunks.placeholder_diameter_m).alias("diameter"), F.lit(True).alias("is_trunk")))


def break_intake_cycles(n: Network, p: Parameters) -> Network:
    intakes = n.edges.where("pond_intake")
    closed = ponds.intake_cycles(intakes.select("u", "v"), n.edges.where("not coalesce(pond_intake, false)").select("u", "v"))
    bad = intakes.join(closed, ["u", "v"], "left_semi").select("id")
    return n.with_edges(n.edges.join(bad, "id", "left_anti"))


def pipes(n: Network, p: Parameters) -> Network:
    sized = cut(design.pipe_by_pipe(_pipes(n).select("u", "v", "length"), n.nodes, p.hydraulics))
    j = n.edges.join(sized.select("u", "v", F.lit("pipe").alias("edge_type"), F.col("diameter").alias("d"), F.col("cost_usd").alias("c")), ["u", "v", "edge_type"], "left")
    return n.with_edges(j.withColumn("diameter", F.coalesce("d", "diameter")).withColumn("cost_usd", F.coalesce("c", "cost_usd")).select(*n.edges.columns))


def drops(n: Network, p: Parameters) -> Network:
    """A small fall at the lower end of each pipe that falls at all."""
    e = _both(n.edges, n.nodes, "surface_elevation")
    d = design.manhole_drop(F.col("u_surface_elevation") - F.col("v_surface_elevation"), p.hydraulics)
    return n.with_edges(e.withColumn("out_offset", F.when(F.col("edge_type") == "pipe", d).otherwise(F.col("out_offset"))).select(*n.edges.columns))


def _flows(n: Network) -> DataFrame:
    """(node, total): the area that drains to each node, along one edge out of each."""
    one = n.edges.groupBy(F.col("u").alias("node")).agg(F.min(F.struct(F.col("edge_type") == "outfall", "v")).alias("m")).select("node", F.col("m.v").alias("next"))
    return graph.accumulate(n.nodes.select(F.col("node_id").alias("node"), F.coalesce("contributing_area", F.lit(0.0)).alias("amount")).join(one, "node", "left"))


def river_channels(n: Network, p: Parameters) -> Network:
    """Width and depth of rivers by what drains to their upper end; outfall connectors get the diameter of the pipes above, and a higher start where their sink lies higher."""
    z = n.nodes.select(F.col("node_id").alias("node"), F.col("surface_elevation").alias("z"))
    c = design.channels(_flows(n).join(z, "node"), p.channels).select(F.col("node").alias("u"), F.col("width").alias("w"), F.col("depth").alias("d"))
    river = F.col("edge_type") == "river"
    e = n.edges.join(c, "u", "left").withColumn("channel_width", F.when(river, F.col("w")).otherwise(F.col("channel_width"))).withColumn("channel_depth", F.when(river, F.col("d")).otherwise(F.col("channel_depth"))).drop("w", "d")
    floor = n.nodes.select("node_id", F.col("chamber_floor_elevation").alias("z"))
    links = n.edges.where("edge_type = 'outfall'").select("id", "u", "v").join(floor.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(floor.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v")
    shaped_ = design.connector_geometry(links, _pipes(n).select("v", "diameter"))
    return n.with_edges(_set(e.select(*n.edges.columns), "id", shaped_, "diameter", "in_offset"))


def outfall_slope(n: Network, p: Parameters) -> Network:
    """Too steep outfalls get longer; sinks that lie too high are lowered."""
    floor = n.nodes.select("node_id", F.col("chamber_floor_elevation").alias("z"))
    links = n.edges.where("edge_type = 'outfall' and not coalesce(pond_intake, false)").select("id", "u", "v", "length")
    links = links.join(floor.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(floor.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v").where("zu is not null and zv is not null")
    s = cut(design.outfall_slopes(links, p.hydraulics))
    low = s.groupBy(F.col("v").alias("node_id")).agg(F.min("sink_invert").alias("chamber_floor_elevation"))
    return n.with_edges(_set(n.edges, "id", s.select("id", "length"), "length")).with_nodes(_set(n.nodes, "node_id", low, "chamber_floor_elevation"))


def pond_outlets(n: Network, p: Parameters) -> Network:
    """Each pond connector becomes an outlet junction with orifice, weir and outflow; ponds that can't drain are closed, those that lost their connector go."""
    storages = n.nodes.where("node_type = 'water_body'")
    if not storages.take(1):
        return n
    link = n.edges.where("edge_type = 'pond_connector'").groupBy(F.col("u").alias("pond_id")).agg(F.min("v").alias("anchor"))
    rivers = _segments(_lines(n.with_edges(n.edges.where("edge_type = 'river'"))))
    w = storages.select(F.col("node_id").alias("pond_id"), "x", "y", F.col("surface_elevation").alias("top"), F.col("wb_max_depth").alias("depth"), F.col("wb_area_m2").alias("area_m2"), F.col("wb_orifice_diam_m").alias("orifice"), F.col("wb_weir_crest_m").alias("weir_crest"))
    w = cut(w.join(link, "pond_id"))
    floor = n.nodes.select("node_id", "x", "y", F.col("chamber_floor_elevation").alias("invert"), "node_type")
    ends = n.edges.where("edge_type = 'outfall'").select(F.col("u").alias("node")).unionByName(n.nodes.where("node_type like '%outfall'").select(F.col("node_id").alias("node"))).distinct()
    drained = graph.reach(n.edges.where("edge_type <> 'pond_connector'"), ends, backwards=True).select(F.col("node").alias("node_id"))
    free = floor.where("coalesce(node_type, '') not in ('water_body', 'outlet_junction')").join(drained, "node_id", "left_semi")
    near = ponds.drainable_anchors(w, free, rivers, p.ponds.downstream_search_max_m)
    canal = spatial.nearest_lines(w.select(F.col("pond_id").alias("node_id"), "x", "y"), rivers, p.ponds.downstream_search_max_m).select(F.col("node_id").alias("pond_id"), F.col("distance").alias("canal_dist"), F.col("x").alias("canal_x"), F.col("y").alias("canal_y"))
    if (grid := _grid(n)) is not None:
        stage = raster.at_cell(canal.select("pond_id", F.col("canal_x").alias("x"), F.col("canal_y").alias("y")), grid[0], grid[1], "pond_id").withColumnRenamed("value", "canal_stage")
        canal = canal.join(stage, "pond_id", "left")
    else:
        canal = canal.withColumn("canal_stage", F.lit(None).cast("double"))
    at = floor.select(F.col("node_id").alias("anchor"), F.col("invert").alias("anchor_invert"), F.col("node_type").alias("anchor_type"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    to = floor.select(F.col("node_id").alias("near_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    t = w.join(at, "anchor").join(near, "pond_id", "left").join(to, "near_id", "left").join(canal, "pond_id", "left")
    t = cut(ponds.outlet_tiers(t, p.ponds))
    nodes, edges = ponds.outlet_links(t, p.ponds)
    deep = t.select(F.col("pond_id").alias("node_id"), F.col("depth").alias("wb_max_depth"), (F.col("top") - F.col("depth")).alias("chamber_floor_elevation"), (F.col("tier") == "closed").alias("wb_closed_basin"))
    lost = storages.join(w.select(F.col("pond_id").alias("node_id")), "node_id", "left_anti").select("node_id")
    out = _edges(_nodes(n.with_edges(n.edges.where("edge_type <> 'pond_connector'")), nodes), edges)
    out = out.with_nodes(_set(out.nodes.join(lost, "node_id", "left_anti"), "node_id", deep, "wb_max_depth", "chamber_floor_elevation", "wb_closed_basin"))
    out = out.with_nodes(cut(out.nodes)).with_edges(cut(out.edges))
    heads = out.nodes.where("node_type = 'water_body' and not coalesce(wb_closed_basin, false)").select(F.col("node_id").alias("pond_id"), F.col("surface_elevation").alias("head"))
    last = out.nodes.join(out.edges.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_anti").where("chamber_floor_elevation is not null")
    terminals = last.select(F.col("node_id").alias("node"), F.col("chamber_floor_elevation").alias("invert"), F.col("node_type").isin("river_outfall", "water_body_outfall").alias("is_stage"))
    fine = ponds.viable(out.edges.select("u", "v", F.coalesce("length", F.lit(0.0)).alias("length")), heads, terminals, p.ponds)
    closed = heads.join(fine, "pond_id", "left_anti").select(F.col("pond_id").alias("node_id"), F.lit(True).alias("wb_closed_basin"))
    return out.with_nodes(_set(out.nodes, "node_id", closed, "wb_closed_basin"))


def _pond_of(n: Network) -> DataFrame:
    """(node, pond_id): where ponds' outflows end; of several ponds the smaller id."""
    out = n.edges.where("edge_type = 'pond_outflow'").select("u", "v")
    inn = n.edges.where("edge_type = 'orifice'").select(F.col("v").alias("u"), F.col("u").alias("pond_id"))
    return out.join(inn, "u").groupBy(F.col("v").alias("node")).agg(F.min("pond_id").alias("pond_id"))


def route_into_ponds(n: Network, p: Parameters) -> Network:
    """Pipes that end where a pond's outflow does become its inflows, but for those that carry another pond's water."""
    at = cut(_pond_of(n))
    if not at.take(1):
        return n
    carried = ponds.carriers(n.edges.where("edge_type in ('pipe', 'pond_outflow', 'river', 'outfall')").select("u", "v"), at.select("node"))
    z = n.nodes.select("node_id", F.col("chamber_floor_elevation").alias("z"), F.col("surface_elevation").alias("top"), "x", "y")
    feed = _pipes(n).join(at.withColumnRenamed("node", "v"), "v").join(carried.withColumnRenamed("node", "u"), "u", "left_anti")
    feed = feed.join(z.select(F.col("node_id").alias("u"), F.col("z").alias("u_invert"), F.struct("x", "y").alias("from_")), "u").join(z.select(F.col("node_id").alias("v"), F.col("z").alias("d_invert")), "v")
    feed = feed.join(z.select(F.col("node_id").alias("pond_id"), F.col("z").alias("p_invert"), F.col("top").alias("p_top"), F.struct("x", "y").alias("to_")), "pond_id")
    t = cut(ponds.inflow_tiers(feed.withColumn("was", F.col("id")), p.ponds))
    new = t.withColumn("v", F.col("pond_id")).withColumn("edge_type", F.lit("pond_inflow")).withColumn("geometry", F.array("from_", "to_")).withColumn("length", geo.length(F.col("geometry")))
    new = new.withColumn("id", F.concat(F.col("u").cast("string"), F.lit("-"), F.col("pond_id").cast("string"), F.lit("-pond_inflow")))
    low = t.groupBy(F.col("pond_id").alias("node_id")).agg(F.min("pond_invert").alias("chamber_floor_elevation"), F.max(F.col("p_top") - F.col("pond_invert")).alias("wb_max_depth"))
    out = n.with_edges(n.edges.join(t.select(F.col("was").alias("id")), "id", "left_anti").unionByName(_with(new, EDGES)))
    return out.with_nodes(_set(n.nodes, "node_id", low, "chamber_floor_elevation", "wb_max_depth"))


def _drained(n: Network) -> DataFrame:
    """(sub_id, pond_id): subcatchments whose outlet drains to a pond, the nearest by hops."""
    storages = n.nodes.where("node_type = 'water_body'").select(F.col("node_id").alias("node"))
    parts = ponds.partition(n.edges, storages)
    return n.subs.join(parts.select(F.col("node").alias("outlet_id"), F.col("source").alias("pond_id")), "outlet_id").select("sub_id", "pond_id")


def _centres(n: Network) -> DataFrame:
    """(sub_id, x, y): the middle of each subcatchment's cells."""
    size = float(n.meta["size"])
    return n.meta["labels"].groupBy(F.col("id").alias("sub_id")).agg(((F.avg("col_") + 0.5) * size).alias("x"), ((F.avg("row_") + 0.5) * size).alias("y"))


def _moved(n: Network, moves: DataFrame) -> Network:
    """Subcatchments drain to the ponds they moved to; their outlets' areas go with them."""
    m = cut(moves)
    subs = n.subs.join(m.withColumnRenamed("pond_id", "into"), "sub_id", "left").withColumn("outlet_id", F.coalesce("into", "outlet_id")).select(*n.subs.columns)
    at = n.subs.join(m, "sub_id").select(F.col("outlet_id").alias("sub_id"), "pond_id").dropDuplicates(["sub_id"])
    return n.with_subs(subs).with_nodes(ponds.moved_areas(n.nodes, at).select(*n.nodes.columns))


def _has_ponds(n: Network) -> bool:
    return n.subs is not None and "labels" in n.meta and bool(n.nodes.where("node_type = 'water_body'").take(1))


def reroute_subs(n: Network, p: Parameters) -> Network:
    """Subcatchments that drain to no pond go to the nearest that still has room."""
    if not _has_ponds(n):
        return n
    subs = cut(_centres(n).join(n.subs.select("sub_id", "area"), "sub_id"))
    storages = n.nodes.where("node_type = 'water_body'").select(F.col("node_id").alias("pond_id"), "x", "y", F.col("wb_volume_m3").alias("volume"))
    rivers = _segments(_lines(n.with_edges(n.edges.where("edge_type = 'river'"))))
    return _moved(n, ponds.capacity_fill(ponds.reroute_offers(subs, storages, cut(_drained(n)), rivers, p.ponds)))


def enclosed_gaps(n: Network, p: Parameters) -> Network:
    """Subcatchments that lie in a gap of a pond's catchment go to that pond."""
    if not _has_ponds(n):
        return n
    size = float(n.meta["size"])
    drained = cut(_drained(n))
    labels = n.meta["labels"].join(drained.withColumnRenamed("sub_id", "id"), "id").select("row_", "col_", F.col("pond_id").alias("id"))
    at = _centres(n).join(drained.select("sub_id"), "sub_id", "left_anti").select("sub_id", F.floor(F.col("y") / size).cast("long").alias("row_"), F.floor(F.col("x") / size).cast("long").alias("col_"))
    return _moved(n, ponds.gap_reroutes(cut(labels), at, max(1, round(p.ponds.enclosed_gap_close_m / size))))


def resize_pipes(n: Network, p: Parameters) -> Network:
    """Pipes grow where ponds and rerouting bring more water."""
    some = n.edges.where("edge_type in ('pipe', 'pond_inflow') and diameter is not null and length > 0")
    z = n.nodes.select("node_id", F.col("chamber_floor_elevation").alias("z"))
    e = some.join(z.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(z.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v").where("zu is not null and zv is not null")
    fall = (F.col("zu") + F.coalesce("in_offset", F.lit(0.0)) - F.col("zv") - F.coalesce("out_offset", F.lit(0.0))) / F.col("length")
    flows = _flows(n).select(F.col("node").alias("u"), (F.col("total") * p.hydraulics.precipitation / 3600).alias("q"))
    one = e.select("id", "u", "v", "diameter", fall.alias("slope")).dropDuplicates(["u"])
    return n.with_edges(_set(n.edges, "id", design.resize(one, flows, p.hydraulics).select("id", "diameter"), "diameter"))


def resize_orifices(n: Network, p: Parameters) -> Network:
    """Orifices grow with the inflow, as far as the pipes below them carry it."""
    flows = _flows(n).select(F.col("node").alias("pond_id"), (F.col("total") * p.hydraulics.precipitation / 3600).alias("q_in"))
    w = n.nodes.where("node_type = 'water_body'").select(F.col("node_id").alias("pond_id"), F.col("wb_orifice_diam_m").alias("orifice"), F.col("wb_max_depth").alias("depth"), F.col("wb_closed_basin").alias("closed"))
    caps = ponds.pipe_caps(_pond_of(n), _pipes(n), n.nodes)
    new = cut(ponds.resized_orifices(w.join(flows, "pond_id").join(caps, "pond_id", "left"), p.ponds))
    e = n.edges.join(new.select(F.col("pond_id").alias("u"), F.lit("orifice").alias("edge_type"), F.col("diameter").alias("grown")), ["u", "edge_type"], "left")
    nodes = _set(n.nodes, "node_id", new.select(F.col("pond_id").alias("node_id"), F.col("diameter").alias("wb_orifice_diam_m")), "wb_orifice_diam_m")
    return n.with_nodes(nodes).with_edges(e.withColumn("orifice_diam_m", F.coalesce("grown", "orifice_diam_m")).select(*n.edges.columns))


def simplify_network(n: Network, p: Parameters) -> Network:
    out = simplify.network(n, p.simplification)
    return out if out is n or n.subs is None else out.with_subs(out.subs.withColumn("sub_id", F.col("outlet_id")))


def orphan_subs(n: Network, p: Parameters) -> Network:
    """Subcatchments whose outlet reaches no outfall take that of the neighbour with the longest border; without known cells, or on
    an island, they go."""
    if n.subs is None:
        return n
    from . import emit

    ends = emit.sinks(n.nodes, n.edges).select(F.col("node_id").alias("node"))
    lost = cut(subcatchments.orphans(n.subs, n.edges, ends).select("sub_id"))
    if not lost.take(1):
        return n
    if "labels" not in n.meta:
        return n.with_subs(n.subs.join(lost, "sub_id", "left_anti"))
    touching = cut(raster.borders(n.meta["labels"], "id"))
    found = subcatchments.adopt(n.subs, lost, touching)
    return n.with_subs(n.subs.drop("outlet_id").join(found, "sub_id").select(*n.subs.columns))


def street_channels(n: Network, p: Parameters) -> Network:
    """The surface network over the pipes, if it is asked for."""
    if not p.dual_drainage.enabled:
        return n
    pipes_ = _pipes(n).where("not coalesce(is_trunk, false)")
    up = dual.surface_nodes(n.nodes, pipes_, p.dual_drainage)
    grates = dual.grates(up).withColumn("orifice_type", F.lit("BOTTOM")).withColumn("flap_gate", F.lit("NO"))
    out = _edges(_edges(_nodes(n, up), dual.channels(pipes_, p.dual_drainage)), grates)
    return out if n.subs is None else out.with_subs(dual.rerouted(n.subs, up))


