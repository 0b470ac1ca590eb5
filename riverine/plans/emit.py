"""Rules by which a network becomes sections of a model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric, ponds as fn
from ..params import Ponds


OPEN_CHANNELS = ("river", "pond_outflow", "street_channel")


def pipe_heights(edges: DataFrame) -> DataFrame:
    """(node_id, height): the largest pipe or channel (diameter, channel_depth) at either end."""
    h = F.greatest(F.coalesce("diameter", F.lit(0.0)), F.coalesce("channel_depth", F.lit(0.0)))
    return edges.select(F.explode(F.array("u", "v")).alias("node_id"), h.alias("h")).groupBy("node_id").agg(F.max("h").alias("height"))


def max_depths(nodes: DataFrame, edges: DataFrame, least: float = 0.5, otherwise: float = 3.0) -> DataFrame:
    """node_id, max_depth: ground to invert where that is at least `least`, else `otherwise`; never less than the pipes at it."""
    d = F.col("surface_elevation") - F.col("chamber_floor_elevation")
    own = F.when(d >= least, d).otherwise(otherwise)
    return nodes.join(pipe_heights(edges), "node_id", "left").select("node_id", F.greatest(own, F.coalesce("height", F.lit(0.0))).alias("max_depth"))


def terminal_rivers(edges: DataFrame) -> DataFrame:
    """(node_id): lower ends of rivers from which no edge goes on."""
    return edges.where("edge_type = 'river'").select(F.col("v").alias("node_id")).distinct().join(edges.select(F.col("u").alias("node_id")), "node_id", "left_anti")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of all outfalls: terminal rivers and nodes whose type is one; where that is none, every node without an edge out."""
    typed = nodes.where("node_type in ('dummy_river', 'river_outfall', 'water_body_outfall', 'waste')").select("node_id")
    found = terminal_rivers(edges).unionByName(typed).distinct()
    last = nodes.join(edges.select(F.col("u").alias("node_id")), "node_id", "left_anti").select("node_id")
    some = found.agg(F.count("*").alias("n"))
    return found.unionByName(last.crossJoin(F.broadcast(some)).where("n = 0").select("node_id"))


def link_lengths(edges: DataFrame) -> DataFrame:
    """Edges with the length the model gets: never shorter than their own height (of open channels their depth), a metre, or for
    outfalls five diameters or metres."""
    d = F.coalesce("diameter", F.lit(0.0))
    n = F.when(F.col("edge_type") == "outfall", F.greatest("length", 5 * d, F.lit(5.0))).when(F.col("edge_type").isin(*OPEN_CHANNELS), F.greatest("length", F.coalesce("channel_depth", F.lit(0.0)), F.lit(1.0))).otherwise(F.greatest("length", d, F.lit(1.0)))
    return edges.withColumn("length", n)


def merged_outfalls(edges: DataFrame, outfalls: DataFrame) -> DataFrame:
    """(node_id, n_in, diameter, length) of the stub below outfalls with more than one inlet: as large as all inlets together."""
    area = F.sum(math.pi * F.col("diameter") * F.col("diameter") / 4)
    m = edges.join(outfalls.withColumnRenamed("node_id", "v"), "v", "left_semi").groupBy(F.col("v").alias("node_id")).agg(F.count("*").alias("n_in"), F.greatest(F.sqrt(4 * area / math.pi), F.lit(0.45)).alias("diameter")).where("n_in > 1")
    return m.withColumn("length", F.greatest(5 * F.col("diameter"), F.lit(5.0)))


def feeder_areas(links: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node_id, feeder_area) of sinks: the cross sections of the conduits (v, shape, geom1, geom2) that end there, together."""
    round_, open_ = F.col("shape") == "CIRCULAR", F.col("shape") == "RECT_OPEN"
    area = F.when(round_, math.pi * F.col("geom1") * F.col("geom1") / 4).when(open_, F.col("geom1") * F.col("geom2")).otherwise(0.0)
    return links.join(sinks.select(F.col("node_id").alias("v")), "v", "left_semi").groupBy(F.col("v").alias("node_id")).agg(F.sum(area).alias("feeder_area"))


def one_inlet(links: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, junctions, sinks): an outfall may have one link in and none out.

    Where one (node_id, invert, x, y) has more, a junction `id_merger` takes its
    links (id, u, v, shape, geom1, geom2, length as text ids) at its invert,
    and a stub as large as all of them leads to the outfall, half a metre lower.
    """
    name = sinks.select(F.col("node_id").cast("string").alias("node"), "invert", "x", "y")
    inlets = links.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"))
    outlets = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"))
    many = name.join(inlets, "node", "left").join(outlets, "node", "left").where("coalesce(n_in, 0) > 1 or coalesce(n_out, 0) > 0").select("node", "invert", "x", "y")
    merger = F.concat("node", F.lit("_merger"))
    moved = links
    for end in ("u", "v"):
        moved = moved.join(many.select(F.col("node").alias(end), merger.alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    area = feeder_areas(links.where("shape is not null"), many.select(F.col("node").alias("node_id"))).withColumnRenamed("node_id", "node")
    d = F.greatest(F.sqrt(4 * F.coalesce("feeder_area", F.lit(0.0)) / math.pi), F.lit(0.45))
    stub = many.join(area, "node", "left").select(
        F.concat(merger, F.lit("-"), "node").alias("id"), merger.alias("u"), F.col("node").alias("v"), F.lit("CIRCULAR").alias("shape"), d.alias("geom1"), F.lit(0.0).alias("geom2"), F.greatest(5 * d, F.lit(5.0)).alias("length")
    )
    junctions = many.select(merger.alias("node"), "invert", F.lit(3.0).alias("max_depth"), (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))
    lower = many.select("node", F.lit(0.5).alias("by"))
    out = name.join(lower, "node", "left").select("node", (F.col("invert") - F.coalesce("by", F.lit(0.0))).alias("invert"), "x", "y")
    return moved.unionByName(stub, allowMissingColumns=True), junctions, out


def promoted(conduits: DataFrame, links: DataFrame, inverts: DataFrame, sinks: DataFrame, kept: DataFrame, steepest: float) -> DataFrame:
    """(id, u, v) of stubs (id, u, v, length, in_offset, out_offset) too steep to keep, whose upper end becomes the outfall: it has
    one link in and one out, the outfall one in and none out, and no subcatchment or pond (kept: node) drains to it."""
    n = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    n = n.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))
    c = conduits.join(sinks.select(F.col("node").alias("v")), "v", "left_semi").join(sinks.select(F.col("node").alias("u")), "u", "left_anti").join(kept.select(F.col("node").alias("v")), "v", "left_anti")
    for end in ("u", "v"):
        c = c.join(inverts.select(F.col("node").alias(end), F.col("invert").alias(f"z{end}")), end).join(n.withColumnsRenamed({"node": end, "n_in": f"i{end}", "n_out": f"o{end}"}), end)
    drop = F.col("zu") - F.col("zv")
    slope = (drop + F.coalesce("in_offset", F.lit(0.0)) - F.coalesce("out_offset", F.lit(0.0))) / F.col("length")
    return c.where((F.col("length") > 0) & (slope > steepest) & (drop > 0) & (F.col("iu") == 1) & (F.col("ou") == 1) & (F.col("iv") == 1) & (F.col("ov") == 0)).select("id", "u", "v")


def dummy_inverts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the inverts of dummy rivers set a diameter, 0.3 m at least, under the invert that drains to them (of several the last by id)."""
    z = nodes.select(F.col("node_id").alias("u"), F.col("chamber_floor_elevation").alias("zu")).where("zu is not null")
    drop = F.greatest(F.coalesce("diameter", F.lit(0.0)), F.lit(0.3))
    low = edges.where("edge_type = 'outfall'").join(z, "u").groupBy(F.col("v").alias("node_id")).agg(F.max_by(F.col("zu") - drop, "id").alias("low"))
    dummy = F.coalesce(F.col("node_type") == "dummy_river", F.lit(False))
    return nodes.join(low, "node_id", "left").withColumn("chamber_floor_elevation", F.when(dummy, F.coalesce("low", "chamber_floor_elevation")).otherwise(F.col("chamber_floor_elevation"))).drop("low")


def storages(ponds: DataFrame, p: Ponds) -> DataFrame:
    """Ponds (node_id, chamber_floor_elevation, wb_max_depth, wb_curve, wb_embankment_elev, wb_closed_basin, wb_area_m2) with the
    max_depth and curve that the model gets, its curve's name and what stands over the top or seeps.

    Where the embankment lies higher than the pond is deep, curve and depth go
    on up to it, by 2 m at most.
    """
    has = F.coalesce(F.size("wb_curve") >= 2, F.lit(False))
    top = F.when(has, F.element_at("wb_curve", -1)["depth"]).otherwise(0.0)
    deep = F.greatest(F.coalesce("wb_max_depth", top), top, F.lit(1.0))
    bank = F.when(F.col("wb_embankment_elev").isNotNull(), F.least(F.col("wb_embankment_elev") - F.col("chamber_floor_elevation"), deep + 2))
    up = F.coalesce(has & (bank > deep + 0.05), F.lit(False))
    closed = F.coalesce("wb_closed_basin", F.lit(False))
    name = F.concat(F.col("node_id").cast("string"), F.lit("_curve"))
    return ponds.select(
        "node_id",
        F.coalesce("chamber_floor_elevation", F.lit(-1.0)).alias("invert"),
        F.when(up, bank).otherwise(deep).alias("max_depth"),
        F.when(has, F.when(up, fn.extend(F.col("wb_curve"), bank, p)).otherwise(F.col("wb_curve"))).alias("curve"),
        F.when(has, F.lit("TABULAR")).otherwise("FUNCTIONAL").alias("kind"),
        F.when(has, name).otherwise(F.coalesce("wb_area_m2", F.lit(500.0)).cast("string")).alias("coefficient"),
        F.when(closed, F.lit(float(p.closed_basin_sur_depth_m))).otherwise(float(p.open_basin_sur_depth_m)).alias("sur_depth"),
        *[F.when(closed, F.lit(float(v))).otherwise(0.0).alias(c) for c, v in (("psi", p.closed_basin_psi_mm), ("ksat", p.closed_basin_ksat_mm_hr), ("imd", p.closed_basin_imd))],
    )


def _id(c: str) -> Column:
    return F.col(c).cast("string")


def storage_rows(s: DataFrame) -> DataFrame:
    return s.select("node_id", _id("node_id").alias("Name"), F.col("invert").alias("InvertElev"), F.col("max_depth").alias("MaxDepth"), F.lit(0.0).alias("InitDepth"), F.col("kind").alias("StorageCurve"), F.col("coefficient").alias("Coefficient"), F.lit(0.0).alias("Exponent"), F.lit(0.0).alias("Constant"), F.col("sur_depth").alias("SurDepth"), F.lit(0.0).alias("EvapFrac"), F.col("psi").alias("Psi"), F.col("ksat").alias("Ksat"), F.col("imd").alias("IMD"))


def curve_rows(s: DataFrame) -> DataFrame:
    """One row per point of a stage-area curve; the first says what kind it is."""
    p = s.where("curve is not null").select("node_id", F.posexplode("curve").alias("i", "c"))
    return p.select((F.col("node_id") * 100 + F.col("i")).alias("ord"), F.concat(_id("node_id"), F.lit("_curve")).alias("Name"), F.when(F.col("i") == 0, F.lit("STORAGE")).otherwise("").alias("Type"), F.col("c.depth").alias("X"), F.col("c.area").alias("Y"))


def orifice_rows(edges: DataFrame) -> DataFrame:
    """Pond outlets (one way, at the side) and street grates, whose own kind and flap gate count."""
    e = edges.where("edge_type = 'orifice'")
    return e.select("id", F.col("id").alias("Name"), _id("u").alias("InletNode"), _id("v").alias("OutletNode"), F.coalesce("orifice_type", F.lit("SIDE")).alias("OrificeType"), F.coalesce("orifice_offset", F.lit(0.0)).alias("CrestHeight"), F.coalesce("orifice_cd", F.lit(0.65)).alias("DischCoeff"), F.coalesce("flap_gate", F.lit("YES")).alias("FlapGate"))


def weir_rows(edges: DataFrame, p: Ponds, units: str = "LPS") -> DataFrame:
    e = edges.where("edge_type = 'weir'")
    return e.select("id", F.col("id").alias("Name"), _id("u").alias("InletNode"), _id("v").alias("OutletNode"), F.lit("TRANSVERSE").alias("WeirType"), F.coalesce("weir_crest_m", F.lit(1.0)).alias("CrestHeight"), numeric.weir_coefficient(p.weir_cw, F.lit(units)).alias("DischCoeff"), F.lit("YES").alias("FlapGate"), F.lit(0.0).alias("EndCon"), F.lit(0.0).alias("EndCoeff"))


def sections(edges: DataFrame, p: Ponds) -> DataFrame:
    """(id, Link, Shape, Geom1, Geom2): open channels, weirs a tenth of their crest high, orifices and pipes of 0.15 m at least;
    outfalls no narrower than the widest pipe at their upper end."""
    pipe = edges.where("edge_type = 'pipe' and diameter > 0")
    widest = pipe.select(F.explode(F.array("u", "v")).alias("u"), "diameter").groupBy("u").agg(F.max("diameter").alias("wide"))
    e = edges.join(widest, "u", "left")
    kind = F.col("edge_type")
    d = F.greatest(F.coalesce("diameter", F.lit(0.3)), F.lit(0.15))
    open_ = kind.isin(*OPEN_CHANNELS)
    one = F.when(kind == "orifice", F.coalesce("orifice_diam_m", F.lit(0.3))).when(kind == "weir", F.coalesce("weir_crest_m", F.lit(1.0)) * 0.1).when(open_, F.coalesce("channel_depth", F.lit(1.0))).when(kind == "outfall", F.greatest(d, F.coalesce("wide", F.lit(0.0)))).otherwise(d)
    two = F.when(kind == "weir", F.coalesce("weir_length_m", F.lit(float(p.weir_length_m)))).when(open_, F.coalesce("channel_width", F.lit(2.0))).otherwise(0.0)
    return e.select("id", F.col("id").alias("Link"), F.when(open_ | (kind == "weir"), F.lit("RECT_OPEN")).otherwise("CIRCULAR").alias("Shape"), one.alias("Geom1"), two.alias("Geom2"))


def conduit_rows(edges: DataFrame) -> DataFrame:
    """Pipes, rivers, channels and outfalls: rough open channels (0.035 unless rougher than 0.02), smooth pipes (0.01 unless smoother than 0.02)."""
    open_ = F.col("edge_type").isin(*OPEN_CHANNELS)
    rough = F.when(open_, F.when(F.col("roughness") > 0.02, F.col("roughness")).otherwise(0.035)).otherwise(F.when(F.col("roughness") < 0.02, F.col("roughness")).otherwise(0.01))
    links = link_lengths(edges.where(~F.col("edge_type").isin("orifice", "weir")))
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return links.select("id", F.col("id").alias("Name"), _id("u").alias("InletNode"), _id("v").alias("OutletNode"), F.col("length").alias("Length"), rough.alias("Roughness"), zero("in_offset").alias("InOffset"), zero("out_offset").alias("OutOffset"), F.lit(0.0).alias("InitFlow"), F.when(open_, F.lit(0.0)).otherwise(1e10).alias("MaxFlow"))


def loss_rows(edges: DataFrame) -> DataFrame:
    """Pond outflows let nothing back."""
    return edges.where("edge_type = 'pond_outflow'").select("id", F.col("id").alias("Link"), F.lit("YES").alias("FlapGate"))


def subcatchment_rows(subs: DataFrame, gage: str) -> DataFrame:
    """Named subcatchments (name, outlet_id, area_ha, rc, width, slope)."""
    return subs.select(F.col("name").alias("ord"), F.col("name").alias("Name"), F.lit(gage).alias("Raingage"), _id("outlet_id").alias("Outlet"), F.col("area_ha").alias("Area"), F.col("rc").alias("PercImperv"), F.col("width").alias("Width"), F.col("slope").alias("PercSlope"))


def raingage_row(rain: DataFrame, station: str, file: str, unit: str = "MM", date: str = "date") -> DataFrame:
    """The gauge of a rain series, its interval the most frequent step."""
    from ..functions.storms import interval_minutes
    from ..functions.text import hours_minutes

    step = interval_minutes(rain, date)
    return step.select("rain_gage", F.lit(station).alias("Name"), F.lit("INTENSITY").alias("Format"), hours_minutes(F.col("minutes")).alias("Interval"), F.lit(1.0).alias("SCF"), F.lit("FILE").alias("Source"), F.lit(file).alias("Filename"), F.lit(station).alias("Station"), F.lit(unit).alias("Units"))


def polygon_rows(rings: DataFrame) -> DataFrame:
    """One row per corner of each subcatchment's ring (name, ring)."""
    p = rings.select("name", F.posexplode("ring").alias("i", "p"))
    return p.select(F.concat("name", F.lit("/"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("ord"), F.col("name").alias("Subcatchment"), F.col("p.x").alias("X"), F.col("p.y").alias("Y"))


def map_row(nodes: DataFrame) -> DataFrame:
    """DIMENSIONS: the nodes' box with three decimals."""
    box = nodes.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    return box.select(F.lit(0).alias("n"), F.lit("DIMENSIONS").alias("Key"), F.format_string("%.3f %.3f %.3f %.3f", "a", "b", "c", "d").alias("Value"))


def outfall_rows(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Name, InvertElev: a metre below the node, -1 where nothing is known."""
    return nodes.join(sinks, "node_id", "left_semi").select("node_id", F.col("node_id").cast("string").alias("Name"), (F.coalesce("chamber_floor_elevation", F.lit(0.0)) - 1).alias("InvertElev"))
