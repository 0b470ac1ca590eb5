"""From lines and an elevation grid to a sized network and its model text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..network import Network
from ..operators import graph, subcatchments
from ..operators.iterate import cut
from ..params import Parameters
from ..sources import readers
from . import emit, inp, steps
from .pipeline import build_pipeline


def prepare(spark: SparkSession, lines: DataFrame, cells: DataFrame, size: float, **meta) -> Network:
    """A network of lines (geometry, highway, lanes, edge_type) that knows its elevation grid (row_, col_, value) of a cell size, and
    what else the steps take from meta."""
    nodes, edges = readers.graph_from_lines(lines)
    edges = edges.withColumn("id", F.lit(None).cast("string")).withColumn("key", F.lit(0))
    return Network(nodes, edges, meta={"cells": cells, "size": float(size), **meta})


def document(spark: SparkSession, n: Network, title: str = "", params: Parameters | None = None, rain: DataFrame | None = None, station: str = "1", rain_file: str = "rain.dat") -> DataFrame:
    """The model's lines, section by section.

    Sinks become outfalls with one link in and none out (more are gathered by a
    junction and a stub; clean stubs too steep to keep become outfalls
    themselves), ponds storages with their curves, all other nodes junctions.
    """
    p = params or Parameters()
    n = steps.shaped(n)
    nodes = emit.dummy_inverts(n.nodes, n.edges).withColumn("chamber_floor_elevation", F.coalesce("chamber_floor_elevation", F.col("surface_elevation") - steps.CHAMBER))
    nodes = cut(nodes.join(emit.max_depths(nodes, n.edges), "node_id"))
    pond = F.coalesce(F.col("node_type") == "water_body", F.lit(False))
    outlet = F.coalesce(F.col("node_type") == "outlet_junction", F.lit(False))
    ends = emit.sinks(nodes, n.edges).select("node_id")
    sinks = nodes.join(ends, "node_id", "left_semi").where(~pond)
    storages = cut(emit.storages(nodes.where(pond), p.ponds))
    inner = nodes.where(~pond).join(ends, "node_id", "left_anti")
    junctions = inner.select(F.col("node_id").cast("string").alias("node"), F.col("chamber_floor_elevation").alias("invert"), F.when(outlet, 3.0).otherwise(F.greatest("max_depth", F.lit(0.5))).alias("max_depth"), "x", "y")

    shape = emit.sections(n.edges, p.ponds)
    conduits = emit.conduit_rows(n.edges)
    every = n.edges.select("id", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")).join(shape.select("id", F.col("Shape").alias("shape"), F.col("Geom1").alias("geom1"), F.col("Geom2").alias("geom2")), "id")
    every = every.join(conduits.select("id", F.col("Length").alias("length")), "id", "left").withColumn("shape", F.when(F.col("length").isNotNull(), F.col("shape")))
    low = sinks.select("node_id", (F.coalesce("chamber_floor_elevation", F.lit(0.0)) - 1).alias("invert"), "x", "y")
    links, mergers, outfalls = emit.one_inlet(every, low)
    links, outfalls = cut(links), cut(outfalls)
    junctions = cut(junctions.unionByName(mergers))
    inverts = junctions.select("node", "invert").unionByName(outfalls.select("node", "invert")).unionByName(storages.select(F.col("node_id").cast("string").alias("node"), "invert"))
    # stubs of one_inlet keep 5 diameters; what is promoted loses its conduit and its sink
    kept = nodes.where(pond | outlet).select(F.col("node_id").cast("string").alias("node"))
    if n.subs is not None:
        kept = kept.unionByName(n.subs.select(F.col("outlet_id").cast("string").alias("node")).distinct())
    offsets = conduits.select("id", F.col("InOffset").alias("in_offset"), F.col("OutOffset").alias("out_offset"))
    up = cut(emit.promoted(links.where("length is not null").join(offsets, "id", "left"), links, inverts, outfalls, kept, p.hydraulics.max_outfall_slope))
    risen = junctions.join(up.select(F.col("u").alias("node")), "node", "left_semi").select("node", "invert", "x", "y")
    outfalls = outfalls.join(up.select(F.col("v").alias("node")), "node", "left_anti").unionByName(risen)
    junctions = junctions.join(up.select(F.col("u").alias("node")), "node", "left_anti")
    links = links.join(up, "id", "left_anti")

    ends_of = links.select("id", F.col("u").alias("InletNode"), F.col("v").alias("OutletNode"))
    linked = lambda df: df.drop("InletNode", "OutletNode").join(ends_of, "id")
    stub = links.where("id like '%_merger-%'").select("id", F.col("id").alias("Name"), F.col("u").alias("InletNode"), F.col("v").alias("OutletNode"), F.col("length").alias("Length"), F.lit(0.012).alias("Roughness"), F.lit(0.0).alias("InOffset"), F.lit(0.0).alias("OutOffset"), F.lit(0.0).alias("InitFlow"), F.lit(0.0).alias("MaxFlow"))
    sections = shape.join(ends_of.select("id"), "id", "left_semi").unionByName(links.where("id like '%_merger-%'").select("id", F.col("id").alias("Link"), F.lit("CIRCULAR").alias("Shape"), F.col("geom1").alias("Geom1"), F.lit(0.0).alias("Geom2")))
    places = junctions.select("node", "x", "y").unionByName(outfalls.select("node", "x", "y")).unionByName(nodes.where(pond).select(F.col("node_id").cast("string").alias("node"), "x", "y"))
    out = {
        "JUNCTIONS": (junctions.select("node", F.col("node").alias("Name"), F.col("invert").alias("InvertElev"), F.col("max_depth").alias("MaxDepth")), "node"),
        "OUTFALLS": (outfalls.select("node", F.col("node").alias("Name"), F.col("invert").alias("InvertElev")), "node"),
        "STORAGE": (emit.storage_rows(storages), "node_id"),
        "CURVES": (emit.curve_rows(storages), "ord"),
        "CONDUITS": (linked(conduits).unionByName(stub), "id"),
        "ORIFICES": (linked(emit.orifice_rows(n.edges)), "id"),
        "WEIRS": (linked(emit.weir_rows(n.edges, p.ponds)), "id"),
        "XSECTIONS": (sections, "id"),
        "LOSSES": (emit.loss_rows(n.edges).join(ends_of.select("id"), "id", "left_semi"), "id"),
        "COORDINATES": (places.select("node", F.col("node").alias("Name"), F.col("x").alias("X"), F.col("y").alias("Y")), "node"),
        "MAP": (emit.map_row(nodes), "n"),
    }
    if n.subs is not None:
        named = cut(subcatchments.unique_names(subcatchments.with_outlet(n.subs, n.nodes)))
        out["SUBCATCHMENTS"] = (emit.subcatchment_rows(named, station), "ord")
        out["SUBAREAS"] = (named.select(F.col("name").alias("ord"), F.col("name").alias("Name")), "ord")
        out["INFILTRATION"] = (named.select(F.col("name").alias("ord"), F.col("name").alias("Subcatchment")), "ord")
        if "ring" in n.subs.columns:
            out["Polygons"] = (emit.polygon_rows(named.select("name", "ring")), "ord")
    if rain is not None:
        out["RAINGAGES"] = (emit.raingage_row(rain, station, rain_file), "rain_gage")
    return inp.document(spark, out, title=title)


def synthesise(spark: SparkSession, lines: DataFrame, cells: DataFrame, size: float, params: Parameters | None = None, folder: str | None = None, bare: bool = False, title: str = "", rain: DataFrame | None = None, **meta) -> tuple[Network, DataFrame]:
    """(network, document) of the whole derivation, with ponds where meta holds some; nodes that no outfall is reached from are left out."""
    n = build_pipeline(bare, with_ponds="ponds" in meta).run(prepare(spark, lines, cells, size, **meta), params, folder=folder)
    return n, document(spark, n, title, params, rain)


def components_of(n: Network) -> DataFrame:
    """(node, root) of the weakly connected parts of a network."""
    return graph.components(n.edges.select(F.col("u").alias("a"), F.col("v").alias("b")), n.nodes.select(F.col("node_id").alias("node")))
