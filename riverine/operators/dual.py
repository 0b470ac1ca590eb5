"""Dual drainage: a surface network above the pipes, joined to it by grates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.text import street_width
from ..params import DualDrainage

#: Diameter (m) of a round opening of 0.125 m2, and its discharge coefficient.
GRATE, GRATE_CD = math.sqrt(4 * 0.125 / math.pi), 0.62
SURFACE = 10_000_000_000


def surface_nodes(nodes: DataFrame, pipes: DataFrame, p: DualDrainage) -> DataFrame:
    """A surface node for each node on a pipe, at its place, as deep as the curb."""
    on = pipes.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return nodes.join(on, "node_id", "left_semi").select((F.col("node_id") + SURFACE).alias("node_id"), "x", "y", "surface_elevation", (F.col("surface_elevation") - p.curb_depth_m).alias("chamber_floor_elevation"), F.lit("surface").alias("node_type"))


def channels(pipes: DataFrame, p: DualDrainage) -> DataFrame:
    """A street channel along each pipe, between the surface nodes."""
    return pipes.select((F.col("u") + SURFACE).alias("u"), (F.col("v") + SURFACE).alias("v"), F.concat("id", F.lit("-channel")).alias("id"), "length", F.lit("street_channel").alias("edge_type"), street_width(F.col("lanes"), p.default_lanes).alias("channel_width"), F.lit(float(p.curb_depth_m)).alias("channel_depth"), F.lit(float(p.channel_roughness)).alias("roughness"))


def grates(surface: DataFrame) -> DataFrame:
    """An orifice from each surface node down to its node."""
    below = F.col("node_id") - SURFACE
    return surface.select(F.col("node_id").alias("u"), below.alias("v"), F.concat(below.cast("string"), F.lit("-grate")).alias("id"), F.lit("orifice").alias("edge_type"), F.lit(GRATE).alias("orifice_diam_m"), F.lit(GRATE_CD).alias("orifice_cd"))


def rerouted(subs: DataFrame, surface: DataFrame) -> DataFrame:
    """Subcatchments drain to the surface node above their outlet, where there is one."""
    s = surface.select((F.col("node_id") - SURFACE).alias("outlet_id"), F.col("node_id").alias("up"))
    return subs.join(s, "outlet_id", "left").withColumn("outlet_id", F.coalesce("up", "outlet_id")).drop("up")
