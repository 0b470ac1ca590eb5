"""Subcatchment tables: dissolve, outlets, names, orphans, imperviousness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from . import graph, raster


def dissolve(subs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Outlets renamed by (node_id, into), then one row each: areas and impervious areas add up, rc and slope are means by area, width = sqrt(area / pi)."""
    s = subs.join(mapping.withColumnRenamed("node_id", "outlet_id"), "outlet_id", "left").withColumn("outlet_id", F.coalesce("into", "outlet_id"))
    mean = lambda c: (F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(c)
    out = s.groupBy("outlet_id").agg(F.sum("area").alias("area_"), F.sum(F.col("rc") / 100 * F.col("area")).alias("impervious_area"), mean("rc"), mean("slope"))
    return out.withColumnRenamed("area_", "area").withColumn("width", F.sqrt(F.col("area") / math.pi))


def unique_names(subs: DataFrame, order: str = "sub_id") -> DataFrame:
    """name: outlet-number-sub, numbered within the outlet; area in ha."""
    n = F.row_number().over(Window.partitionBy("outlet_id").orderBy(order)) - 1
    return subs.withColumn("name", F.concat(F.col("outlet_id").cast("string"), F.lit("-"), n.cast("string"), F.lit("-sub"))).withColumn("area_ha", F.col("area") / 10_000)


def with_outlet(subs: DataFrame, nodes: DataFrame) -> DataFrame:
    return subs.join(nodes.select(F.col("node_id").alias("outlet_id")), "outlet_id", "left_semi")


def orphans(subs: DataFrame, edges: DataFrame, outfalls: DataFrame) -> DataFrame:
    """Subcatchments whose outlet can't reach an outfall."""
    ok = graph.reach(edges, outfalls, backwards=True).select(F.col("node").alias("outlet_id"))
    return subs.join(ok, "outlet_id", "left_anti")


def adopt(subs: DataFrame, lost: DataFrame, touching: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Lost subcatchments take the outlet of the settled neighbour of the longest border (a, b, border), round by round, those settled in one round serving in the next."""
    from .iterate import cut

    settled = cut(subs.join(lost.select("sub_id"), "sub_id", "left_anti").select("sub_id", "outlet_id"))
    rest = cut(lost.select("sub_id"))
    for _ in range(rounds):
        near = touching.join(settled.withColumnRenamed("sub_id", "b"), "b").select(F.col("a").alias("sub_id"), "border", F.col("b"), "outlet_id").join(rest, "sub_id", "left_semi")
        got = cut(near.groupBy("sub_id").agg(F.min(F.struct((-F.col("border")).alias("n"), "b", "outlet_id")).alias("m")).select("sub_id", F.col("m.outlet_id").alias("outlet_id")))
        if not got.take(1):
            return settled
        settled, rest = cut(settled.unionByName(got)), cut(rest.join(got, "sub_id", "left_anti"))
    raise RuntimeError("adoption did not end")


def impervious(subs: DataFrame, zonal: DataFrame) -> DataFrame:
    """rc (percent) from zonal means (id, mean), and impervious_area."""
    return subs.join(zonal.withColumnRenamed("id", "sub_id"), "sub_id", "left").withColumn("rc", F.coalesce("mean", F.lit(0.0))).withColumn("impervious_area", F.col("rc") / 100 * F.col("area")).drop("mean")


def detached(parts: DataFrame, least: float = 1000) -> DataFrame:
    """Parts (id, part, area) that stay: the largest of each id and those of at least `least`."""
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("area"), "part"))
    return parts.withColumn("k", k).where((F.col("k") == 1) | (F.col("area") >= least)).drop("k")


def merge_nested(pairs: DataFrame, subs: DataFrame) -> DataFrame:
    """subs (sub_id, area, rc, slope) inside others go into their outermost container; pairs(sub_id, in_id, in_area): the smallest container counts at each step."""
    step = pairs.groupBy("sub_id").agg(F.min(F.struct("in_area", "in_id")).alias("m")).select(F.col("sub_id").alias("node"), F.col("m.in_id").alias("into"))
    end = graph.resolve(step).withColumnsRenamed({"node": "node_id"})
    return dissolve(subs.withColumn("outlet_id", F.col("sub_id")), end).withColumnRenamed("outlet_id", "sub_id")


def smallest_container(pairs: DataFrame) -> DataFrame:
    """(sub_id, in_id): of several containers (sub_id, area, in_id, in_area) the smallest that is larger than what it holds (ties: smaller id)."""
    fit = pairs.where(F.col("in_area") > F.col("area"))
    return fit.groupBy("sub_id").agg(F.min(F.struct("in_area", "in_id")).alias("m")).select("sub_id", "m.in_id")


def from_cells(labels: DataFrame, size: float, slope: DataFrame) -> DataFrame:
    """(sub_id, outlet_id, area, slope, width): subcatchments of labelled cells (row_, col_, id), their mean slope and the radius of a circle as large."""
    m = raster.zonal_mean(labels, slope)
    n = labels.groupBy("id").agg((F.count("*") * float(size * size)).alias("area"))
    return n.join(m, "id").select(F.col("id").alias("sub_id"), F.col("id").alias("outlet_id"), "area", F.col("mean").alias("slope"), F.sqrt(F.col("area") / math.pi).alias("width"))


def derive(pointer: DataFrame, nodes: DataFrame, slope: DataFrame, size: float, least_cells: int = 1) -> tuple[DataFrame, DataFrame]:
    """(subs, labels) of a drainage pointer (row_, col_, to_row, to_col) and nodes (node_id, x, y) as pour points.

    Pour points move to a stream cell beside them; cells take the first pour
    point below, gaps the nearest label; cells of nodes that share a pour cell
    are dealt by distance; parts cut off go to the neighbour of the longest
    border and nested subcatchments into their container.  No node on the grid
    raises ValueError.
    """
    from .iterate import cut

    at = nodes.select(F.col("node_id").alias("id"), F.floor(F.col("y") / size).cast("long").alias("row_"), F.floor(F.col("x") / size).cast("long").alias("col_"))
    on = at.join(pointer.select("row_", "col_"), ["row_", "col_"], "left_semi")
    if not on.take(1):
        raise ValueError("no pour point lies on the grid")
    pours = cut(raster.snap_pours(on, raster.flow_accumulation(pointer), least_cells))
    shed = raster.watersheds(pointer, pours)
    every = pointer.select("row_", "col_").join(shed, ["row_", "col_"], "left").select("row_", "col_", F.col("id").cast("double").alias("value"))
    zones = cut(raster.fill_gaps(every).select("row_", "col_", F.col("value").cast("long").alias("id")))
    lead = pours.groupBy("row_", "col_").agg(F.min("id").alias("zone"))
    sites = pours.join(lead, ["row_", "col_"]).join(on.select("id", F.col("row_").alias("r"), F.col("col_").alias("c")), "id").select("zone", F.col("id").alias("site"), "r", "c")
    labels = cut(raster.rehome(raster.split_merged(zones, sites), 0))
    inside = cut(raster.nested(labels))
    end = graph.resolve(inside.select(F.col("sub_id").alias("node"), F.col("in_id").alias("into")))
    labels = cut(labels.join(end.withColumnRenamed("node", "id"), "id", "left").select("row_", "col_", F.coalesce("into", "id").alias("id")))
    return from_cells(labels, size, slope), labels


def reported(nodes: DataFrame, subs: DataFrame) -> DataFrame:
    """(n_subs, n_zero, area, given): how many subcatchments there are, how many outlets got no area, all area, and what nodes hold."""
    s = subs.agg(F.count("*").alias("n_subs"), F.sum("area").alias("area"))
    n = nodes.agg(F.count(F.when(F.coalesce("contributing_area", F.lit(0.0)) <= 0, 1)).alias("n_zero"), F.sum("contributing_area").alias("given"))
    return s.crossJoin(F.broadcast(n)).select("n_subs", "n_zero", "area", "given")
