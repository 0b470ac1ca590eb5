"""Network simplification: dangling leaves, chains, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo
from ..network import Network
from ..params import Simplification
from . import graph, outfalls, subcatchments
from .iterate import cut


def dangling(succ: DataFrame, area: DataFrame, keep: DataFrame, least: float, rounds: int = 10_000) -> DataFrame:
    """(node_id, into): leaves whose chain down to the next kept or branching node has less area than `least` go, again and
    again; into is the node that survives below.  succ(node, next), area(node, area), keep(node)."""
    state = cut(succ.join(area, "node", "left").join(keep.withColumn("kept", F.lit(True)), "node", "left").select("node", "next", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce("kept", F.lit(False)).alias("kept")))
    gone = None
    for _ in range(rounds):
        above = state.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"))
        s = state.join(above, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        leaf = s.where("n = 0 and not kept and next is not null")
        chains = cut(s.where("n = 1 and not kept and next is not null").select("node", "next", "area"))
        # walk each leaf's chain by pointer doubling: end and area of what lies between
        jump = cut(chains.select("node", F.col("next").alias("end"), F.col("area").alias("sum")))
        while True:
            hop = jump.select(F.col("node").alias("end"), F.col("end").alias("beyond"), F.col("sum").alias("more"))
            nxt = cut(jump.join(hop, "end", "left").select("node", F.coalesce("beyond", "end").alias("end"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), F.col("beyond").isNotNull().alias("moved")))
            jump = nxt.drop("moved")
            if not nxt.where("moved").take(1):
                break
        small = leaf.join(jump.select(F.col("node").alias("next"), "end", "sum"), "next", "left").select("node", F.coalesce("end", "next").alias("end"), (F.col("area") + F.coalesce("sum", F.lit(0.0))).alias("total")).where(F.col("total") < least)
        small = cut(small)
        if not small.take(1):
            break
        inner = jump.join(small.select("end").distinct(), "end").select("node", "end")
        onto = leaf.select(F.col("next").alias("first"), F.col("node").alias("leaf")).join(small.select(F.col("node").alias("leaf"), "end"), "leaf")
        reach = graph.reach(chains.select(F.col("node").alias("u"), F.col("next").alias("v")), onto.join(chains.select(F.col("node").alias("first")), "first", "left_semi").select(F.col("first").alias("node"))).select("node")
        step = cut(small.select(F.col("node").alias("node_id"), F.col("end").alias("into")).unionByName(inner.join(reach, "node", "left_semi").select(F.col("node").alias("node_id"), F.col("end").alias("into"))).distinct())
        gone = step if gone is None else cut(gone.unionByName(step))
        given = step.join(state.select(F.col("node").alias("node_id"), "area"), "node_id").groupBy(F.col("into").alias("node")).agg(F.sum("area").alias("more"))
        state = cut(state.join(step.select(F.col("node_id").alias("node")), "node", "left_anti").join(given, "node", "left").select("node", "next", (F.col("area") + F.coalesce("more", F.lit(0.0))).alias("area"), "kept"))
    else:
        raise RuntimeError("dangling leaves did not end")
    if gone is None:
        return succ.select(F.col("node").alias("node_id"), F.col("next").alias("into")).limit(0)
    end = graph.resolve(gone.select(F.col("node_id").alias("node"), "into"))
    return end.select(F.col("node").alias("node_id"), "into")


def merge_chain(pieces: DataFrame) -> DataFrame:
    """One edge per chain out of pieces (chain, pos, length, diameter, roughness, contributing_area, in_offset, out_offset):
    lengths and areas add up, the diameter is the largest, roughness the mean by length, offsets those of the two ends."""
    return pieces.groupBy("chain").agg(
        F.sum("length").alias("length"), F.max("diameter").alias("diameter"), (F.sum(F.col("roughness") * F.col("length")) / F.sum("length")).alias("roughness"), F.sum("contributing_area").alias("contributing_area"),
        F.min_by("in_offset", "pos").alias("in_offset"), F.max_by("out_offset", "pos").alias("out_offset"),
    )


def split_points(pieces: DataFrame, longest: float) -> DataFrame:
    """(chain, pos): where a merged chain longer than `longest` is cut again: it has n = ceil(length / longest) parts, and the k-th cut
    comes after the first piece behind the last cut that reaches k / n of the length; never after the last piece."""
    lists = pieces.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("p"), F.sum("length").alias("total")).where(F.col("total") > longest)
    part = F.col("total") / F.ceil(F.col("total") / longest)
    start = F.struct(F.lit(0.0).alias("far"), F.lit(1).alias("k"), F.array().cast("array<bigint>").alias("cuts"))

    def step(t, x):
        far = t["far"] + x["length"]
        hit = far >= t["k"] * part - 1e-6
        return F.struct(far.alias("far"), F.when(hit, t["k"] + 1).otherwise(t["k"]).alias("k"), F.when(hit, F.concat(t["cuts"], F.array(x["pos"].cast("bigint")))).otherwise(t["cuts"]).alias("cuts"))

    inner = F.slice("p", 1, F.size("p") - 1)
    return lists.select("chain", F.explode(F.aggregate(inner, start, step, lambda t: t["cuts"])).alias("pos"))


def chains(nodes: DataFrame, pipes: DataFrame, keep: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, chain, hops) of the nodes inside chains: one pipe (u, v) in and one out, not kept (keep: node).  chain is the last
    inner node, hops the steps to it; rings without a kept node have no end and are left out."""
    d = graph.degrees(pipes).where("pipe_in = 1 and pipe_out = 1").select("node")
    inner = cut(nodes.select("node").join(d, "node", "left_semi").join(keep.select("node"), "node", "left_anti"))
    nxt = pipes.select(F.col("u").alias("node"), F.col("v").alias("next")).join(inner, "node", "left_semi").join(inner.withColumnRenamed("node", "next"), "next", "left_semi")
    last = inner.join(nxt.select("node"), "node", "left_anti").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("hops"))
    done, waiting = last, cut(nxt.select("node", "next", F.lit(1).cast("long").alias("hops")))
    done = cut(done)
    for _ in range(rounds):  # pointer doubling: 2^64 steps would have reached an end
        if not waiting.take(1):
            return done
        ends = done.select(F.col("node").alias("next"), "chain", F.col("hops").alias("more"))
        hop = waiting.select(F.col("node").alias("next"), F.col("next").alias("beyond"), F.col("hops").alias("further"))
        j = cut(waiting.join(ends, "next", "left").join(hop, "next", "left"))
        ready = j.where("chain is not null").select("node", "chain", (F.col("hops") + F.col("more")).alias("hops"))
        still = j.where("chain is null").select("node", F.col("beyond").alias("next"), (F.col("hops") + F.col("further")).alias("hops"))
        if not ready.take(1) and not j.where("chain is null and beyond is null").take(1):
            return done  # only rings are left
        done, waiting = cut(done.unionByName(ready)), cut(still)
    return done


#: What a merged pipe gets from its pieces; other columns become null.
MERGED = ("length", "diameter", "roughness", "contributing_area", "in_offset", "out_offset")


def consolidate(nodes: DataFrame, edges: DataFrame, keep: DataFrame, longest: float) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): chains of pipes between kept nodes become one pipe each, or several where longer than `longest`.

    edges(u, v, id, edge_type and the columns of MERGED, geometry if there);
    mapping(node_id, into): removed nodes go to the end of their chain.  Pipes
    that led from a chain's start to its end before are replaced by it.
    """
    pipes = edges.where("edge_type = 'pipe'")
    inside = cut(chains(nodes, pipes, keep))
    into = pipes.join(inside.withColumnsRenamed({"node": "v", "hops": "pos"}), "v").withColumn("pos", -F.col("pos"))
    onto = pipes.join(inside.where("hops = 0").select(F.col("node").alias("u"), "chain", F.lit(1).cast("long").alias("pos")), "u")
    pieces = cut(into.unionByName(onto))
    whole = pieces.groupBy("chain").agg(F.sum("length").alias("total")).where("total > 0").select("chain")
    pieces = cut(pieces.join(whole, "chain", "left_semi"))
    cuts = cut(split_points(pieces.select("chain", "pos", "length"), longest))
    before = pieces.join(cuts.withColumn("cut", F.lit(1)), ["chain", "pos"], "left")
    order = Window.partitionBy("chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("part", F.coalesce(F.sum("cut").over(order), F.lit(0)))
    more = [F.transform(F.array_sort(F.collect_list(F.struct("pos", "geometry"))), lambda x: x["geometry"]).alias("lines")] if "geometry" in edges.columns else []
    merged = before.groupBy("chain", "part").agg(
        F.min_by("u", "pos").alias("u"), F.max_by("v", "pos").alias("v"), F.sum("length").alias("length"), F.max("diameter").alias("diameter"),
        (F.sum(F.col("roughness") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0.0))).alias("roughness"), F.sum("contributing_area").alias("contributing_area"), F.min_by("in_offset", "pos").alias("in_offset"), F.max_by("out_offset", "pos").alias("out_offset"), *more,
    )
    merged = merged.withColumn("id", F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))).withColumn("edge_type", F.lit("pipe"))
    if more:
        merged = merged.withColumn("geometry", F.when(F.exists("lines", lambda g: g.isNull()), F.lit(None)).otherwise(geo.join_lines(F.col("lines")))).drop("lines")
    merged = cut(merged)
    one = merged.join(cuts.select("chain").distinct(), "chain", "left_anti").select("u", "v").distinct()
    rest = edges.join(pieces.select("id"), "id", "left_anti").join(one.withColumn("edge_type", F.lit("pipe")), ["u", "v", "edge_type"], "left_anti")
    ends = pieces.groupBy("chain").agg(F.max_by("v", "pos").alias("into"))
    stays = merged.select(F.col("v").alias("node")).distinct()
    gone = inside.join(whole, "chain", "left_semi").join(stays, "node", "left_anti").join(ends, "chain").select(F.col("node").alias("node_id"), "into")
    return rest.unionByName(merged.drop("chain", "part"), allowMissingColumns=True).select(*edges.columns), gone


def network(n: Network, p: Simplification) -> Network:
    """Dangling leaves of little area go (where a limit is set), chains become single pipes; areas and subcatchments of what is gone
    count for what is left."""
    if not p.enabled:
        return n
    named = lambda df: df.withColumnRenamed("node_id", "node")
    nodes, edges, mapping = n.nodes, n.edges, None
    own = nodes.select(F.col("node_id").alias("node"), F.col("contributing_area").alias("area"))
    if p.min_contributing_area_m2 > 0:
        pipes = edges.where("edge_type = 'pipe'")
        succ = nodes.select(F.col("node_id").alias("node")).join(pipes.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("next")), "node", "left")
        mapping = cut(dangling(succ, own, outfalls.protected(named(nodes), edges, 1).select("node"), p.min_contributing_area_m2))
        for end in ("u", "v"):
            edges = edges.join(mapping.select(F.col("node_id").alias(end)), end, "left_anti")
        edges, nodes = cut(edges), nodes.join(mapping, "node_id", "left_anti")
    keep = outfalls.protected(named(nodes), edges).select("node")
    edges, gone = consolidate(nodes.select(F.col("node_id").alias("node")), edges, keep, p.max_conduit_length)
    mapping = gone if mapping is None else mapping.unionByName(gone)
    mapping = graph.resolve(mapping.select(F.col("node_id").alias("node"), "into")).withColumnRenamed("node", "node_id")
    areas = redistribute(own, mapping).withColumnsRenamed({"node": "node_id", "area": "contributing_area"})
    nodes = n.nodes.join(mapping, "node_id", "left_anti").drop("contributing_area").join(areas, "node_id", "left")
    edges = edges.drop("contributing_area").join(areas.select(F.col("node_id").alias("u"), "contributing_area"), "u", "left").select(*n.edges.columns)
    out = n.with_nodes(nodes.select(*n.nodes.columns)).with_edges(edges)
    return out if n.subs is None else out.with_subs(subcatchments.dissolve(n.subs, mapping))


def redistribute(area: DataFrame, mapping: DataFrame) -> DataFrame:
    """(node, area): what removed nodes (node_id, into) had goes to those that survive."""
    m = mapping.withColumnsRenamed({"node_id": "node"})
    return area.join(m, "node", "left").groupBy(F.coalesce("into", "node").alias("node")).agg(F.sum("area").alias("area"))
