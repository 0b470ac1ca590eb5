"""Outfall selection, pairing, protection and trunk inference."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo
from ..params import Outfalls
from . import graph, raster
from .spatial import containing, near_points, nearest_lines

SPECIAL_TYPES = ("water_body", "outlet_junction", "dummy_river", "river_outfall", "water_body_outfall", "waste", "surface")


def protected(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes that simplification keeps: of a special type, at an edge that is no pipe, or whose pipes in and out aren't
    one each (with `most`: are more than that)."""
    other = edges.where("edge_type <> 'pipe'").select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("other", F.lit(True))
    d = nodes.join(graph.degrees(edges), "node", "left").join(other, "node", "left")
    i, o = F.coalesce("pipe_in", F.lit(0)), F.coalesce("pipe_out", F.lit(0))
    odd = (i != 1) | (o != 1) if most is None else (i > most) | (o > most)
    return d.where(F.coalesce(F.col("node_type").isin(*SPECIAL_TYPES), F.lit(False)) | F.coalesce("other", F.lit(False)) | odd).select(*nodes.columns)


def pair_rivers(streets: DataFrame, rivers: DataFrame, within: float) -> DataFrame:
    """(node_id, river_id, distance, x, y): for each street node the nearest river within a distance, and the point on it."""
    return nearest_lines(streets, rivers, within)


def dummy_sinks(nodes: DataFrame, parts: DataFrame, matched: DataFrame) -> DataFrame:
    """For each component without a match: its lowest node (ties: least id) and a sink at one metre north-east of it."""
    paired = parts.join(matched.select(F.col("node_id").alias("node")), "node").select("root").distinct()
    left = parts.join(paired, "root", "left_anti").join(nodes.select(F.col("node_id").alias("node"), "x", "y", F.col("surface_elevation").alias("z")), "node")
    return left.groupBy("root").agg(F.min(F.struct("z", "node", "x", "y")).alias("m")).select("root", F.col("m.node").alias("node"), (F.col("m.x") + 1).alias("x"), (F.col("m.y") + 1).alias("y"))


def iqr_outliers(edges: DataFrame, by: str, value: str, least: int = 4) -> DataFrame:
    """Rows beyond the third quartile plus 1.5 interquartile ranges of their group, in groups of `least` rows at least."""
    q = edges.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    q = q.select(by, (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("fence"))
    return edges.join(q, by).where(F.col(value) > F.col("fence"))


def _prim(batches):
    """Rows that join a further component, nearest first, growing from the seed's; ties: node ids."""
    rows = pd.concat(list(batches) or [pd.DataFrame({c: [] for c in ("root", "to_root", "distance", "node", "to", "z", "tz", "seed")})], ignore_index=True)
    arcs: dict = {}
    for at, (root, into, *key) in enumerate(zip(*[rows[c].tolist() for c in ("root", "to_root", "distance", "node", "to")], strict=True)):
        arcs.setdefault(into, []).append((*key, root, at))
    heap, joined, keep, top = [], set(), [], next(iter(rows["seed"].tolist()), None)
    while top is not None:
        joined.add(top)
        for arc in arcs.pop(top, ()):
            heapq.heappush(heap, arc)
        while heap and heap[0][3] in joined:
            heapq.heappop(heap)
        top = None
        if heap:
            *_, top, at = heapq.heappop(heap)
            keep.append(at)
    yield rows.iloc[keep]


def trunk_bridges(parts: DataFrame, sources: DataFrame, nodes: DataFrame, longest: float) -> DataFrame:
    """(u, v, distance): bridges that join pipe components, nearest first, growing from the component of the lowest node.

    parts(node, root); sources(root, node): where a component may be left.
    Always the unconnected component whose source is nearest to the connected
    ones comes next (ties: node ids), until none is within reach; the higher
    end is upstream.  Which component is next depends on all joined before, so
    after the nearest bridge of each pair of components is found, one row a
    pair, a heap in one task joins them all.
    """
    from .iterate import cut

    z = nodes.select(F.col("node_id").alias("node"), "x", "y", F.col("surface_elevation").alias("z"))
    at = cut(parts.join(z, "node"))
    first = at.agg(F.min(F.struct("z", "root")).alias("m")).select(F.col("m.root").alias("seed"))
    to = at.select(F.col("root").alias("to_root"), F.col("node").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("tz"))
    near = near_points(sources.join(z, "node"), to, longest).where("root <> to_root")
    pairs = near.groupBy("root", "to_root").agg(F.min(F.struct("distance", "node", "to", "z", "tz")).alias("m")).select("root", "to_root", "m.*")
    pairs = pairs.crossJoin(F.broadcast(first)).repartition(1)
    best = cut(pairs.mapInPandas(_prim, pairs.schema))
    up = F.coalesce(F.col("z") >= F.col("tz"), F.lit(True))
    return best.select(F.when(up, F.col("node")).otherwise(F.col("to")).alias("u"), F.when(up, F.col("to")).otherwise(F.col("node")).alias("v"), "distance")


#: Ids of sinks: their kind times this, and the street's id.
SINK = 1_000_000_000_000
SINKS = {"river_outfall": 1, "water_body_outfall": 2, "dummy_river": 3}
#: The node that everything drains to in the end.
WASTE = -(1 << 62)


#: Least side of the tiles that rings are dealt to: a ring's copies grow with the square of its width over this.
RING_TILE = 20.0


def ring_segments(rings: DataFrame, key: str = "pond_id") -> DataFrame:
    """(river_id, x0, y0, x1, y1): the sides of rings, as the lines that nearest_lines takes."""
    i = F.sequence(F.lit(0), F.size("ring") - 1)
    side = F.transform(i, lambda k: F.struct(F.get("ring", k).alias("a"), F.get("ring", (k + 1) % F.size("ring")).alias("b")))
    return rings.select(F.col(key).alias("river_id"), F.explode(side).alias("s")).select("river_id", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def near_rings(points: DataFrame, rings: DataFrame, within: float, key: str = "pond_id") -> DataFrame:
    """(node_id, pond_id, distance): for each point the nearest ring within a distance, none from inside it; ties: smaller id."""
    inside = containing(points.select("node_id", "x", "y"), rings.select(key, "ring"), max(within, RING_TILE), "node_id", key).select("node_id", F.col(key).alias("pond_id"), F.lit(0.0).alias("distance"))
    beside = nearest_lines(points, ring_segments(rings, key), within).select("node_id", F.col("river_id").alias("pond_id"), "distance")
    return inside.unionByName(beside).groupBy("node_id").agg(F.min(F.struct("distance", "pond_id")).alias("m")).select("node_id", "m.pond_id", "m.distance")


def pair_receiving(streets: DataFrame, rivers: DataFrame, waters: DataFrame | None, p: Outfalls, cells: DataFrame | None = None, size: float = 1) -> DataFrame:
    """(node_id, kind, distance, x, y): each street node (node_id, x, y, surface_elevation) with the nearest river line and, if
    asked for, the nearest shore of water rings (pond_id, ring) within the buffer; those whose water (cells) stands above the
    street go, an unknown stage stays."""
    pairs = nearest_lines(streets, rivers, p.river_buffer_distance).withColumn("kind", F.lit("river_outfall"))
    if p.include_water_body_outfalls and waters is not None:
        pairs = pairs.unionByName(nearest_lines(streets, ring_segments(waters), p.river_buffer_distance).withColumn("kind", F.lit("water_body_outfall")))
    pairs = pairs.select("node_id", "kind", "distance", "x", "y")
    if cells is None:
        return pairs
    stage = raster.at_cell(pairs.withColumn("pair", F.struct("node_id", "kind")), cells, size, "pair").select(F.col("pair.node_id").alias("node_id"), F.col("pair.kind").alias("kind"), F.col("value").alias("stage"))
    z = streets.select("node_id", "surface_elevation")
    return drop_adverse(pairs.join(stage, ["node_id", "kind"], "left").join(z, "node_id")).select("node_id", "kind", "distance", "x", "y")


def storage_basins(storages: DataFrame, basins: DataFrame, p: Outfalls) -> DataFrame:
    """(pond_id, basin_id, ring): the basin (basin_id, ring) of each storage (pond_id, x, y, area_m2) large enough: the nearest one that is
    no farther off than the footprint match, whose limit counts as near; none where no match is allowed."""
    if p.pond_footprint_match_m <= 0:
        return storages.join(basins, F.lit(False)).select("pond_id", "basin_id", "ring")
    s = storages.where(F.coalesce("area_m2", F.lit(0.0)) >= p.pond_intake_min_area_m2).select(F.col("pond_id").alias("node_id"), "x", "y")
    own = near_rings(s, basins, p.pond_footprint_match_m, "basin_id").select(F.col("node_id").alias("storage"), F.col("pond_id").alias("basin_id"))
    return own.join(basins.select("basin_id", "ring"), "basin_id").select(F.col("storage").alias("pond_id"), "basin_id", "ring")


def intakes(streets: DataFrame, footprints: DataFrame, storages: DataFrame, parts: DataFrame, taken: DataFrame, p: Outfalls) -> DataFrame:
    """(u, v, length): street nodes within the buffer of a pond's footprint (pond_id, ring) drain into its storage, if both lie in
    one component and the street has no river or dummy of its own (taken: node_id)."""
    free = streets.where("coalesce(node_type, '') not in ('water_body', 'water_body_outfall')").join(taken, "node_id", "left_anti")
    near = near_rings(free, footprints, p.pond_intake_buffer_m)
    of = parts.select(F.col("node").alias("node_id"), F.col("root").alias("ru")), parts.select(F.col("node").alias("pond_id"), F.col("root").alias("rv"))
    near = near.join(of[0].hint("merge"), "node_id").join(of[1].hint("merge"), "pond_id").where("ru = rv and node_id <> pond_id")
    at = free.select("node_id", "x", "y"), storages.select("pond_id", F.col("x").alias("px"), F.col("y").alias("py"))
    near = near.join(at[0].hint("merge"), "node_id").join(at[1].hint("merge"), "pond_id")
    return near.select(F.col("node_id").alias("u"), F.col("pond_id").alias("v"), geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")).alias("length"))


def identify(
    nodes: DataFrame, edges: DataFrame, rivers: DataFrame, p: Outfalls, waters: DataFrame | None = None, cells: DataFrame | None = None, size: float = 1, footprints: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sinks, outfalls): where streets drain to rivers, water bodies, dummies and ponds.

    nodes(node_id, x, y, surface_elevation, node_type), edges(u, v, edge_type,
    length), rivers(river_id, x0, y0, x1, y1).  Every street near water is a
    candidate; a component without one, and without a node that is an outfall
    already (node_type), gets a dummy at its lowest street.
    Which candidates stay is said by a spanning tree: rivers and sinks join
    the waste node at no cost, pipes cost their length and an outfall the
    clustering factor times the median pipe, so that one outfall is left of
    streets joined by shorter pipes.  Equal costs go by ids, smaller first.
    """
    from .iterate import cut

    pipes = edges.where("edge_type = 'pipe'")
    ends = pipes.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    streets = cut(nodes.join(ends, "node_id", "left_semi").select("node_id", "x", "y", "surface_elevation", "node_type"))
    parts = graph.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), nodes.select(F.col("node_id").alias("node")))
    pairs = cut(pair_receiving(streets, rivers, waters, p, cells, size))
    cost = pipes.agg((F.coalesce(F.median("length"), F.lit(0.0)) * p.outfall_clustering_factor).alias("weight"))
    given = nodes.where("node_type like '%outfall'").select("node_id")
    paired = pairs.select(F.col("node_id").alias("node")).unionByName(given.select(F.col("node_id").alias("node"))).distinct().join(parts, "node").select("root").distinct()
    low = streets.where("coalesce(node_type, '') <> 'water_body'").join(parts.withColumnRenamed("node", "node_id"), "node_id").join(paired, "root", "left_anti")
    low = low.groupBy("root").agg(F.min(F.struct("surface_elevation", "node_id", "x", "y")).alias("m")).select("m.node_id", F.lit("dummy_river").alias("kind"), F.lit(None).cast("double").alias("distance"), (F.col("m.x") + 1).alias("x"), (F.col("m.y") + 1).alias("y"))
    number = F.create_map(*[F.lit(x) for kv in SINKS.items() for x in kv])[F.col("kind")]
    found = pairs.unionByName(low).withColumn("v", number.cast("long") * SINK + F.col("node_id")).crossJoin(F.broadcast(cost))
    links = found.select(F.col("node_id").alias("u"), "v", F.coalesce("distance", "weight").alias("length"), "weight", F.lit(False).alias("pond_intake"))
    if p.online_pond_intake and footprints is not None:
        storages = nodes.where("node_type = 'water_body'").select(F.col("node_id").alias("pond_id"), "x", "y")
        taken = found.where("kind <> 'water_body_outfall'").select("node_id").distinct()
        links = links.unionByName(intakes(streets, footprints, storages, parts, taken, p).crossJoin(F.broadcast(cost)).withColumn("pond_intake", F.lit(True)))
    links = cut(links)
    sinks = found.select(F.col("v").alias("node_id"), "x", "y", F.col("kind").alias("node_type"))
    river = F.col("edge_type") == "river"
    arcs = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.when(river, 0.0).otherwise(F.coalesce("length", F.lit(1.0))).alias("weight"))
    out = edges.select(F.col("u").alias("node_id")).unionByName(links.select(F.col("u").alias("node_id")))
    roots = nodes.select("node_id").join(out, "node_id", "left_anti").unionByName(sinks.select("node_id")).unionByName(given)
    arcs = arcs.unionByName(links.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight")).unionByName(roots.select(F.col("node_id").alias("a"), F.lit(WASTE).alias("b"), F.lit(0.0).alias("weight")))
    tree = graph.spanning_forest(arcs).select("a", "b")
    kept = links.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).join(tree, ["a", "b"], "left_semi")
    name = F.concat(F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"), F.when(F.col("pond_intake"), F.lit("-pondintake")).otherwise("-outfall"))
    kept = cut(kept.select("u", "v", F.lit("outfall").alias("edge_type"), name.alias("id"), "length", "weight", "pond_intake"))
    sinks = sinks.join(kept.select(F.col("v").alias("node_id")), "node_id", "left_semi")
    if cells is not None:
        z = stage_elevations(sinks.where("node_type <> 'dummy_river'"), cells, size)
        sinks = sinks.join(z, "node_id", "left")
    return sinks, kept


def root_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge out: each gets a free edge to the waste node."""
    return nodes.join(edges.select(F.col("u").alias("node_id")).distinct(), "node_id", "left_anti")


def stage_elevations(sinks: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(node_id, surface_elevation, chamber_floor_elevation) of sinks from the cell they lie in; no data: unchanged rows lack."""
    at = sinks.withColumn("row_", F.floor(F.col("y") / size).cast("long")).withColumn("col_", F.floor(F.col("x") / size).cast("long"))
    return at.join(cells.where("value is not null"), ["row_", "col_"]).select("node_id", F.col("value").alias("surface_elevation"), F.col("value").alias("chamber_floor_elevation"))


def drop_adverse(pairs: DataFrame, street_z: str = "surface_elevation", stage: str = "stage") -> DataFrame:
    """Pairs whose stage lies above the street go; unknown stages stay."""
    return pairs.where(F.col(stage).isNull() | (F.col(stage) <= F.col(street_z)))


def first_by(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("k_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("k_ = 1").drop("k_")
