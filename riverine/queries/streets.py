"""Scans, filters, street cleaning and terrain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from ..operators import graph, network
from ..params import Topology
from ..sources import fixtures as fx
from .base import query

DOUBLED = """SELECT u, v, id, length, highway, 1 AS dir FROM fx_edges UNION ALL SELECT v, u, v || '-' || u, length, highway, 0 FROM fx_edges"""
CLEAN = "SELECT * FROM fx_edges WHERE highway NOT IN ('corridor', 'track', 'footway', 'path')"


def doubled(spark, d):
    return network.double_directed(fx.edges(spark, d))


def with_ends(edges, nodes, columns=("x", "y", "surface_elevation", "contributing_area")):
    """Edges with the columns of both ends, named u_ and v_."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


@query("SELECT highway, count(*) AS n, sum(length) AS total_length FROM fx_edges GROUP BY highway")
def scan_edge_types(spark, d):
    return fx.edges(spark, d).groupBy("highway").agg(F.count("*").alias("n"), F.sum("length").alias("total_length"))


@query(f"SELECT u, v, id, highway FROM ({CLEAN})")
def filter_omit_highway(spark, d):
    return network.without_highways(fx.edges(spark, d)).select("u", "v", "id", "highway")


@query("SELECT id, regexp_matches(highway, 'motorway|trunk|primary|secondary') AS is_major FROM fx_edges WHERE highway NOT IN ('track', 'footway', 'path')")
def filter_major_local_regex(spark, d):
    return network.without_highways(fx.edges(spark, d), ("track", "footway", "path")).select("id", network.major(F.col("highway")).alias("is_major"))


@query("SELECT node_id, x, y FROM fx_nodes WHERE x BETWEEN 200 AND 900 AND y BETWEEN 100 AND 700")
def filter_bbox_clip(spark, d):
    return network.clip(fx.nodes(spark, d), 200, 100, 900, 700).select("node_id", "x", "y")


@query("SELECT id, CAST(list_sum([CAST(t AS DOUBLE) FOR t IN regexp_extract_all(lanes, '[0-9]+')]) AS DOUBLE) AS lanes_sum FROM fx_edges")
def proj_lanes_sum(spark, d):
    return fx.edges(spark, d).select("id", text.number_sum(F.col("lanes")).alias("lanes_sum"))


@query("SELECT id, greatest(coalesce(try_cast(split_part(lanes, ',', 1) AS DOUBLE), 2), 1) * CAST(3.5 AS DOUBLE) AS width_m FROM fx_edges")
def proj_street_width(spark, d):
    return fx.edges(spark, d).select("id", text.street_width(F.col("lanes")).alias("width_m"))


@query("SELECT u, v, CAST(row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY id) - 1 AS INTEGER) AS key, id FROM (SELECT u, v, id FROM fx_edges UNION ALL SELECT u, v, id || 'b' FROM fx_edges WHERE u % 7 = 0)")
def proj_edge_keys(spark, d):
    e = fx.edges(spark, d).select("u", "v", "id")
    return network.parallel_keys(e.unionByName(e.where("u % 7 = 0").withColumn("id", F.concat("id", F.lit("b"))))).select("u", "v", "key", "id")


@query("SELECT u, v, CASE WHEN u % 5 = 0 AND k = 1 THEN u || '-' || v || '-river' ELSE u || '-' || v END AS id FROM fx_edges, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR u % 5 = 0")
def proj_edge_ids(spark, d):
    e = fx.edges(spark, d).select("u", "v", F.lit(0).alias("key"), F.lit(None).cast("string").alias("id"), F.lit("pipe").alias("edge_type"))
    river = e.where("u % 5 = 0").withColumn("edge_type", F.lit("river")).withColumn("key", F.lit(1))
    return network.assign_ids(e.unionByName(river)).select("u", "v", "id")


@query("SELECT node_id, CAST(CASE WHEN y / 100 - 20 < 0 THEN 32700 ELSE 32600 END + floor((x / 12 - 80 + 180) / 6) + 1 AS INTEGER) AS epsg FROM fx_nodes")
def proj_utm_epsg(spark, d):
    return fx.nodes(spark, d).select("node_id", geo.utm_epsg(F.col("x") / 12 - 80, F.col("y") / 100 - 20).alias("epsg"))


@query(f"SELECT u, v, id, length FROM ({DOUBLED})")
def double_directed_edges(spark, d):
    return doubled(spark, d).select("u", "v", "id", "length")


@query(f"SELECT least(u, v) AS u, greatest(u, v) AS v, min(id) AS id, min(length) AS length FROM ({DOUBLED}) GROUP BY 1, 2")
def undirected_edges(spark, d):
    return network.undirected(doubled(spark, d))


LONG = """SELECT c_custkey AS id, a.x AS ax, a.y AS aw, b.x AS bx, b.y AS bw,
    CAST(greatest(ceil(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 60), 1) AS INTEGER) AS n
    FROM customer JOIN fx_nodes a ON a.node_id = c_custkey JOIN fx_nodes b ON b.node_id = c_custkey + 163"""


@query(
    """SELECT CAST(id AS VARCHAR) AS id, CAST(part - 1 AS INTEGER) AS part, round(sqrt((ax - bx) * (ax - bx) + (aw - bw) * (aw - bw)) / n, 6) AS length,
    round(ax + (bx - ax) * part / n, 6) AS to_x FROM long_, LATERAL (SELECT unnest(range(1, n + 1)) AS part)""",
    long_=LONG,
)
def split_long_edges(spark, d):
    n = fx.nodes(spark, d)
    e = n.select("node_id", "x", "y").join(n.select((F.col("node_id") - 163).alias("node_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "node_id")
    e = e.select(F.col("node_id").cast("string").alias("id"), geo.line(geo.point("x", "y"), geo.point("bx", "by")).alias("geometry"))
    return network.split_long(e).select("id", "part", F.round("length", 6).alias("length"), F.round("bx", 6).alias("to_x"))


SHORT = """SELECT u, v FROM fx_edges WHERE u % 10 = 3 AND v = u + 1"""


@query(
    """SELECT node_id, max_by(other, (deg, -other)) AS "into" FROM (
        SELECT s.u AS node_id, o.other, o.deg FROM short_ s, LATERAL (SELECT unnest([s.u, s.v]) AS other) t, LATERAL (SELECT t.other, count(*) AS deg FROM fx_edges e WHERE e.u = t.other OR e.v = t.other) o
        UNION ALL
        SELECT s.v, o.other, o.deg FROM short_ s, LATERAL (SELECT unnest([s.u, s.v]) AS other) t, LATERAL (SELECT t.other, count(*) AS deg FROM fx_edges e WHERE e.u = t.other OR e.v = t.other) o
    ) GROUP BY node_id""",
    short_=SHORT,
)
def short_edge_clusters(spark, d):
    # every edge from a node of key 3 mod 10 to the right is drawn together to 4 m
    n = fx.nodes(spark, d).withColumn("x", F.when((F.col("node_id") % 10 == 4) & (F.col("node_id") % 40 > 0), F.col("x") - 46).otherwise(F.col("x")))
    return network.short_clusters(fx.edges(spark, d), n)


@query(f"SELECT e.u, e.v, round((a.surface_elevation - b.surface_elevation) / e.length, 6) AS surface_slope FROM ({DOUBLED}) e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v")
def surface_slope(spark, d):
    e = with_ends(doubled(spark, d), fx.nodes(spark, d))
    return e.select("u", "v", F.round((F.col("u_surface_elevation") - F.col("v_surface_elevation")) / F.col("length"), 6).alias("surface_slope"))


SLOPED = f"""SELECT e.u, e.v, e.id, e.length, b.contributing_area AS area, a.surface_elevation AS zu, b.surface_elevation AS zv, (a.surface_elevation - b.surface_elevation) / e.length * 100 AS s
    FROM ({DOUBLED}) e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v"""
COST = """CASE WHEN s < -1 OR s > 10 THEN CAST(1 AS DOUBLE) WHEN s <= CAST(0.3 AS DOUBLE) THEN 1 + (s + 1) * CAST(-1 AS DOUBLE) / CAST(1.3 AS DOUBLE) WHEN s <= CAST(0.7 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE (s - CAST(0.7 AS DOUBLE)) / CAST(9.3 AS DOUBLE) END"""


def sloped(spark, d):
    e = with_ends(doubled(spark, d), fx.nodes(spark, d))
    slope = (F.col("u_surface_elevation") - F.col("v_surface_elevation")) / F.col("length")
    return e.withColumn("surface_slope", slope).withColumn("chahinian_slope", numeric.slope_cost(slope))


@query(f"SELECT u, v, round({COST}, 6) AS chahinian_slope FROM sloped_", sloped_=SLOPED)
def chahinian_slope(spark, d):
    return sloped(spark, d).select("u", "v", F.round("chahinian_slope", 6).alias("chahinian_slope"))


def weighted(edges, p: Topology = Topology()):
    """Edges with weight: scaled shares of the parameter columns between their least and greatest values, summed.

    The bounds are one row, so they come by a broadcast of a single row.
    """
    bounds = edges.agg(*[f(c).alias(f"{c}_{n}") for c in p.weights for n, f in (("lo", F.min), ("hi", F.max))])
    parts = [numeric.scaled(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), p.exponent[c], p.scaling[c]) for c in p.weights]
    out = edges.crossJoin(F.broadcast(bounds))
    return out.withColumn("weight", sum(parts[1:], parts[0])).drop(*bounds.columns)


WEIGHTED = f"""SELECT u, v, zu, zv, CASE WHEN c1 = c0 THEN 0 ELSE greatest((c - c0) / (c1 - c0), 2.22e-16::DOUBLE) END + CASE WHEN a1 = a0 THEN 0 ELSE greatest((area - a0) / (a1 - a0), 2.22e-16::DOUBLE) * 0.1::DOUBLE END AS w
    FROM (SELECT *, {COST} AS c FROM sloped_), (SELECT min({COST}) AS c0, max({COST}) AS c1, min(area) AS a0, max(area) AS a1 FROM sloped_)"""


@query("SELECT u, v, round(w, 6) AS weight FROM weighted_", sloped_=SLOPED, weighted_=WEIGHTED)
def topology_weights(spark, d):
    return weighted(sloped(spark, d).withColumn("contributing_area", F.col("v_contributing_area"))).select("u", "v", F.round("weight", 6).alias("weight"))


@query(
    """SELECT a.u, a.v, b.v AS w, CASE WHEN (na.x - nb.x) * (nc.x - nb.x) + (na.y - nb.y) * (nc.y - nb.y) < -1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS turn_cost
    FROM fx_edges a JOIN fx_edges b ON a.v = b.u JOIN fx_nodes na ON na.node_id = a.u JOIN fx_nodes nb ON nb.node_id = a.v JOIN fx_nodes nc ON nc.node_id = b.v"""
)
def turn_angle_cost(spark, d):
    e, n = fx.edges(spark, d).select("u", "v"), fx.nodes(spark, d).select("node_id", "x", "y")
    t = e.join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), "v")
    for c in ("u", "v", "w"):
        t = t.join(n.withColumnsRenamed({"node_id": c, "x": f"{c}x", "y": f"{c}y"}), c)
    angle = geo.turn_angle(*[F.col(x) for x in ("ux", "uy", "vx", "vy", "wx", "wy")])
    return t.select("u", "v", "w", F.round(numeric.turn_cost(angle), 6).alias("turn_cost"))
