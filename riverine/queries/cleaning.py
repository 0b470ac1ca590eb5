"""Line cleaning, simplification, layers and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..network import Network
from ..operators import simplify, streets
from ..sources import fixtures as fx, readers, writers
from .base import query
from .graphs import succ


def lines(spark, d):
    """Grid edges as lines with a bend in the middle that depends on the id, both ways between some ends."""
    n = fx.nodes(spark, d).select("node_id", "x", "y")
    e = fx.edges(spark, d).select("id", "u", "v", "lanes", "highway", "length")
    for end in ("u", "v"):
        e = e.join(n.withColumnsRenamed({"node_id": end, "x": f"{end}x", "y": f"{end}y"}), end)
    bend = F.struct(((F.col("ux") + F.col("vx")) / 2 + F.col("u") % 7).alias("x"), ((F.col("uy") + F.col("vy")) / 2 + F.col("u") % 7).alias("y"))
    e = e.withColumn("geometry", F.array(geo.point("ux", "uy"), bend, geo.point("vx", "vy")))
    back = e.where("u % 3 = 0").withColumn("id", F.concat("id", F.lit("r"))).withColumn("geometry", F.array(geo.point("vx", "vy"), geo.point("ux", "uy")))
    return e.unionByName(back)


BENT = """SELECT e.id, e.u, e.v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bw, (a.x + b.x) / 2 + e.u % 7 AS mx, (a.y + b.y) / 2 + e.u % 7 AS my FROM fx_edges e JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v"""
LENGTH = "sqrt((mx - ax) * (mx - ax) + (my - ay) * (my - ay)) + sqrt((mx - bx) * (mx - bx) + (my - bw) * (my - bw))"


def detours(spark, d):
    """The lines and, beside some, another between the same ends whose bend lies elsewhere."""
    e = lines(spark, d)
    bend = F.struct(((F.col("ux") + F.col("vx")) / 2 + F.col("u") % 5 * 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2 - F.col("u") % 5 * 2).alias("y"))
    other = e.where("u % 4 < 2 and id not like '%r'").withColumn("id", F.concat("id", F.lit("x"))).withColumn("geometry", F.array(geo.point("ux", "uy"), bend, geo.point("vx", "vy")))
    return e.unionByName(other)


DETOURS = "SELECT id, u, v, ax, ay, bx, bw, mx, my FROM bent_ UNION ALL SELECT id || 'x', u, v, ax, ay, bx, bw, (ax + bx) / 2 + u % 5 * 2, (ay + bw) / 2 - u % 5 * 2 FROM bent_ WHERE u % 4 < 2"


@query(f"SELECT arg_min(id, (-len, id)) AS id, round(max(len), 6) AS length FROM (SELECT *, {LENGTH} AS len FROM detour_) GROUP BY u, v", bent_=BENT, detour_=DETOURS)
def parallel_keep_longest(spark, d):
    k = streets.keep_longest(detours(spark, d).select("id", "geometry"))
    return k.select("id", F.round(geo.length(F.col("geometry")), 6).alias("length"))


@query(
    """SELECT u, v, i, round(avg(CASE WHEN want <= l1 THEN ax + want / l1 * (mx - ax) ELSE mx + (want - l1) / l2 * (bx - mx) END), 6) AS x, round(avg(CASE WHEN want <= l1 THEN ay + want / l1 * (my - ay) ELSE my + (want - l1) / l2 * (bw - my) END), 6) AS y
    FROM (SELECT *, i * (l1 + l2) / 4 AS want FROM (SELECT *, sqrt(pow(mx - ax, 2) + pow(my - ay, 2)) AS l1, sqrt(pow(mx - bx, 2) + pow(my - bw, 2)) AS l2 FROM detour_), (SELECT unnest(range(5)) AS i)) GROUP BY u, v, i""",
    bent_=BENT,
    detour_=DETOURS,
)
def parallel_mean(spark, d):
    m = streets.mean_parallel(detours(spark, d).where("id not like '%r'").select("u", "v", "geometry"), 5)
    return m.select("u", "v", F.posexplode("geometry").alias("i", "p")).select("u", "v", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("SELECT node_id, node_id - 1 AS \"into\" FROM fx_nodes WHERE node_id % 10 = 4 AND node_id % 40 > 0 AND node_id - 1 IN (SELECT node_id FROM fx_nodes)")
def close_endpoints(spark, d):
    n = fx.nodes(spark, d).withColumn("x", F.when((F.col("node_id") % 10 == 4) & (F.col("node_id") % 40 > 0), F.col("x") - 46).otherwise(F.col("x")))
    return streets.merge_close(n, 5)


@query("SELECT id, 'LINESTRING (' || CAST(ax AS BIGINT) || '.0 ' || CAST(ay AS BIGINT) || '.0, ' || CAST(bx AS BIGINT) || '.0 ' || CAST(bw AS BIGINT) || '.0)' AS wkt, CAST(2 AS INTEGER) AS n FROM bent_", bent_=BENT)
def edge_wkt(spark, d):
    g = writers.edge_geometry(fx.edges(spark, d).select("id", "u", "v", F.lit(None).cast(readers.LINE).alias("geometry")), fx.nodes(spark, d))
    wkt = writers.to_wkt(F.col("geometry"))
    return g.select("id", wkt.alias("wkt"), F.size(readers.from_wkt(wkt)).alias("n"))


@query("SELECT CASE WHEN highway = 'primary' THEN 'pipes' WHEN highway = 'track' THEN 'rivers' WHEN highway = 'footway' THEN 'grates' ELSE 'orifices' END AS layer, count(*) AS n FROM fx_edges GROUP BY 1")
def layer_counts(spark, d):
    e = fx.edges(spark, d).withColumn("edge_type", F.when(F.col("highway") == "primary", "pipe").when(F.col("highway") == "track", "river").otherwise("orifice"))
    e = e.withColumn("id", F.when(F.col("highway") == "footway", F.concat("id", F.lit("-grate"))).otherwise(F.col("id")))
    n = fx.nodes(spark, d).withColumn("node_type", F.lit(None).cast("string"))
    return writers.layers(Network(n, e))[0].groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT node_id, json_extract_string(f, '$.geometry.type') AS shape FROM (SELECT node_id, '{\"geometry\":{\"type\":\"Point\"}}' AS f FROM fx_nodes)")
def geojson_nodes(spark, d):
    f = writers.node_features(fx.nodes(spark, d))
    return f.select(F.get_json_object("feature", "$.properties.node_id").cast("long").alias("node_id"), F.get_json_object("feature", "$.geometry.type").alias("shape"))


@query("SELECT count(*) AS n_nodes, (SELECT count(*) FROM fx_edges) AS n_edges, (SELECT CAST(sum(length) AS DOUBLE) FROM fx_edges) AS total FROM (SELECT u FROM fx_edges UNION SELECT v FROM fx_edges)")
def graph_from_lines(spark, d):
    g = lines(spark, d).where("id not like '%r'")
    chord = F.array(F.element_at("geometry", 1), F.element_at("geometry", -1))
    n, e = readers.graph_from_lines(g.select("id", chord.alias("geometry")))
    return e.agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 6).alias("total")).crossJoin(n.agg(F.count("*").alias("n_nodes")))


PIECES = "SELECT u // 12 AS chain, u % 12 AS pos, id, 50::DOUBLE + u % 4 AS length, 0.3::DOUBLE + u % 5 * 0.075::DOUBLE AS diameter, 0.01::DOUBLE + u % 3 * 0.001::DOUBLE AS roughness, (u % 7)::DOUBLE AS contributing_area, (u % 2)::DOUBLE AS in_offset, (u % 3)::DOUBLE AS out_offset FROM fx_edges WHERE v = u + 40"


def pieces(spark, d):
    k = F.col("u")
    return fx.edges(spark, d).where("v = u + 40").select(
        F.floor(k / 12).alias("chain"), (k % 12).alias("pos"), (F.lit(50.0) + k % 4).alias("length"), (F.lit(0.3) + k % 5 * 0.075).alias("diameter"), (F.lit(0.01) + k % 3 * 0.001).alias("roughness"),
        (k % 7).cast("double").alias("contributing_area"), (k % 2).cast("double").alias("in_offset"), (k % 3).cast("double").alias("out_offset"),
    )


@query("SELECT chain, sum(length) AS length, max(diameter) AS diameter, round(sum(roughness * length) / sum(length), 6) AS roughness, sum(contributing_area) AS contributing_area, arg_min(in_offset, pos) AS in_offset, arg_max(out_offset, pos) AS out_offset FROM pieces_ GROUP BY chain", pieces_=PIECES)
def chain_merge(spark, d):
    m = simplify.merge_chain(pieces(spark, d))
    return m.withColumn("roughness", F.round("roughness", 6))


@query(
    "SELECT DISTINCT chain, min(pos) AS pos FROM (SELECT p.*, k FROM sums_ p, LATERAL (SELECT unnest(range(1, CAST(p.n AS BIGINT))) AS k) WHERE p.upto >= k * p.total / p.n - 1e-6::DOUBLE AND p.upto < p.total - 1e-6::DOUBLE) GROUP BY chain, k",
    pieces_=PIECES,
    sums_="SELECT chain, pos, sum(length) OVER (PARTITION BY chain ORDER BY pos) AS upto, sum(length) OVER (PARTITION BY chain) AS total, ceil(sum(length) OVER (PARTITION BY chain) / 200) AS n FROM pieces_",
)
def chain_split_points(spark, d):
    return simplify.split_points(pieces(spark, d), 200)


@query("SELECT coalesce(i, node_id) AS node, sum(contributing_area) AS area FROM fx_nodes LEFT JOIN (SELECT node_id AS g, node_id - node_id % 5 AS i FROM fx_nodes WHERE node_id % 5 IN (1, 2)) ON g = node_id GROUP BY 1")
def area_redistribute(spark, d):
    n = fx.nodes(spark, d)
    m = n.where("node_id % 5 in (1, 2)").select("node_id", (F.col("node_id") - F.col("node_id") % 5).alias("into"))
    return simplify.redistribute(n.select(F.col("node_id").alias("node"), F.col("contributing_area").alias("area")), m)


@query()
def dangling_removed(spark, d):
    n = fx.nodes(spark, d)
    return simplify.dangling(succ(spark, d), n.select(F.col("node_id").alias("node"), F.col("contributing_area").alias("area")), n.where("node_id % 50 = 0").select(F.col("node_id").alias("node")), 1500)


@query("SELECT id, round(50 * w * 2, 6) AS area FROM (SELECT id, CASE lanes WHEN '2' THEN 2 WHEN '2;1' THEN 3 ELSE 3 END * 3.5::DOUBLE AS w FROM fx_edges)")
def street_cover(spark, d):
    from ..functions.text import number_sum

    l = lines(spark, d).where("id not like '%r'").select("id", F.col("ux").alias("ax"), F.col("uy").alias("ay"), F.col("vx").alias("bx"), F.col("vy").alias("by"), number_sum(F.col("lanes")).alias("lanes_n"))
    return streets.covers(l, 3.5).select("id", F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


@query("SELECT outlet_id, round(sum(area) / 10000, 6) AS ha, count(*) AS n FROM fx_subs GROUP BY outlet_id HAVING count(*) > 1")
def sub_area_ha(spark, d):
    return fx.subs(spark, d).groupBy("outlet_id").agg(F.round(F.sum("area") / 10_000, 6).alias("ha"), F.count("*").alias("n")).where("n > 1")


