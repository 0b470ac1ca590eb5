"""Emission rules, set operations, sinks and further rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..network import Network
from ..operators import graph, network, outfalls, ponds, raster, spatial
from ..plans import emit
from ..sources import fixtures as fx
from .base import query
from .graphs import KEPT

TYPED = "SELECT u, v, id, length, CASE highway WHEN 'primary' THEN 'pipe' WHEN 'residential' THEN 'river' WHEN 'footway' THEN 'outfall' WHEN 'tertiary' THEN 'street_channel' ELSE 'pond_connector' END AS edge_type, 0.3::DOUBLE + u % 5 * 0.075::DOUBLE AS diameter FROM fx_edges"


def typed(spark, d):
    kind = F.create_map(*[F.lit(x) for kv in {"primary": "pipe", "residential": "river", "footway": "outfall", "tertiary": "street_channel", "track": "pond_connector"}.items() for x in kv])
    return fx.edges(spark, d).select("u", "v", "id", "length", kind[F.col("highway")].alias("edge_type"), (F.lit(0.3) + F.col("u") % 5 * 0.075).alias("diameter"), F.lit(None).cast("double").alias("channel_depth"))


@query("SELECT node_id, round(greatest(CASE WHEN node_id % 3 = 0 THEN 3 ELSE 1.5::DOUBLE END, coalesce(h, 0)), 6) AS max_depth FROM fx_nodes LEFT JOIN (SELECT n, max(diameter * 10) AS h FROM (SELECT u AS n, diameter FROM typed_ UNION ALL SELECT v, diameter FROM typed_) GROUP BY n) ON n = node_id", typed_=TYPED)
def node_max_depth(spark, d):
    n = fx.nodes(spark, d).withColumn("chamber_floor_elevation", F.col("surface_elevation") - F.when(F.col("node_id") % 3 == 0, 0.25).otherwise(1.5))
    e = typed(spark, d).withColumn("diameter", F.col("diameter") * 10)
    return emit.max_depths(n, e).select("node_id", F.round("max_depth", 6).alias("max_depth"))


@query("SELECT v AS node_id FROM typed_ WHERE edge_type = 'river' EXCEPT SELECT u FROM typed_ WHERE edge_type IN ('river', 'pipe')", typed_=TYPED)
def terminal_rivers(spark, d):
    return emit.terminal_rivers(typed(spark, d).where("edge_type in ('river', 'pipe')"))


@query("SELECT v AS node_id FROM typed_ WHERE edge_type = 'river' EXCEPT SELECT u FROM typed_ WHERE edge_type IN ('river', 'pipe') UNION SELECT node_id FROM fx_nodes WHERE node_id % 97 = 3", typed_=TYPED)
def outfall_union(spark, d):
    n = fx.nodes(spark, d).withColumn("node_type", F.when(F.col("node_id") % 97 == 3, F.lit("river_outfall")))
    return emit.sinks(n, typed(spark, d).where("edge_type in ('river', 'pipe')"))


@query("SELECT id, round(CASE WHEN edge_type = 'outfall' THEN greatest(l, 5 * diameter, 5) WHEN edge_type IN ('street_channel', 'river') THEN greatest(l, 1) ELSE greatest(l, diameter, 1) END, 6) AS length FROM (SELECT *, (u % 4)::DOUBLE / 2 AS l FROM typed_)", typed_=TYPED)
def link_lengths(spark, d):
    return emit.link_lengths(typed(spark, d).withColumn("length", F.col("u") % 4 / 2)).select("id", F.round("length", 6).alias("length"))


@query("SELECT v AS node_id, count(*) AS n_in, round(greatest(sqrt(sum(diameter * diameter)), 0.45::DOUBLE), 6) AS diameter, round(greatest(5 * greatest(sqrt(sum(diameter * diameter)), 0.45::DOUBLE), 5), 6) AS length FROM typed_ WHERE v % 3 = 1 GROUP BY v HAVING count(*) > 1", typed_=TYPED)
def outfall_merger(spark, d):
    o = fx.nodes(spark, d).where("node_id % 3 = 1").select("node_id")
    return emit.merged_outfalls(typed(spark, d), o).select("node_id", "n_in", F.round("diameter", 6).alias("diameter"), F.round("length", 6).alias("length"))


@query("SELECT id FROM typed_ WHERE edge_type = 'pipe' UNION SELECT id || '-orifice' FROM typed_ WHERE edge_type = 'river' UNION SELECT id FROM typed_ WHERE edge_type = 'pipe' AND u % 2 = 0", typed_=TYPED)
def link_name_union(spark, d):
    e = typed(spark, d)
    return e.where("edge_type = 'pipe'").select("id").union(e.where("edge_type = 'river'").select(F.concat("id", F.lit("-orifice")))).union(e.where("edge_type = 'pipe' and u % 2 = 0").select("id")).distinct()


GONE = "SELECT u AS n FROM typed_ WHERE edge_type IN ('river', 'pond_connector') UNION SELECT v FROM typed_ WHERE edge_type IN ('river', 'outfall')"


@query("SELECT u, v FROM typed_ WHERE edge_type = 'pipe' AND u NOT IN (SELECT n FROM gone_) AND v NOT IN (SELECT n FROM gone_)", typed_=TYPED, gone_=GONE)
def filter_edge_types(spark, d):
    return network.keep_types(Network(fx.nodes(spark, d), typed(spark, d)), ["pipe"]).edges.select("u", "v")


@query("SELECT CASE WHEN zv > zu THEN v ELSE u END AS u, CASE WHEN zv > zu THEN u ELSE v END AS v, id FROM (SELECT e.*, a.surface_elevation AS zu, b.surface_elevation AS zv FROM fx_edges e JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v)")
def rivers_downhill(spark, d):
    return network.orient_downhill(fx.edges(spark, d).select("u", "v", "id"), fx.nodes(spark, d))


@query("SELECT e.id, a.x AS x0, a.y AS y0 FROM fx_edges e JOIN fx_nodes a ON a.node_id = u")
def fix_geometries(spark, d):
    n = fx.nodes(spark, d).select("node_id", "x", "y")
    e = fx.edges(spark, d).select("id", "u", "v")
    for end in ("u", "v"):
        e = e.join(n.withColumnsRenamed({"node_id": end, "x": f"{end}x", "y": f"{end}y"}), end)
    k = F.col("u") % 3
    e = e.withColumn("geometry", F.when(k == 0, F.array(geo.point("ux", "uy"), geo.point("vx", "vy"))).when(k == 1, F.array(geo.point("vx", "vy"), geo.point("ux", "uy"))).otherwise(F.array(geo.point("ux", "vy"), geo.point("vx", "vx"))))
    p = F.element_at("geometry", 1)
    return network.fix_geometry(e).select("id", p["x"].alias("x0"), p["y"].alias("y0"))


@query(
    "SELECT root, node, x + 1 AS x, y + 1 AS y FROM (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY surface_elevation, node) AS k, n.x, n.y FROM part_ JOIN fx_nodes n ON n.node_id = node WHERE root NOT IN (SELECT root FROM part_ WHERE node % 10 = 0)) WHERE k = 1",
    kept_=KEPT,
    both_="SELECT u, v FROM kept_ UNION SELECT v, u FROM kept_",
    reach_="SELECT u AS node, v AS root FROM both_ UNION SELECT r.node, b.v FROM reach_ r JOIN both_ b ON b.u = r.root",
    part_="SELECT node, least(node, min(root)) AS root FROM reach_ GROUP BY node",
)
def dummy_sinks(spark, d):
    e = fx.edges(spark, d).where("highway in ('primary', 'tertiary', 'residential')")
    parts = graph.components(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return outfalls.dummy_sinks(fx.nodes(spark, d), parts, fx.nodes(spark, d).where("node_id % 10 = 0"))


@query("SELECT node_id, surface_elevation FROM (SELECT node_id, surface_elevation, value FROM fx_nodes LEFT JOIN fx_dem ON row_ = CAST(floor(y / 50) AS BIGINT) AND col_ = CAST(floor(x / 50) AS BIGINT)) WHERE value IS NULL OR value / 3 <= surface_elevation")
def uphill_prune(spark, d):
    n = fx.nodes(spark, d)
    stage = raster.at_cell(n.select("node_id", "x", "y"), fx.dem(spark, d), 50).select("node_id", (F.col("value") / 3).alias("stage"))
    return outfalls.drop_adverse(n.join(stage, "node_id", "left")).select("node_id", "surface_elevation")



def _gradient(a, b):
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0 ELSE (coalesce({a}, value) - coalesce({b}, value)) / (10 * (CASE WHEN {a} IS NULL THEN 0 ELSE 1 END + CASE WHEN {b} IS NULL THEN 0 ELSE 1 END)) END"


@query(
    f"SELECT row_, col_, round(sqrt(pow({_gradient('e', 'w')}, 2) + pow({_gradient('n', 's')}, 2)) * 100, 4) AS slope FROM around_",
    around_="SELECT c.row_, c.col_, c.value, w.value AS w, e.value AS e, s.value AS s, n.value AS n FROM fx_dem c LEFT JOIN fx_dem w ON w.row_ = c.row_ AND w.col_ = c.col_ - 1 LEFT JOIN fx_dem e ON e.row_ = c.row_ AND e.col_ = c.col_ + 1 LEFT JOIN fx_dem s ON s.row_ = c.row_ - 1 AND s.col_ = c.col_ LEFT JOIN fx_dem n ON n.row_ = c.row_ + 1 AND n.col_ = c.col_ WHERE c.value IS NOT NULL",
)
def raster_slope(spark, d):
    return raster.slope_pct(fx.dem(spark, d), 10).select("row_", "col_", F.round("slope", 4).alias("slope"))


@query("SELECT row_, col_, round(value - CASE WHEN row_ % 4 = 0 THEN 2 ELSE 0 END, 6) AS value FROM fx_dem")
def raster_burn(spark, d):
    c = fx.dem(spark, d)
    return raster.burn(c, c.where("row_ % 4 = 0"), 2).select("row_", "col_", F.round("value", 6).alias("value"))



RING = "row_ % 9 BETWEEN 1 AND 7 AND col_ % 9 BETWEEN 1 AND 7 AND NOT (row_ % 9 BETWEEN 3 AND 5 AND col_ % 9 BETWEEN 3 AND 5)"


@query(
    "SELECT row_, col_, min(id) AS id FROM back_ WHERE (row_, col_, id) NOT IN (SELECT (row_, col_, id) FROM ring_) GROUP BY row_, col_",
    ring_=f"SELECT row_, col_, row_ // 9 * 1000 + col_ // 9 AS id FROM fx_dem WHERE {RING}",
    shift_="SELECT r, c FROM (SELECT unnest(range(-2, 3)) AS r), (SELECT unnest(range(-2, 3)) AS c)",
    wide_="SELECT DISTINCT row_ + r AS row_, col_ + c AS col_, id FROM ring_, shift_",
    back_="SELECT row_ + r AS row_, col_ + c AS col_, id FROM wide_, shift_ GROUP BY 1, 2, 3 HAVING count(*) = 25",
)
def enclosed_gap(spark, d):
    """Catchments are rings of cells, one in each square of nine by nine."""
    c = fx.dem(spark, d)
    ring = c.where(RING).select("row_", "col_", (F.floor(F.col("row_") / 9) * 1000 + F.floor(F.col("col_") / 9)).cast("long").alias("id"))
    return raster.enclosed(ring, None, 2)


@query("SELECT p.pond_id, round(quantile_cont(value, 0.25), 6) AS crest FROM fx_ponds p JOIN fx_dem c ON sqrt(pow(c.col_ * 40 + 20 - x, 2) + pow(c.row_ * 40 + 20 - y, 2)) BETWEEN 50 AND 120 WHERE value IS NOT NULL AND abs(value) > 1e-6::DOUBLE GROUP BY p.pond_id")
def pond_crest(spark, d):
    c = fx.dem(spark, d).where("value is not null and abs(value) > 1e-6").select((F.col("col_") * 40 + 20).cast("double").alias("x2"), (F.col("row_") * 40 + 20).cast("double").alias("y2"), "value")
    near = spatial.near_points(fx.ponds(spark, d).select("pond_id", "x", "y"), c, 120).where("distance >= 50")
    return near.groupBy("pond_id").agg(F.round(F.percentile("value", F.lit(0.25)), 6).alias("crest"))


@query("SELECT pond_id, coalesce(a, b, c) AS anchor, CASE WHEN a IS NOT NULL THEN 'sub' WHEN b IS NOT NULL THEN 'river' ELSE 'node' END AS how FROM (SELECT pond_id, CASE WHEN pond_id % 3 = 0 THEN pond_id * 2 END AS a, CASE WHEN pond_id % 4 = 0 THEN pond_id * 3 END AS b, CASE WHEN pond_id % 2 = 0 THEN pond_id * 5 END AS c FROM fx_ponds) WHERE coalesce(a, b, c) IS NOT NULL")
def pond_anchors(spark, d):
    p = fx.ponds(spark, d)
    k = F.col("pond_id")
    return ponds.anchors(p, p.where("pond_id % 3 = 0").select("pond_id", (k * 2).alias("target")), p.where("pond_id % 4 = 0").select("pond_id", (k * 3).alias("node_id")), p.where("pond_id % 2 = 0").select("pond_id", (k * 5).alias("node_id")))


@query("SELECT node_id FROM fx_nodes WHERE node_id NOT IN (SELECT u FROM fx_edges WHERE highway <> 'track')")
def root_nodes(spark, d):
    return outfalls.root_nodes(fx.nodes(spark, d), fx.edges(spark, d).where("highway <> 'track'")).select("node_id")
