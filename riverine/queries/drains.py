"""Outfall identification, pond outlets and routing, consolidation of chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ponds as fn
from ..operators import design, outfalls, ponds, raster, simplify, spatial
from ..params import Hydraulics, Outfalls, Ponds
from ..sources import fixtures as fx
from .base import query
from .graphs import SUCC, succ
from .spatials import river_lines

P = Ponds()
#: Cells whose borders no node lies on.
CELL = 42.7

PIPE = "SELECT u, v, id, (40 + u % 23)::DOUBLE AS length FROM fx_edges WHERE highway <> 'track'"
STREET = "SELECT n.* FROM fx_nodes n WHERE node_id IN (SELECT u FROM pipe_ UNION SELECT v FROM pipe_)"
SIDES = """SELECT pond_id AS line_id, x + sx0 * h AS x0, y + sy0 * h AS y0, x + sx1 * h AS x1, y + sy1 * h AS y1 FROM (SELECT *, sqrt(area_m2) / 2 AS h FROM fx_ponds WHERE area_m2 > 50000), (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) s(sx0, sy0, sx1, sy1)"""
#: The point of a line nearest to a node, and how far it is.
FOOT = """SELECT node_id, kind, line_id, fx, fz, sqrt((x - fx) * (x - fx) + (y - fz) * (y - fz)) AS dist FROM (SELECT *, x0 + t * (x1 - x0) AS fx, y0 + t * (y1 - y0) AS fz FROM (
    SELECT s.node_id, s.x, s.y, l.*, least(1::DOUBLE, greatest(0::DOUBLE, ((s.x - x0) * (x1 - x0) + (s.y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM street_ s, line_ l))"""
LINE = "SELECT 'river_outfall' AS kind, river_id AS line_id, x AS x0, y0, x AS x1, y1 FROM fx_rivers UNION ALL SELECT 'water_body_outfall', line_id, x0, y0, x1, y1 FROM side_"
PAIR = f"""SELECT node_id, kind, m[1] AS dist, m[3] AS fx, m[4] AS fz FROM (SELECT node_id, kind, min(row(dist, line_id, fx, fz)) AS m FROM foot_ WHERE dist <= 150 GROUP BY node_id, kind) JOIN fx_nodes USING (node_id)
    LEFT JOIN fx_dem ON row_ = CAST(floor(m[4] / {CELL}::DOUBLE) AS BIGINT) AND col_ = CAST(floor(m[3] / {CELL}::DOUBLE) AS BIGINT) WHERE value IS NULL OR value / 3 <= surface_elevation"""
COMPONENT = "SELECT node_id, node_id FROM fx_nodes UNION SELECT b.v, min(p.root) FROM comp_ p JOIN both_ b ON b.u = p.node JOIN recurring.comp_ r ON r.node = b.v GROUP BY b.v, r.root HAVING min(p.root) < r.root"
KRUSKAL = """SELECT a, a FROM arc_ UNION SELECT b, b FROM arc_ UNION ALL SELECT -1, 1 UNION (
    WITH now AS (SELECT c.k, p.part AS pa, q.part AS pb FROM recurring.tree_ z JOIN arc_ c ON c.k = z.part JOIN recurring.tree_ p ON p.node = c.a JOIN recurring.tree_ q ON q.node = c.b WHERE z.node = -1)
    SELECT r.node, least(pa, pb) FROM now JOIN recurring.tree_ r ON (r.node >= 0 OR r.node < -1000000000) AND r.part = greatest(pa, pb) WHERE pa <> pb UNION ALL SELECT -k - 1, CASE WHEN pa <> pb THEN 1 ELSE 0 END FROM now UNION ALL SELECT -1, k + 1 FROM now)"""
LINKS = {
    "pipe_": PIPE,
    "street_": STREET,
    "side_": SIDES,
    "line_": LINE,
    "foot_": FOOT,
    "pair_": PAIR,
    "both_": "SELECT u, v FROM pipe_ UNION ALL SELECT v, u FROM pipe_",
    "comp_(node, root) USING KEY (node)": COMPONENT,
    "low_": "SELECT min(row(surface_elevation, node_id, x, y)) AS m FROM street_ JOIN comp_ ON node = node_id WHERE root NOT IN (SELECT root FROM pair_ JOIN comp_ ON node = node_id) GROUP BY root",
    "link_": """SELECT node_id AS u, CASE kind WHEN 'river_outfall' THEN 1 ELSE 2 END * 1000000000000 + node_id AS v, kind, dist AS length, fx AS x, fz AS y, (SELECT median(length) FROM pipe_) AS weight FROM pair_ UNION ALL
        SELECT m[2], 3000000000000 + m[2], 'dummy_river', (SELECT median(length) FROM pipe_), m[3] + 1, m[4] + 1, (SELECT median(length) FROM pipe_) FROM low_""",
    "arc_": """SELECT a, b, min(w) AS w, row_number() OVER (ORDER BY min(w), a, b) AS k FROM (SELECT least(u, v) AS a, greatest(u, v) AS b, length AS w FROM pipe_ UNION ALL SELECT u, v, weight FROM link_ UNION ALL
        SELECT least(n, -4611686018427387904), greatest(n, -4611686018427387904), 0 FROM (SELECT v AS n FROM link_ UNION ALL SELECT node_id FROM fx_nodes WHERE node_id NOT IN (SELECT u FROM pipe_ UNION SELECT u FROM link_))) GROUP BY a, b""",
    "tree_(node, part) USING KEY (node)": KRUSKAL,
}


def street_network(spark, d):
    pipes = fx.edges(spark, d).where("highway <> 'track'").select("u", "v", "id", F.lit("pipe").alias("edge_type"), (F.lit(40.0) + F.col("u") % 23).alias("length"))
    return fx.nodes(spark, d).withColumn("node_type", F.lit(None).cast("string")), pipes


def boxes(spark, d, least: float = 0, key: str = "pond_id"):
    h = F.sqrt("area_m2") / 2
    corner = lambda a, b: F.struct((F.col("x") + a * h).alias("x"), (F.col("y") + b * h).alias("y"))
    return fx.ponds(spark, d).where(F.col("area_m2") > least).select(F.col("pond_id").alias(key), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


def stages(spark, d):
    return fx.dem(spark, d).select("row_", "col_", (F.col("value") / 3).alias("value"))


@query("SELECT u, v, kind, round(length, 5) AS length, round(x, 4) AS x, round(y, 4) AS y FROM link_ JOIN arc_ ON a = u AND b = v JOIN tree_ ON node = -k - 1 AND part = 1", **LINKS)
def identify_outfalls(spark, d):
    n, e = street_network(spark, d)
    sinks, links = outfalls.identify(n, e, river_lines(spark, d), Outfalls(include_water_body_outfalls=True), boxes(spark, d, 50_000), stages(spark, d), CELL)
    at = sinks.select(F.col("node_id").alias("v"), F.col("node_type").alias("kind"), "x", "y")
    return links.join(at, "v").select("u", "v", "kind", F.round("length", 5).alias("length"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT node_id, kind, round(dist, 5) AS distance, round(fx, 4) AS x, round(fz, 4) AS y FROM pair_", **{k: v for k, v in LINKS.items() if k in ("pipe_", "street_", "side_", "line_", "foot_", "pair_")})
def pair_receiving(spark, d):
    n, e = street_network(spark, d)
    ends = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    pairs = outfalls.pair_receiving(n.join(ends, "node_id", "left_semi"), river_lines(spark, d), boxes(spark, d, 50_000), Outfalls(include_water_body_outfalls=True), stages(spark, d), CELL)
    return pairs.select("node_id", "kind", F.round("distance", 5).alias("distance"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT v AS node_id, value / 3 AS surface_elevation FROM (SELECT 1000000000000 + node_id AS v, fx, fz FROM pair_ WHERE kind = 'river_outfall') JOIN fx_dem ON row_ = CAST(floor(fz / 42.7::DOUBLE) AS BIGINT) AND col_ = CAST(floor(fx / 42.7::DOUBLE) AS BIGINT) WHERE value IS NOT NULL", **{k: v for k, v in LINKS.items() if k in ("pipe_", "street_", "side_", "line_", "foot_", "pair_")})
def sink_stages(spark, d):
    n, e = street_network(spark, d)
    ends = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    pairs = outfalls.pair_receiving(n.join(ends, "node_id", "left_semi"), river_lines(spark, d), None, Outfalls(), stages(spark, d), CELL)
    sinks = pairs.select((F.lit(outfalls.SINK) + F.col("node_id")).alias("node_id"), "x", "y")
    return outfalls.stage_elevations(sinks, stages(spark, d), CELL).select("node_id", "surface_elevation")


#: Storages lie up to 24 m off their basin's middle; basins reach 10 to 30 m each way.
STORAGES = "SELECT pond_id, x + pond_id % 5 * 6 AS x, y, area_m2 FROM fx_ponds"
BASINS = "SELECT pond_id AS basin_id, x, y, (10 + pond_id % 3 * 10)::DOUBLE AS h FROM fx_ponds"
OFF = "sqrt(pow(greatest(abs({a}.x - {b}.x) - {b}.h, 0), 2) + pow(greatest(abs({a}.y - {b}.y) - {b}.h, 0), 2))"


def storages(spark, d):
    return fx.ponds(spark, d).select("pond_id", (F.col("x") + F.col("pond_id") % 5 * 6).alias("x"), "y", "area_m2")


def basins(spark, d):
    h = 10.0 + F.col("pond_id") % 3 * 10
    corner = lambda a, b: F.struct((F.col("x") + a * h).alias("x"), (F.col("y") + b * h).alias("y"))
    return fx.ponds(spark, d).select(F.col("pond_id").alias("basin_id"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


OWN = f"SELECT s.pond_id, arg_min(b.basin_id, ({OFF.format(a='s', b='b')}, b.basin_id)) AS basin_id FROM storage_ s JOIN basin_ b ON {OFF.format(a='s', b='b')} <= 5 WHERE s.area_m2 >= 10000 GROUP BY s.pond_id"


@query("SELECT pond_id, basin_id FROM own_", storage_=STORAGES, basin_=BASINS, own_=OWN)
def pond_footprints(spark, d):
    found = outfalls.storage_basins(storages(spark, d), basins(spark, d), Outfalls(pond_intake_min_area_m2=10_000))
    return found.select("pond_id", "basin_id")


@query(
    """SELECT s.node_id AS u, pond_id AS v, round(sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)), 6) AS length FROM (SELECT s.node_id, s.x, s.y, arg_min(o.pond_id, (off, o.pond_id)) AS pond_id FROM (
        SELECT s.node_id, s.x, s.y, o.pond_id, {off} AS off FROM street_ s, (SELECT o.pond_id, b.* FROM own_ o JOIN basin_ b USING (basin_id)) o WHERE s.node_id % 7 <> 0) s JOIN own_ o USING (pond_id) WHERE off <= 30 GROUP BY 1, 2, 3) s JOIN storage_ t USING (pond_id)
    WHERE s.node_id % 3 = pond_id % 3""".replace("{off}", OFF.format(a="s", b="o")),
    pipe_=PIPE,
    street_=STREET,
    storage_=STORAGES,
    basin_=BASINS,
    own_=OWN,
)
def pond_intakes(spark, d):
    """Components are given here as three: nodes and ponds by their ids."""
    n, e = street_network(spark, d)
    ends = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    streets = n.join(ends, "node_id", "left_semi")
    found = outfalls.storage_basins(storages(spark, d), basins(spark, d), Outfalls(pond_intake_min_area_m2=10_000))
    parts = n.select(F.col("node_id").alias("node")).unionByName(storages(spark, d).select(F.col("pond_id").alias("node"))).withColumn("root", F.col("node") % 3)
    links = outfalls.intakes(streets, found, storages(spark, d), parts, n.where("node_id % 7 = 0").select("node_id"), Outfalls())
    return links.select("u", "v", F.round("length", 6).alias("length"))


LOW = "SELECT node_id, x, y, surface_elevation - 3 AS invert, CASE WHEN node_id % 6 = 1 THEN 'river_outfall' END AS node_type FROM fx_nodes"
TOPS = "SELECT pond_id, x, y, area_m2, (8 + pond_id % 9)::DOUBLE AS top, 1.5::DOUBLE AS depth FROM fx_ponds"
NEAR = """SELECT p.pond_id, min(row(sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)), n.node_id, n.invert)) AS m FROM top_ p JOIN floor_ n ON sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 750
    AND n.invert + 0.001::DOUBLE * sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) < p.top WHERE NOT EXISTS (SELECT 1 FROM fx_rivers r WHERE least(p.x, n.x) < r.x AND greatest(p.x, n.x) > r.x) GROUP BY p.pond_id"""
TIER = """SELECT *, CASE WHEN NOT (anchor_invert >= top AND anchor_type IS DISTINCT FROM 'river_outfall') THEN 'anchor' WHEN canal_dist <= 750 AND (m IS NULL OR canal_dist < m[1]) AND canal_stage + 0.001::DOUBLE * canal_dist < top THEN 'canal' WHEN m IS NOT NULL THEN 'rerouted' ELSE 'closed' END AS tier
    FROM (SELECT p.*, a.node_id AS anchor, a.invert AS anchor_invert, a.node_type AS anchor_type, a.x AS ax, a.y AS ay, n.m, r.x AS canal_x, abs(p.x - r.x) AS canal_dist, c.value / 3 AS canal_stage FROM top_ p
        JOIN (SELECT p.pond_id, arg_min(n.node_id, (sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)), n.node_id)) AS node_id FROM top_ p JOIN fx_nodes n ON sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 200 GROUP BY p.pond_id) q USING (pond_id)
        JOIN floor_ a ON a.node_id = q.node_id LEFT JOIN near_ n ON n.pond_id = p.pond_id
        LEFT JOIN (SELECT p.pond_id, arg_min(r.x, (abs(p.x - r.x), river_id)) AS x FROM top_ p, fx_rivers r WHERE abs(p.x - r.x) <= 750 GROUP BY p.pond_id) r ON r.pond_id = p.pond_id
        LEFT JOIN fx_dem c ON c.row_ = CAST(floor(p.y / 42.7::DOUBLE) AS BIGINT) AND c.col_ = CAST(floor(r.x / 42.7::DOUBLE) AS BIGINT))"""
TIERS = {"floor_": LOW, "top_": TOPS, "near_": NEAR, "tier_": TIER}


def tiers(spark, d):
    n = fx.nodes(spark, d).select("node_id", "x", "y", (F.col("surface_elevation") - 3).alias("invert"), F.when(F.col("node_id") % 6 == 1, F.lit("river_outfall")).alias("node_type"))
    p = fx.ponds(spark, d).select("pond_id", "x", "y", "area_m2", (F.lit(8.0) + F.col("pond_id") % 9).alias("top"), F.lit(1.5).alias("depth"))
    lines = river_lines(spark, d)
    first = spatial.nearest_points(p.select("pond_id", "x", "y"), n.select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2")), 200, "pond_id", "node_id").select("pond_id", F.col("node_id").alias("anchor"))
    near = ponds.drainable_anchors(p, n, lines, P.downstream_search_max_m)
    canal = spatial.nearest_lines(p.select(F.col("pond_id").alias("node_id"), "x", "y"), lines, P.downstream_search_max_m).select(F.col("node_id").alias("pond_id"), F.col("distance").alias("canal_dist"), F.col("x").alias("canal_x"), F.col("y").alias("canal_y"))
    stage = raster.at_cell(canal.select("pond_id", F.col("canal_x").alias("x"), F.col("canal_y").alias("y")), stages(spark, d), CELL, "pond_id").withColumnRenamed("value", "canal_stage")
    at = n.select(F.col("node_id").alias("anchor"), F.col("invert").alias("anchor_invert"), F.col("node_type").alias("anchor_type"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    to = n.select(F.col("node_id").alias("near_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return ponds.outlet_tiers(p.join(first, "pond_id").join(at, "anchor").join(near, "pond_id", "left").join(to, "near_id", "left").join(canal, "pond_id", "left").join(stage, "pond_id", "left"), P)


@query("SELECT pond_id, tier, CASE tier WHEN 'canal' THEN NULL WHEN 'rerouted' THEN m[2] ELSE anchor END AS target, round(CASE tier WHEN 'canal' THEN canal_stage WHEN 'rerouted' THEN m[3] ELSE anchor_invert END, 6) AS target_invert FROM tier_", **TIERS)
def pond_outlets(spark, d):
    return tiers(spark, d).select("pond_id", "tier", "target", F.round("target_invert", 6).alias("target_invert"))


ENDED = "SELECT *, CASE tier WHEN 'canal' THEN canal_x WHEN 'rerouted' THEN (SELECT x FROM fx_nodes WHERE node_id = m[2]) ELSE ax END AS tx, CASE tier WHEN 'canal' THEN y WHEN 'rerouted' THEN (SELECT y FROM fx_nodes WHERE node_id = m[2]) ELSE ay END AS tz, CASE tier WHEN 'canal' THEN canal_stage WHEN 'rerouted' THEN m[3] ELSE anchor_invert END AS low, CASE tier WHEN 'canal' THEN -pond_id - 1000000000000 WHEN 'rerouted' THEN m[2] ELSE anchor END AS target FROM tier_"


@query(
    """SELECT u, v, kind AS edge_type, round(CASE WHEN kind = 'pond_outflow' THEN far ELSE greatest(sqrt(pow((tx - x) * 0.1::DOUBLE, 2) + pow((tz - y) * 0.1::DOUBLE, 2)), 0.1::DOUBLE) END, 5) AS length, round(CASE WHEN kind = 'pond_outflow' THEN CASE WHEN top - depth < low + 0.001::DOUBLE * far THEN low - (top - depth) + 0.001::DOUBLE * far ELSE 0 END END, 6) AS in_offset
    FROM (SELECT *, greatest(sqrt(pow((tx - x) * 0.9::DOUBLE, 2) + pow((tz - y) * 0.9::DOUBLE, 2)), 1) AS far FROM end_) JOIN (VALUES ('orifice'), ('weir'), ('pond_outflow')) k(kind) ON true, LATERAL (SELECT CASE WHEN kind = 'pond_outflow' THEN -pond_id ELSE pond_id END AS u, CASE WHEN kind = 'pond_outflow' THEN target ELSE -pond_id END AS v)""",
    **TIERS,
    end_=ENDED,
)
def pond_outlet_links(spark, d):
    t = tiers(spark, d).withColumn("orifice", fn.orifice(fn.volume(F.col("area_m2"), P))).withColumn("weir_crest", P.weir_crest_ratio * F.col("depth"))
    _, e = ponds.outlet_links(t, P)
    return e.select("u", "v", "edge_type", F.round("length", 5).alias("length"), F.round("in_offset", 6).alias("in_offset"))


DOWN = "SELECT node, node AS low, 0 AS hops FROM succ_ UNION ALL SELECT b.node, s.next, hops + 1 FROM down_ b JOIN succ_ s ON s.node = b.low WHERE s.next IS NOT NULL"


@query(
    "SELECT node AS pond_id FROM down_ JOIN succ_ e ON e.node = low JOIN fx_nodes a ON a.node_id = down_.node JOIN fx_nodes t ON t.node_id = low WHERE e.next IS NULL AND down_.node % 8 = 2 AND a.surface_elevation + 1 - (t.surface_elevation - low % 2) >= CASE WHEN low % 3 = 0 THEN 0.1::DOUBLE + 0.001::DOUBLE * 50 * hops ELSE 2 END".replace("SELECT node AS", "SELECT down_.node AS"),
    succ_=SUCC,
    down_=DOWN,
)
def viable_ponds(spark, d):
    s = succ(spark, d)
    n = fx.nodes(spark, d)
    e = s.where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"), F.lit(50.0).alias("length"))
    heads = n.where("node_id % 8 = 2").select(F.col("node_id").alias("pond_id"), (F.col("surface_elevation") + 1).alias("head"))
    ends = s.where("next is null").join(n.select(F.col("node_id").alias("node"), "surface_elevation"), "node").select("node", (F.col("surface_elevation") - F.col("node") % 2).alias("invert"), (F.col("node") % 3 == 0).alias("is_stage"))
    return ponds.viable(e, heads, ends, P).select("pond_id")


@query(
    "SELECT u, CASE WHEN move THEN v + 1000000 ELSE v END AS v, CASE WHEN move THEN 'pond_inflow' ELSE 'pipe' END AS edge_type FROM (SELECT node AS u, next AS v, next % 10 = 4 AND node NOT IN (SELECT low FROM down_ WHERE down_.node % 10 = 4) AS move FROM succ_ WHERE next IS NOT NULL)",
    succ_=SUCC,
    down_=DOWN,
)
def pond_inflows(spark, d):
    s = succ(spark, d).where("next is not null")
    pipes = s.select(F.col("node").alias("u"), F.col("next").alias("v"), F.lit("pipe").alias("edge_type"), F.concat_ws("-", "node", "next").alias("id"))
    outs = fx.nodes(spark, d).where("node_id % 10 = 4").select(F.col("node_id").alias("node"))
    carried = ponds.carriers(pipes, outs)
    return ponds.routed_inflows(pipes, outs.withColumn("pond_id", F.col("node") + 1_000_000), carried).select("u", "v", "edge_type")


FEED = "SELECT id, a.surface_elevation - 2 AS u_invert, b.surface_elevation - 3 AS d_invert, b.surface_elevation - 4 + u % 5 * 0.5::DOUBLE AS p_invert, b.surface_elevation - u % 3 * 0.25::DOUBLE AS p_top, length, CASE WHEN u % 4 > 0 THEN u % 4 * 0.1::DOUBLE END AS out_offset FROM fx_edges JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v"


@query(
    """SELECT id, CASE WHEN flat THEN 3 WHEN deeper THEN 2 ELSE 1 END AS tier, round(pond, 6) AS pond_invert, round(inside, 6) AS in_offset, round(CASE WHEN flat THEN pond + inside + 0.001::DOUBLE * length - u_invert ELSE coalesce(out_offset, 0) END, 6) AS out_offset
    FROM (SELECT *, (u_invert + coalesce(out_offset, 0) - pond - inside) / length < 0.001::DOUBLE AS flat FROM (SELECT *, greatest(d_invert - pond, 0) + 0.3::DOUBLE AS inside FROM (SELECT *, CASE WHEN deeper THEN greatest(d_invert, p_top - 3.81::DOUBLE) ELSE p_invert END AS pond FROM (SELECT *, p_invert > d_invert AND greatest(d_invert, p_top - 3.81::DOUBLE) < p_invert AS deeper FROM feed_))))""",
    feed_=FEED,
)
def pond_inflow_tiers(spark, d):
    n = fx.nodes(spark, d).select("node_id", F.col("surface_elevation").alias("z"))
    u = F.col("u")
    f = fx.edges(spark, d).join(n.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(n.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v")
    f = f.select("id", (F.col("zu") - 2).alias("u_invert"), (F.col("zv") - 3).alias("d_invert"), (F.col("zv") - 4 + u % 5 * 0.5).alias("p_invert"), (F.col("zv") - u % 3 * 0.25).alias("p_top"), "length", F.when(u % 4 > 0, u % 4 * 0.1).alias("out_offset"))
    return ponds.inflow_tiers(f, P).select("id", "tier", *[F.round(c, 6).alias(c) for c in ("pond_invert", "in_offset", "out_offset")])


VOLUME = "greatest((0.6431::DOUBLE + 2.5921::DOUBLE * area_m2 * 10.7639::DOUBLE) / 35.3147::DOUBLE, 0)"
OFFERS = {
    "held_": "SELECT node_id AS sub_id, 1000000 + node_id % 50 AS pond_id FROM fx_nodes WHERE node_id % 4 = 1",
    "pool_": f"SELECT pond_id, x, y, CASE WHEN pond_id % 9 = 0 THEN 0 ELSE 2 * ({VOLUME}) / 60 / (0.0254::DOUBLE * 0.5::DOUBLE) END AS cap, (SELECT sum(2500 * (1 + sub_id % 5)) FROM held_ h WHERE h.pond_id = p.pond_id) AS had FROM fx_ponds p",
    "offer_": """SELECT node_id AS sub_id, 2500 * (1 + node_id % 5) AS area, dd, pond_id FROM (SELECT n.node_id, n.x, n.y, p.pond_id, p.x AS px, sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) AS dd FROM fx_nodes n, pool_ p WHERE n.node_id NOT IN (SELECT sub_id FROM held_)
        AND sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 500 QUALIFY row_number() OVER (PARTITION BY n.node_id ORDER BY sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)), p.pond_id) = 1) o
        WHERE NOT EXISTS (SELECT 1 FROM fx_rivers r WHERE abs(o.x - r.x) <= 60 AND abs(o.x - r.x) < dd) AND NOT EXISTS (SELECT 1 FROM fx_rivers r WHERE least(o.x, px) < r.x AND greatest(o.x, px) > r.x)""",
    "order_": "SELECT *, row_number() OVER (PARTITION BY pond_id ORDER BY dd, sub_id) AS k FROM offer_",
    "fill_": """SELECT pond_id, CAST(NULL AS BIGINT) AS sub_id, CASE WHEN cap > 0 THEN cap - coalesce(had, 0) ELSE 1e300::DOUBLE END AS room, false AS taken, CAST(0 AS BIGINT) AS k FROM pool_ UNION ALL
        SELECT f.pond_id, o.sub_id, CASE WHEN o.area <= f.room THEN f.room - o.area ELSE f.room END, o.area <= f.room, o.k FROM fill_ f JOIN order_ o ON o.pond_id = f.pond_id AND o.k = f.k + 1""",
}


def sub_moves(spark, d):
    subs = fx.nodes(spark, d).select(F.col("node_id").alias("sub_id"), "x", "y", (2500.0 * (1 + F.col("node_id") % 5)).alias("area"))
    k = F.col("pond_id")
    pools = fx.ponds(spark, d).select("pond_id", "x", "y", F.when(k % 9 == 0, 0.0).otherwise(fn.volume(F.col("area_m2"), P) / 60).alias("volume"))
    drained = subs.where("sub_id % 4 = 1").select("sub_id", (F.lit(1_000_000) + F.col("sub_id") % 50).alias("pond_id"))
    return ponds.capacity_fill(ponds.reroute_offers(subs, pools, drained, river_lines(spark, d), P))


@query("SELECT pond_id, sub_id FROM fill_ WHERE taken", **OFFERS)
def pond_sub_moves(spark, d):
    return sub_moves(spark, d)


@query(
    "SELECT node_id, CASE WHEN node_id IN (SELECT sub_id FROM fill_ WHERE taken) THEN 0 ELSE area END + coalesce((SELECT sum(n.contributing_area) FROM fill_ f JOIN fx_nodes n ON n.node_id = f.sub_id WHERE taken AND f.pond_id = a.node_id), 0) AS contributing_area FROM (SELECT node_id, contributing_area AS area FROM fx_nodes UNION ALL SELECT pond_id, 0 FROM fx_ponds) a",
    **OFFERS,
)
def pond_moved_areas(spark, d):
    n = fx.nodes(spark, d).select("node_id", "contributing_area").unionByName(fx.ponds(spark, d).select(F.col("pond_id").alias("node_id"), F.lit(0.0).alias("contributing_area")))
    return ponds.moved_areas(n, sub_moves(spark, d)).select("node_id", "contributing_area")


CAP = "sqrt(greatest((a.surface_elevation - b.surface_elevation + u % 2 * 0.5::DOUBLE - v % 3 * 0.25::DOUBLE) / 50, 0.001::DOUBLE)) * pow(d / 4, 2::DOUBLE / 3) / 0.012::DOUBLE * pi() * d * d / 4"
CAPS = {
    "cap_": f"SELECT u AS node, min({CAP}) AS cap FROM (SELECT *, 0.3::DOUBLE + u % 5 * 0.075::DOUBLE AS d FROM fx_edges WHERE highway <> 'track') JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v GROUP BY u",
    "out_": "SELECT pond_id, unnest([pond_id % 97, pond_id % 89 + 100]) AS node FROM fx_ponds",
    "capped_": "SELECT pond_id, max(cap) AS cap FROM out_ JOIN cap_ USING (node) GROUP BY pond_id",
}


def caps(spark, d):
    u, v = F.col("u"), F.col("v")
    pipes = fx.edges(spark, d).where("highway <> 'track'").select("u", "v", "length", (0.3 + u % 5 * 0.075).alias("diameter"), (u % 2 * 0.5).alias("in_offset"), (v % 3 * 0.25).alias("out_offset"))
    floors = fx.nodes(spark, d).select("node_id", (F.col("surface_elevation") - 3).alias("chamber_floor_elevation"))
    outs = fx.ponds(spark, d).select("pond_id", F.explode(F.array(F.col("pond_id") % 97, F.col("pond_id") % 89 + 100)).alias("node"))
    return ponds.pipe_caps(outs, pipes, floors)


@query("SELECT pond_id, round(cap, 6) AS cap FROM capped_", **CAPS)
def pond_pipe_caps(spark, d):
    return caps(spark, d).select("pond_id", F.round("cap", 6).alias("cap"))


@query(
    """SELECT pond_id, CASE WHEN q <= jet * pi() * had * had / 4 THEN had ELSE coalesce((SELECT min(s) FROM (SELECT unnest([6, 8, 12, 18, 24, 30, 36]) * 0.0254::DOUBLE AS s) WHERE s > had AND s >= least(sqrt(4 * (q / jet) / pi()), 0.9144::DOUBLE)), greatest(had, 0.9144::DOUBLE)) END AS diameter
    FROM (SELECT pond_id, 8 * 0.0254::DOUBLE AS had, 0.65::DOUBLE * sqrt(2 * 9.81::DOUBLE * (1.2::DOUBLE + CASE WHEN pond_id % 5 = 0 THEN 2 ELSE 0 END)) AS jet, CASE WHEN cap > 0 THEN least(area_m2 / 50000 * 1.1::DOUBLE, cap * 0.8::DOUBLE) ELSE area_m2 / 50000 * 1.1::DOUBLE END AS q FROM fx_ponds LEFT JOIN capped_ USING (pond_id))""",
    **CAPS,
)
def pond_orifices_resized(spark, d):
    p = fx.ponds(spark, d).select("pond_id", F.lit(8 * 0.0254).alias("orifice"), F.lit(1.2).alias("depth"), (F.col("pond_id") % 5 == 0).alias("closed"), (F.col("area_m2") / 50_000).alias("q_in"))
    return ponds.resized_orifices(p.join(caps(spark, d), "pond_id", "left"), P)


@query("SELECT pond_id, round(0.65::DOUBLE * pi() * d * d / 4 * sqrt(2 * 9.81::DOUBLE * h) + 3 * least(greatest(0.1::DOUBLE * sqrt(area_m2), 3), 10) * pow(greatest(least(h - 0.9::DOUBLE * 2, 0.5::DOUBLE), 0), 1.5::DOUBLE), 6) AS release FROM (SELECT *, (6 + pond_id % 3 * 6) * 0.0254::DOUBLE AS d, 1 + pond_id % 4 * 0.75::DOUBLE AS h FROM fx_ponds)")
def pond_release(spark, d):
    k = F.col("pond_id")
    p = fx.ponds(spark, d).select("pond_id", ((6 + k % 3 * 6) * 0.0254).alias("orifice"), (1 + k % 4 * 0.75).alias("depth"), fn.weir_length(F.col("area_m2"), P).alias("weir_length"), F.lit(0.9 * 2).alias("weir_crest"))
    return ponds.release_capacity(p).select("pond_id", F.round("release", 6).alias("release"))


GAP_RING = "row_ % 9 BETWEEN 1 AND 7 AND col_ % 9 BETWEEN 1 AND 7 AND NOT (row_ % 9 BETWEEN 3 AND 5 AND col_ % 9 BETWEEN 3 AND 5)"


@query(
    "SELECT row_ * 50 + col_ AS sub_id, min(id) AS pond_id FROM back_ WHERE (row_, col_) NOT IN (SELECT (row_, col_) FROM ring_) AND (row_, col_) IN (SELECT (row_, col_) FROM fx_dem) GROUP BY row_, col_",
    ring_=f"SELECT row_, col_, row_ // 9 * 1000 + col_ // 9 AS id FROM fx_dem WHERE {GAP_RING}",
    shift_="SELECT r, c FROM (SELECT unnest(range(-2, 3)) AS r), (SELECT unnest(range(-2, 3)) AS c)",
    wide_="SELECT DISTINCT row_ + r AS row_, col_ + c AS col_, id FROM ring_, shift_",
    back_="SELECT row_ + r AS row_, col_ + c AS col_, id FROM wide_, shift_ GROUP BY 1, 2, 3 HAVING count(*) = 25",
)
def enclosed_gap_subs(spark, d):
    c = fx.dem(spark, d)
    ring = c.where(GAP_RING).select("row_", "col_", (F.floor(F.col("row_") / 9) * 1000 + F.floor(F.col("col_") / 9)).cast("long").alias("id"))
    return ponds.gap_reroutes(ring, c.select((F.col("row_") * 50 + F.col("col_")).alias("sub_id"), "row_", "col_"), 2)


SIMPLE = {
    "succ_": SUCC,
    "run_": "SELECT node AS u, next AS v, (50 + node % 4)::DOUBLE AS length, 0.3::DOUBLE + node % 5 * 0.075::DOUBLE AS diameter, 0.01::DOUBLE + node % 3 * 0.001::DOUBLE AS roughness, (node % 7)::DOUBLE AS area, (node % 2)::DOUBLE AS in_offset, (node % 3)::DOUBLE AS out_offset FROM succ_ WHERE next IS NOT NULL",
    "inner_": "SELECT v AS node FROM run_ WHERE v IN (SELECT u FROM run_) AND v % 97 <> 3 GROUP BY v HAVING count(*) = 1",
    "piece_": """SELECT r.v AS chain, 1 AS pos, r.* FROM run_ r WHERE r.v IN (SELECT node FROM inner_) AND r.u NOT IN (SELECT node FROM inner_) UNION ALL
        SELECT p.chain, p.pos + 1, r.* FROM piece_ p JOIN run_ r ON r.u = p.v WHERE p.v IN (SELECT node FROM inner_)""",
    "total_": "SELECT chain, sum(length) AS total, max(pos) AS last, ceil(sum(length) / 120) AS n FROM piece_ GROUP BY chain",
    "fold_": """SELECT chain, 0 AS pos, 0::DOUBLE AS far, 1 AS k, false AS cut FROM total_ UNION ALL
        SELECT f.chain, f.pos + 1, f.far + p.length, CASE WHEN hit THEN f.k + 1 ELSE f.k END, hit FROM fold_ f JOIN piece_ p ON p.chain = f.chain AND p.pos = f.pos + 1 JOIN total_ t ON t.chain = f.chain, LATERAL (SELECT p.pos < t.last AND t.total > 120 AND f.far + p.length >= f.k * t.total / t.n - 1e-6::DOUBLE AS hit)""",
    "part_": "SELECT p.*, (SELECT count(*) FROM fold_ f WHERE f.chain = p.chain AND f.pos < p.pos AND f.cut) AS part FROM piece_ p",
    "merged_": "SELECT chain, part, arg_min(u, pos) AS u, arg_max(v, pos) AS v, sum(length) AS length, max(diameter) AS diameter, sum(roughness * length) / sum(length) AS roughness, sum(area) AS area, arg_min(in_offset, pos) AS in_offset, arg_max(out_offset, pos) AS out_offset FROM part_ GROUP BY chain, part",
}


def run_network(spark, d):
    s = succ(spark, d).where("next is not null")
    k = F.col("node")
    e = s.select(
        k.alias("u"), F.col("next").alias("v"), F.concat_ws("-", "node", "next").alias("id"), F.lit("pipe").alias("edge_type"), (F.lit(50.0) + k % 4).alias("length"), (0.3 + k % 5 * 0.075).alias("diameter"), (0.01 + k % 3 * 0.001).alias("roughness"),
        (k % 7).cast("double").alias("contributing_area"), (k % 2).cast("double").alias("in_offset"), (k % 3).cast("double").alias("out_offset"),
    )
    return fx.nodes(spark, d).withColumn("node_type", F.when(F.col("node_id") % 97 == 3, F.lit("river_outfall"))), e


@query("SELECT u, v, length, diameter, round(roughness, 6) AS roughness, area, in_offset, out_offset FROM merged_ UNION ALL SELECT u, v, length, diameter, round(roughness, 6), area, in_offset, out_offset FROM run_ WHERE u NOT IN (SELECT u FROM piece_)", **SIMPLE)
def simplify_edges(spark, d):
    n, e = run_network(spark, d)
    named = n.withColumnRenamed("node_id", "node")
    out, _ = simplify.consolidate(named.select("node"), e, outfalls.protected(named, e).select("node"), 120)
    return out.select("u", "v", "length", "diameter", F.round("roughness", 6).alias("roughness"), F.col("contributing_area").alias("area"), "in_offset", "out_offset")


@query(
    "SELECT node_id, contributing_area + coalesce((SELECT sum(contributing_area) FROM gone_ JOIN fx_nodes g ON g.node_id = node WHERE dest = n.node_id), 0) AS contributing_area FROM fx_nodes n WHERE node_id NOT IN (SELECT node FROM gone_)",
    **SIMPLE,
    gone_="SELECT i.node, e.dest FROM inner_ i JOIN piece_ p ON p.v = i.node JOIN (SELECT chain, arg_max(v, pos) AS dest FROM piece_ GROUP BY chain) e ON e.chain = p.chain WHERE i.node NOT IN (SELECT v FROM merged_)",
)
def simplify_network(spark, d):
    from ..network import Network
    from ..params import Simplification

    n, e = run_network(spark, d)
    return simplify.network(Network(n, e), Simplification(enabled=True, max_conduit_length=120)).nodes.select("node_id", "contributing_area")


FLOW = {
    "succ_": SUCC,
    "below_": "SELECT node, node AS low FROM succ_ UNION ALL SELECT b.node, s.next FROM below_ b JOIN succ_ s ON s.node = b.low WHERE s.next IS NOT NULL",
    "want_": """SELECT s.node AS u, s.next AS v, coalesce((SELECT min(d) FROM (SELECT unnest(range(39)) AS i), LATERAL (SELECT round(0.15::DOUBLE + 0.075::DOUBLE * i, 3) AS d) WHERE d >= 0.3::DOUBLE AND
        sqrt(greatest(slope, 0.001::DOUBLE)) * pow(d / 4, 2::DOUBLE / 3) / 0.012::DOUBLE * pi() * d * d / 4 >= q * 1.5::DOUBLE), 3) AS need FROM (SELECT s.*, s.node % 4 * 0.002::DOUBLE AS slope, t.q * 40 AS q FROM succ_ s JOIN (SELECT low, sum(contributing_area) * 0.006::DOUBLE / 3600 AS q FROM below_ JOIN fx_nodes ON node_id = node GROUP BY low) t ON t.low = s.node) s WHERE s.next IS NOT NULL""",
}


@query("SELECT w.u, w.v, (SELECT max(a.need) FROM want_ a JOIN below_ b ON b.node = a.u WHERE b.low = w.u) AS diameter FROM want_ w", **FLOW)
def resized_pipes(spark, d):
    from .graphs import area_accumulation

    e = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"), F.lit(0.3).alias("diameter"), (F.col("node") % 4 * 0.002).alias("slope"))
    flows = area_accumulation(spark, d).select(F.col("node").alias("u"), (F.col("total") * 0.006 / 3600 * 40).alias("q"))
    return design.resize(e, flows, Hydraulics()).select("u", "v", "diameter")


@query("SELECT low AS node, CASE WHEN low % 5 = 0 AND max(a.contributing_area) > 0 THEN max(a.contributing_area) * 7 ELSE sum(CASE WHEN b.node % 3 = 0 THEN n.contributing_area ELSE 0 END) END AS area FROM below_ b JOIN fx_nodes n ON n.node_id = b.node JOIN fx_nodes a ON a.node_id = b.low GROUP BY low", succ_=SUCC, below_=FLOW["below_"])
def river_areas(spark, d):
    n = fx.nodes(spark, d)
    inflow = n.where("node_id % 3 = 0").select(F.col("node_id").alias("node"), F.col("contributing_area").alias("area"))
    sampled = n.where("node_id % 5 = 0").select(F.col("node_id").alias("node"), (F.col("contributing_area") * 7).alias("area"))
    return design.river_areas(inflow, succ(spark, d), sampled)


@query(
    "SELECT u, v, greatest(coalesce((SELECT max(0.1::DOUBLE + f.u % 9 * 0.1::DOUBLE) FROM fx_edges f WHERE f.v = e.u AND f.highway <> 'track'), 0), 0.3::DOUBLE) AS diameter, round(greatest(b.surface_elevation - a.surface_elevation, 0), 6) AS in_offset FROM fx_edges e JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v WHERE highway = 'track'"
)
def connector_geometry(spark, d):
    n = fx.nodes(spark, d).select("node_id", F.col("surface_elevation").alias("z"))
    e = fx.edges(spark, d)
    links = e.where("highway = 'track'").select("u", "v").join(n.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(n.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v")
    out = design.connector_geometry(links, e.where("highway <> 'track'").select("v", (0.1 + F.col("u") % 9 * 0.1).alias("diameter")))
    return out.select("u", "v", "diameter", F.round("in_offset", 6).alias("in_offset"))


@query("SELECT e.u, e.v FROM intake_ e WHERE EXISTS (SELECT 1 FROM down_ WHERE node = e.v AND low = e.u)", succ_=SUCC, down_=DOWN, intake_="SELECT node_id AS u, node_id - 40 AS v FROM fx_nodes WHERE node_id % 3 = 1 AND node_id >= 40 UNION ALL SELECT node_id - 40, node_id FROM fx_nodes WHERE node_id % 3 = 2 AND node_id >= 40")
def intake_cycles(spark, d):
    n = fx.nodes(spark, d).where("node_id >= 40")
    links = n.where("node_id % 3 = 1").select(F.col("node_id").alias("u"), (F.col("node_id") - 40).alias("v")).unionByName(n.where("node_id % 3 = 2").select((F.col("node_id") - 40).alias("u"), F.col("node_id").alias("v")))
    e = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))
    return ponds.intake_cycles(links, e)


