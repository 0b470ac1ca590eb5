"""Components, reachability, forests, accumulation, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, network, outfalls
from ..sources import fixtures as fx
from .base import query
from .streets import COST, SLOPED, WEIGHTED, doubled, sloped, weighted

SUCC = """SELECT n.node_id AS node, b.v AS next FROM fx_nodes n LEFT JOIN (
    SELECT u, arg_min(v, (zv, v)) AS v FROM (SELECT e.u, e.v, a.surface_elevation AS zu, b.surface_elevation AS zv FROM (SELECT u, v FROM fx_edges UNION ALL SELECT v, u FROM fx_edges) e
        JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v) WHERE zv < zu GROUP BY u) b ON b.u = n.node_id"""
#: Every pair (node, something below it or itself).
BELOW = "SELECT node, node AS low FROM succ_ UNION ALL SELECT b.node, s.next FROM below_ b JOIN succ_ s ON s.node = b.low WHERE s.next IS NOT NULL"


def succ(spark, d):
    return graph.steepest(fx.edges(spark, d), fx.nodes(spark, d))


KEPT = "SELECT u, v FROM fx_edges WHERE highway IN ('primary', 'tertiary', 'residential')"


def streets(spark, d):
    return fx.edges(spark, d).where("highway in ('primary', 'tertiary', 'residential')")


@query(
    "SELECT node_id AS node, least(node_id, coalesce(min(root), node_id)) AS root FROM fx_nodes LEFT JOIN reach_ ON node = node_id GROUP BY node_id",
    kept_=KEPT,
    both_="SELECT u, v FROM kept_ UNION SELECT v, u FROM kept_",
    reach_="SELECT u AS node, v AS root FROM both_ UNION SELECT r.node, b.v FROM reach_ r JOIN both_ b ON b.u = r.root",
)
def connected_components(spark, d):
    e = streets(spark, d)
    return graph.components(e.select(F.col("u").alias("a"), F.col("v").alias("b")), fx.nodes(spark, d).select(F.col("node_id").alias("node")))


@query("SELECT DISTINCT node FROM below_ WHERE low IN (SELECT node_id FROM fx_nodes WHERE node_id % 100 = 17)", succ_=SUCC, below_=BELOW)
def reach_ancestors(spark, d):
    down = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))
    starts = fx.nodes(spark, d).where("node_id % 100 = 17").select(F.col("node_id").alias("node"))
    return graph.reach(down, starts, backwards=True).select("node")


@query(
    "SELECT node, CAST(hops AS INTEGER) AS hops, source FROM front_",
    both_="SELECT u, v FROM fx_edges UNION ALL SELECT v, u FROM fx_edges",
    **{"front_(node, hops, source) USING KEY (node)": """SELECT node_id, 0, node_id FROM fx_nodes WHERE node_id % 211 = 5 UNION
        SELECT b.v, f.hops + 1, min(f.source) FROM front_ f JOIN both_ b ON b.u = f.node LEFT JOIN recurring.front_ r ON r.node = b.v WHERE r.node IS NULL GROUP BY b.v, f.hops"""},
)
def bfs_sink_partition(spark, d):
    starts = fx.nodes(spark, d).where("node_id % 211 = 5").select(F.col("node_id").alias("node"))
    return graph.reach(network.double_directed(fx.edges(spark, d).select("u", "v", "id")), starts, backwards=True)


@query("SELECT node, CAST(max(hops) AS INTEGER) AS level FROM up_ GROUP BY node", succ_=SUCC, up_="SELECT node, 0 AS hops, node AS leaf FROM succ_ UNION ALL SELECT s.next, u.hops + 1, u.leaf FROM up_ u JOIN succ_ s ON s.node = u.node WHERE s.next IS NOT NULL")
def topological_levels(spark, d):
    return graph.levels(succ(spark, d))


@query("SELECT low AS node, sum(contributing_area) AS total FROM below_ JOIN fx_nodes ON node_id = node GROUP BY low", succ_=SUCC, below_=BELOW)
def area_accumulation(spark, d):
    n = fx.nodes(spark, d).select(F.col("node_id").alias("node"), F.col("contributing_area").alias("amount"))
    return graph.accumulate(succ(spark, d).join(n, "node"))


@query("SELECT low AS node, round(sum(contributing_area) * CAST(0.006 AS DOUBLE) / 3600, 9) AS flow FROM below_ JOIN fx_nodes ON node_id = node GROUP BY low", succ_=SUCC, below_=BELOW)
def rational_flow(spark, d):
    return area_accumulation(spark, d).select("node", F.round(F.col("total") * 0.006 / 3600, 9).alias("flow"))


@query("SELECT node, low AS root FROM below_ WHERE low IN (SELECT node FROM succ_ WHERE next IS NULL)", succ_=SUCC, below_=BELOW)
def resolve_transitive(spark, d):
    s = succ(spark, d)
    top = graph.resolve(s.where("next is not null").select("node", F.col("next").alias("into")))
    return s.join(top, "node", "left").select("node", F.coalesce("into", "node").alias("root"))


@query(
    "SELECT node, round(dist, 6) AS dist FROM walk_",
    sloped_=SLOPED,
    edge_=f"SELECT u, v, w FROM ({WEIGHTED})",
    **{"walk_(node, dist) USING KEY (node)": """SELECT node_id, 0::DOUBLE FROM fx_nodes WHERE node_id % 60 = 30 UNION
        SELECT e.u, min(w.dist + e.w) FROM walk_ w JOIN edge_ e ON e.v = w.node LEFT JOIN recurring.walk_ r ON r.node = e.u GROUP BY e.u, r.dist HAVING r.dist IS NULL OR min(w.dist + e.w) < r.dist"""},
)
def shortest_forest_additive(spark, d):
    e = weighted(sloped(spark, d).withColumn("contributing_area", F.col("v_contributing_area")), LIGHT)
    roots = fx.nodes(spark, d).where("node_id % 60 = 30").select(F.col("node_id").alias("node"))
    return graph.shortest_forest(e, roots).select("node", F.round("dist", 6).alias("dist"))


def _light():
    from ..params import Topology

    return Topology(weights=("chahinian_slope", "length", "contributing_area"))


LIGHT = _light()


BEND = """CASE WHEN t IS NULL THEN 0::DOUBLE WHEN t < 30 THEN 0.3::DOUBLE WHEN t < 135 THEN 0.3::DOUBLE * (0.8::DOUBLE * abs(90 - t) / 60 + 0.2::DOUBLE) ELSE 0.3::DOUBLE * (0.4::DOUBLE * (180 - t) / 90) END"""


@query(
    "SELECT node, round(dist, 6) AS dist, next, root FROM walk_ WHERE done",
    sloped_=SLOPED,
    edge_=f"SELECT u, v, min(greatest(w, 0.01::DOUBLE)) AS w FROM ({WEIGHTED}) GROUP BY u, v",
    # the way from u over v on to w, and the angle there
    turn_="""SELECT e.u, e.v, f.v AS w, degrees(acos(greatest(-1, least(1, ((a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y)) / (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * sqrt(pow(c.x - b.x, 2) + pow(c.y - b.y, 2))))))) AS t
        FROM edge_ e JOIN edge_ f ON f.u = e.v JOIN fx_nodes a ON a.node_id = e.u JOIN fx_nodes b ON b.node_id = e.v JOIN fx_nodes c ON c.node_id = f.v""",
    # one node settles at a time: the least label of all that wait
    **{"walk_(node, dist, next, root, done) USING KEY (node)": f"""SELECT node_id, 0::DOUBLE, CAST(NULL AS BIGINT), node_id, false FROM fx_nodes WHERE node_id % 60 = 30 UNION (
        WITH pick AS (SELECT * FROM recurring.walk_ WHERE NOT done ORDER BY dist, node LIMIT 1)
        SELECT node, dist, next, root, true FROM pick UNION ALL
        SELECT e.u, p.dist + e.w + {BEND}, p.node, p.root, false FROM pick p JOIN edge_ e ON e.v = p.node LEFT JOIN turn_ q ON q.u = e.u AND q.v = e.v AND q.w = p.next LEFT JOIN recurring.walk_ r ON r.node = e.u
        WHERE r.node IS NULL OR (NOT r.done AND (p.dist + e.w + {BEND} < r.dist OR (p.dist + e.w + {BEND} = r.dist AND (p.node < r.next OR (p.node = r.next AND p.root < r.root))))))"""},
)
def shortest_forest_turn(spark, d):
    n = fx.nodes(spark, d)
    e = weighted(sloped(spark, d).withColumn("contributing_area", F.col("v_contributing_area"))).withColumn("weight", F.greatest("weight", F.lit(0.01)))
    f = graph.turn_forest(e.select("u", "v", "weight"), n, n.where("node_id % 60 = 30").select(F.col("node_id").alias("node")), 0.3)
    return f.select("node", F.round("dist", 6).alias("dist"), "next", "root")


@query(
    "SELECT a, b, weight FROM part_ JOIN cost_ ON k = -node - 1 WHERE node < -1 AND part = 1",
    cost_="""SELECT *, row_number() OVER (ORDER BY weight, a, b) AS k FROM (SELECT u AS a, v AS b, length + surface_elevation AS weight FROM fx_edges JOIN fx_nodes ON node_id = u
        WHERE highway NOT IN ('corridor', 'track', 'footway', 'path'))""",
    # edge after edge, from the lightest: node -1 says which is next, -k - 1 whether edge k was taken
    **{"part_(node, part) USING KEY (node)": """SELECT node_id, node_id FROM fx_nodes UNION ALL SELECT -1, 1 UNION (
        WITH now AS (SELECT c.k, p.part AS pa, q.part AS pb FROM recurring.part_ z JOIN cost_ c ON c.k = z.part JOIN recurring.part_ p ON p.node = c.a JOIN recurring.part_ q ON q.node = c.b WHERE z.node = -1)
        SELECT r.node, least(pa, pb) FROM now JOIN recurring.part_ r ON r.node >= 0 AND r.part = greatest(pa, pb) WHERE pa <> pb UNION ALL
        SELECT -k - 1, CASE WHEN pa <> pb THEN 1 ELSE 0 END FROM now UNION ALL SELECT -1, k + 1 FROM now)"""},
)
def mst_outfalls(spark, d):
    n = fx.nodes(spark, d)
    e = network.without_highways(fx.edges(spark, d))
    cost = e.join(n.select(F.col("node_id").alias("u"), F.col("surface_elevation").alias("z")), "u").withColumn("weight", F.col("length") + F.col("z"))
    return graph.spanning_forest(cost.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight"))


@query(
    """SELECT node_id AS node, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, coalesce(pi, 0) AS pipe_in, coalesce(po, 0) AS pipe_out FROM fx_nodes
    LEFT JOIN (SELECT v, count(*) AS i, count(*) FILTER (WHERE highway <> 'track') AS pi FROM fx_edges GROUP BY v) a ON a.v = node_id
    LEFT JOIN (SELECT u, count(*) AS o, count(*) FILTER (WHERE highway <> 'track') AS po FROM fx_edges GROUP BY u) b ON b.u = node_id WHERE i IS NOT NULL OR o IS NOT NULL"""
)
def degree_stats(spark, d):
    e = fx.edges(spark, d).withColumn("edge_type", F.when(F.col("highway") == "track", F.lit("river")).otherwise(F.lit("pipe")))
    return graph.degrees(e)


@query(
    """SELECT node_id AS node FROM fx_nodes WHERE node_id IN (SELECT u FROM fx_edges WHERE highway = 'track' UNION SELECT v FROM fx_edges WHERE highway = 'track')
    OR (SELECT count(*) FROM fx_edges WHERE v = node_id AND highway <> 'track') <> 1 OR (SELECT count(*) FROM fx_edges WHERE u = node_id AND highway <> 'track') <> 1"""
)
def protected_nodes(spark, d):
    e = fx.edges(spark, d).withColumn("edge_type", F.when(F.col("highway") == "track", F.lit("river")).otherwise(F.lit("pipe")))
    n = fx.nodes(spark, d).select(F.col("node_id").alias("node"), F.lit(None).cast("string").alias("node_type"))
    return outfalls.protected(n, e).select("node")


INNER = "SELECT s.node, s.next FROM succ_ s JOIN (SELECT next FROM succ_ WHERE next IS NOT NULL GROUP BY next HAVING count(*) = 1) a ON a.next = s.node WHERE s.next IS NOT NULL"


@query(
    'SELECT node, "end", pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos DESC) AS k FROM walk_) WHERE k = 1',
    succ_=SUCC,
    inner_=INNER,
    walk_='SELECT node, next AS "end", CAST(1 AS BIGINT) AS pos FROM inner_ UNION ALL SELECT w.node, i.next, w.pos + 1 FROM walk_ w JOIN inner_ i ON i.node = w."end"',
)
def degree2_chains(spark, d):
    return graph.chains(succ(spark, d))


@query("SELECT node, next FROM succ_ WHERE next IS NOT NULL AND node NOT IN (SELECT next FROM succ_ WHERE next IS NOT NULL) AND node IN (SELECT node_id FROM fx_nodes WHERE contributing_area < 500)", succ_=SUCC)
def dangling_leaves(spark, d):
    s = succ(spark, d).where("next is not null")
    small = fx.nodes(spark, d).where("contributing_area < 500").select(F.col("node_id").alias("node"))
    return s.join(s.select(F.col("next").alias("node")), "node", "left_anti").join(small, "node", "left_semi").select("node", "next")
