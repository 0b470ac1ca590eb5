"""Ponds, dual drainage, storms, model text and result series."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import numeric, ponds as fn, storms, text
from ..operators import dual, network, outfalls, ponds, raster, spatial  # noqa: F401
from ..params import DualDrainage, Ponds
from ..plans import inp
from ..sources import fixtures as fx
from .base import query

P = Ponds()
VOL = "greatest((0.6431::DOUBLE + 2.5921::DOUBLE * area_m2 * 10.7639::DOUBLE) / 35.3147::DOUBLE, 0)"


@query("SELECT pond_id, CASE WHEN water IN ('lake', 'reservoir', 'lagoon', 'oxbow') THEN 'lake' WHEN area_m2 <= 50000 THEN 'pond' ELSE 'lake' END AS kind FROM fx_ponds")
def pond_classify(spark, d):
    return fx.ponds(spark, d).select("pond_id", fn.kind(F.col("water"), F.col("area_m2"), P).alias("kind"))


@query(f"SELECT pond_id, round({VOL}, 4) AS volume, round(pow(greatest(sqrt(area_m2) - 8 * 1.5::DOUBLE, 0.3::DOUBLE * sqrt(area_m2)), 2), 4) AS bottom, round(least(greatest(3, 0.1::DOUBLE * sqrt(area_m2)), 10), 6) AS weir_length FROM fx_ponds")
def pond_volume(spark, d):
    a = F.col("area_m2")
    return fx.ponds(spark, d).select("pond_id", F.round(fn.volume(a, P), 4).alias("volume"), F.round(fn.bottom_area(a, F.lit(1.5), P), 4).alias("bottom"), F.round(fn.weir_length(a, P), 6).alias("weir_length"))


PTS = "SELECT pond_id, area_m2, i * 2.0::DOUBLE / 4 AS depth, pow(greatest(sqrt(area_m2) - 8 * (2.0::DOUBLE - i * 2.0::DOUBLE / 4), 0.3::DOUBLE * sqrt(area_m2)), 2) AS area, i FROM fx_ponds, (SELECT unnest(range(5)) AS i)"


@query("SELECT a.pond_id, round(sum((a.area + b.area) / 2 * (b.depth - a.depth)), 4) AS volume, round(sum(CASE WHEN a.depth < 1.3::DOUBLE THEN (a.area + a.area + (least(b.depth, 1.3::DOUBLE) - a.depth) / (b.depth - a.depth) * (b.area - a.area)) / 2 * (least(b.depth, 1.3::DOUBLE) - a.depth) ELSE 0 END), 4) AS below FROM pts_ a JOIN pts_ b ON a.pond_id = b.pond_id AND b.i = a.i + 1 GROUP BY a.pond_id", pts_=PTS)
def pond_curve(spark, d):
    c = fn.curve(F.col("area_m2"), F.lit(2.0), P)
    return fx.ponds(spark, d).select("pond_id", F.round(fn.curve_volume(c), 4).alias("volume"), F.round(fn.volume_below(c, F.lit(1.3)), 4).alias("below"))


@query("SELECT pond_id, i, round(area, 4) AS area, round(depth, 4) AS depth FROM pts_ UNION ALL SELECT pond_id, 4 + k, round(pow(sqrt(area_m2) + 8 * (1.5::DOUBLE * k / 4), 2), 4), round(2 + 1.5::DOUBLE * k / 4, 4) FROM fx_ponds, (SELECT unnest([1, 2, 3, 4]) AS k)", pts_=PTS)
def pond_curve_extended(spark, d):
    c = fn.extend(fn.curve(F.col("area_m2"), F.lit(2.0), P), F.lit(3.5), P)
    return fx.ponds(spark, d).select("pond_id", F.posexplode(c).alias("i", "c")).select("pond_id", F.col("i").cast("long").alias("i"), F.round("c.area", 4).alias("area"), F.round("c.depth", 4).alias("depth"))


@query(f"SELECT pond_id, round(CASE WHEN v < 50000 THEN 8 WHEN v < 200000 THEN 12 WHEN v < 400000 THEN 18 ELSE 24 END * 0.0254::DOUBLE, 6) AS orifice FROM (SELECT pond_id, {VOL} * 35.3147::DOUBLE AS v FROM fx_ponds)")
def pond_orifice(spark, d):
    return fx.ponds(spark, d).select("pond_id", F.round(fn.orifice(fn.volume(F.col("area_m2"), P)), 6).alias("orifice"))


def _surface(depth, i):
    """Area of a pond's water surface at i quarters of its depth."""
    return f"pow(greatest(sqrt(area_m2) - 8 * ({depth} - {i} * {depth} / 4), 0.3::DOUBLE * sqrt(area_m2)), 2)"


def _holds(depth):
    return "(" + " + ".join(f"({_surface(depth, i)} + {_surface(depth, i + 1)}) / 2 * ({depth} / 4)" for i in range(4)) + ")"


def _holds_below(depth, limit):
    """The trapezoids under a limit, the one that it cuts in part."""
    part = lambda i: f"CASE WHEN {i} * {depth} / 4 < {limit} THEN ({_surface(depth, i)} + {_surface(depth, i)} + (least({i + 1} * {depth} / 4, {limit}) - {i} * {depth} / 4) / ({depth} / 4) * ({_surface(depth, i + 1)} - {_surface(depth, i)})) / 2 * (least({i + 1} * {depth} / 4, {limit}) - {i} * {depth} / 4) ELSE 0 END"
    return "(" + " + ".join(part(i) for i in range(4)) + ")"


MID = "((lo + hi) / 2)"


@query(
    f"""SELECT pond_id, round(depth, 6) AS depth, round(abs(total - volume) / volume * 100, 4) AS error_pct, round(bottom / area_m2, 6) AS bottom_ratio, round(below / total, 6) AS activation, round(hours, 4) AS drawdown_h,
        CASE WHEN bottom / area_m2 < 0.2::DOUBLE THEN 'fail' WHEN bottom / area_m2 < 0.3::DOUBLE THEN 'warn' ELSE 'pass' END AS bottom_flag, below / total < 0.85::DOUBLE AS activation_flag, NOT hours BETWEEN 24 AND 72 AS drawdown_flag
    FROM (SELECT *, {_surface('depth', 0)} AS bottom, {_holds('depth')} AS total, {_holds_below('depth', '(0.9::DOUBLE * depth)')} AS below,
        {_holds('depth')} / (0.65::DOUBLE * pi() * pow(CASE WHEN volume * 35.3147::DOUBLE < 50000 THEN 8 WHEN volume * 35.3147::DOUBLE < 200000 THEN 12 WHEN volume * 35.3147::DOUBLE < 400000 THEN 18 ELSE 24 END * 0.0254::DOUBLE, 2) / 4 * sqrt(9.81::DOUBLE * depth) * 3600) AS hours FROM depth_)""",
    want_=f"SELECT pond_id, area_m2, {VOL} AS volume FROM fx_ponds",
    halve_=f"""SELECT pond_id, area_m2, volume, greatest(volume / area_m2 * 0.5::DOUBLE, 0.1::DOUBLE) AS lo, least(volume / area_m2 * 3, 3.81::DOUBLE) AS hi, 0::DOUBLE AS best, 1e300::DOUBLE AS err, false AS done, 0 AS k FROM want_ UNION ALL
        SELECT pond_id, area_m2, volume, CASE WHEN NOT done AND {_holds(MID)} < volume THEN {MID} ELSE lo END, CASE WHEN NOT done AND {_holds(MID)} >= volume THEN {MID} ELSE hi END,
            CASE WHEN NOT done AND abs({_holds(MID)} - volume) / greatest(volume, 1) < err THEN {MID} ELSE best END, CASE WHEN done THEN err ELSE least(err, abs({_holds(MID)} - volume) / greatest(volume, 1)) END,
            done OR abs({_holds(MID)} - volume) / greatest(volume, 1) < 0.05::DOUBLE, k + 1 FROM halve_ WHERE k < 30""",
    depth_="SELECT pond_id, area_m2, volume, CASE WHEN volume / area_m2 >= 3.81::DOUBLE THEN 3.81::DOUBLE ELSE best END AS depth FROM halve_ WHERE k = 30",
)
def pond_depth_checks(spark, d):
    p = ponds.sized(fx.ponds(spark, d), P)
    c = fn.checks(F.col("area_m2"), F.col("bottom"), F.col("curve"), F.col("depth"), F.col("orifice"), F.col("weir_crest"), P)
    p = p.select("pond_id", F.round("depth", 6).alias("depth"), F.round(fn.volume_error_pct(F.col("curve"), F.col("volume")), 4).alias("error_pct"), c.alias("c")).select("pond_id", "depth", "error_pct", "c.*")
    return p.withColumn("bottom_ratio", F.round("bottom_ratio", 6)).withColumn("activation", F.round("activation", 6)).withColumn("drawdown_h", F.round("drawdown_h", 4))


@query("SELECT pond_id, min(CASE WHEN s >= need THEN s ELSE 0.9144::DOUBLE END) AS diameter FROM (SELECT pond_id, sqrt(4 * (area_m2 / 50000) / (pi() * 0.65::DOUBLE * sqrt(2 * 9.81::DOUBLE * 1.2::DOUBLE))) AS need FROM fx_ponds), (SELECT unnest([6, 8, 12, 18, 24, 30, 36]) * 0.0254::DOUBLE AS s) GROUP BY pond_id")
def pond_orifice_resize(spark, d):
    return fx.ponds(spark, d).select("pond_id", fn.required_orifice(F.col("area_m2") / 50_000, F.lit(1.2), P).alias("diameter"))


BOX = "SELECT pond_id AS box_id, x - sqrt(area_m2) AS x0, y - sqrt(area_m2) AS y0, x + sqrt(area_m2) AS x1, y + sqrt(area_m2) AS y1, area_m2 * 4 AS area, row_number() OVER (ORDER BY area_m2 DESC, pond_id) AS k FROM fx_ponds"


@query(
    "SELECT unnest(kept) AS box_id FROM keep_ WHERE n = (SELECT max(k) FROM box_)",
    box_=BOX,
    keep_="""SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM box_ o WHERE list_contains(w.kept, o.box_id) AND least(o.x1, b.x1) > greatest(o.x0, b.x0) AND least(o.y1, b.y1) > greatest(o.y0, b.y0)
            AND (least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0)) > 0.5::DOUBLE * b.area) THEN w.kept ELSE list_append(w.kept, b.box_id) END
        FROM keep_ w JOIN box_ b ON b.k = w.n + 1""",
)
def pond_overlap_dedupe(spark, d):
    h = F.sqrt("area_m2")
    b = fx.ponds(spark, d).select(F.col("pond_id").alias("box_id"), (F.col("x") - h).alias("x0"), (F.col("y") - h).alias("y0"), (F.col("x") + h).alias("x1"), (F.col("y") + h).alias("y1"), (F.col("area_m2") * 4).alias("area"))
    return spatial.keep_larger(b).select("box_id")


@query("SELECT pond_id, target FROM (SELECT pond_id, CAST(floor(x / 200) * 100 + floor(y / 200) AS BIGINT) AS target, row_number() OVER (PARTITION BY CAST(floor(x / 200) * 100 + floor(y / 200) AS BIGINT) ORDER BY area_m2 DESC, pond_id) AS k FROM fx_ponds) WHERE k = 1")
def pond_claim(spark, d):
    return ponds.claim(fx.ponds(spark, d).select("pond_id", "area_m2", (F.floor(F.col("x") / 200) * 100 + F.floor(F.col("y") / 200)).cast("long").alias("target")))


@query(
    "SELECT pond_id, sub_id FROM fill_ WHERE taken",
    offer_=f"""SELECT pond_id, node_id AS sub_id, 2500 * (1 + node_id % 5) AS area, {VOL} * 2 / (0.0254::DOUBLE * 0.5::DOUBLE) / 100 AS capacity, row_number() OVER (PARTITION BY pond_id ORDER BY dd, node_id) AS k FROM (
        SELECT n.node_id, p.pond_id, p.area_m2, sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) AS dd FROM fx_nodes n, fx_ponds p) WHERE dd <= 500 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY dd, pond_id) = 1""",
    order_="SELECT pond_id, sub_id, area, row_number() OVER (PARTITION BY pond_id ORDER BY k) AS k FROM offer_",
    fill_="""SELECT pond_id, CAST(NULL AS BIGINT) AS sub_id, min(capacity) AS room, false AS taken, CAST(0 AS BIGINT) AS k FROM offer_ GROUP BY pond_id UNION ALL
        SELECT f.pond_id, o.sub_id, CASE WHEN o.area <= f.room THEN f.room - o.area ELSE f.room END, o.area <= f.room, o.k FROM fill_ f JOIN order_ o ON o.pond_id = f.pond_id AND o.k = f.k + 1""",
)
def pond_capacity_fill(spark, d):
    p = fx.ponds(spark, d).select("pond_id", F.col("x").alias("x2"), F.col("y").alias("y2"), (fn.volume(F.col("area_m2"), P) * 2 / (0.0254 * 0.5) / 100).alias("capacity"))
    n = fx.nodes(spark, d).select("node_id", "x", "y")
    o = spatial.near_points(n, p, P.sub_reroute_max).select("pond_id", "capacity", F.col("node_id").alias("sub_id"), "distance")
    near = F.row_number().over(Window.partitionBy("sub_id").orderBy("distance", "pond_id"))
    o = o.withColumn("k", near).where("k = 1").drop("k").join(fx.subs(spark, d).select("sub_id", (F.col("area") * (1 + F.col("sub_id") % 5)).alias("area")), "sub_id")
    return ponds.capacity_fill(o)


@query("SELECT source AS pond_id, count(*) AS n_subcatchments, sum(area) AS area_m2 FROM fx_subs JOIN (SELECT node, arg_min(low, (hops, low)) AS source FROM down_ WHERE low % 4 = 0 AND low % 100 < 20 GROUP BY node) ON node = outlet_id GROUP BY 1", succ_=__import__("riverine.queries.graphs", fromlist=["SUCC"]).SUCC, down_="SELECT node, node AS low, 0 AS hops FROM succ_ UNION ALL SELECT b.node, s.next, hops + 1 FROM down_ b JOIN succ_ s ON s.node = b.low WHERE s.next IS NOT NULL")
def pond_partition(spark, d):
    from .graphs import succ

    e = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))
    sinks = fx.nodes(spark, d).where("node_id % 4 = 0 and node_id % 100 < 20").select(F.col("node_id").alias("node"))
    return ponds.pondsheds(ponds.partition(e, sinks), fx.subs(spark, d))


@query("SELECT node_id + 10000000000 AS node_id, x, y, round(surface_elevation - 0.3::DOUBLE, 6) AS chamber_floor_elevation FROM fx_nodes WHERE node_id IN (SELECT u FROM k_ UNION SELECT v FROM k_)", k_="SELECT * FROM fx_edges WHERE highway IN ('primary', 'residential')")
def dual_surface_nodes(spark, d):
    s = dual.surface_nodes(fx.nodes(spark, d), fx.edges(spark, d).where("highway in ('primary', 'residential')"), DualDrainage())
    return s.select("node_id", "x", "y", F.round("chamber_floor_elevation", 6).alias("chamber_floor_elevation"))


@query("SELECT u + 10000000000 AS u, v + 10000000000 AS v, id || '-channel' AS id, greatest(coalesce(try_cast(split_part(lanes, ',', 1) AS DOUBLE), 2), 1) * 3.5::DOUBLE AS channel_width FROM fx_edges WHERE highway IN ('primary', 'residential')")
def dual_channels(spark, d):
    return dual.channels(fx.edges(spark, d).where("highway in ('primary', 'residential')"), DualDrainage()).select("u", "v", "id", "channel_width")


@query("SELECT node_id + 10000000000 AS u, node_id AS v, node_id || '-grate' AS id, round(sqrt(4 * 0.125::DOUBLE / pi()), 6) AS orifice_diam_m FROM fx_nodes WHERE node_id IN (SELECT u FROM fx_edges UNION SELECT v FROM fx_edges)")
def dual_grates(spark, d):
    g = dual.grates(dual.surface_nodes(fx.nodes(spark, d), fx.edges(spark, d), DualDrainage()))
    return g.select("u", "v", "id", F.round("orifice_diam_m", 6).alias("orifice_diam_m"))


@query(
    "SELECT CASE WHEN zn >= zt THEN node ELSE dest END AS u, CASE WHEN zn >= zt THEN dest ELSE node END AS v, dd AS distance FROM join_ WHERE node IS NOT NULL",
    both_="SELECT u, v FROM fx_edges WHERE highway = 'primary' UNION ALL SELECT v, u FROM fx_edges WHERE highway = 'primary'",
    **{"part_(node, root) USING KEY (node)": "SELECT u, u FROM both_ UNION SELECT b.v, min(p.root) FROM part_ p JOIN both_ b ON b.u = p.node JOIN recurring.part_ r ON r.node = b.v GROUP BY b.v, r.root HAVING min(p.root) < r.root"},
    at_="SELECT p.root, n.node_id AS node, n.x, n.y, n.surface_elevation AS z FROM part_ p JOIN fx_nodes n ON n.node_id = p.node",
    pair_="""SELECT a.root, b.root AS dest_root, min(row(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), a.node, b.node, a.z, b.z)) AS m FROM (SELECT * FROM at_ QUALIFY row_number() OVER (PARTITION BY root ORDER BY z, node) = 1) a
        JOIN at_ b ON b.root <> a.root AND abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 300 GROUP BY 1, 2""",
    # component after component, the nearest first
    **{"join_(root, node, dest, dd, zn, zt) USING KEY (root)": """SELECT root, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM (SELECT root FROM at_ ORDER BY z, root LIMIT 1) UNION (
        SELECT p.root, m[2], m[3], m[1], m[4], m[5] FROM pair_ p WHERE p.dest_root IN (SELECT root FROM recurring.join_) AND p.root NOT IN (SELECT root FROM recurring.join_) ORDER BY m LIMIT 1)"""},
)
def trunk_inference(spark, d):
    from ..operators import graph

    n = fx.nodes(spark, d)
    e = fx.edges(spark, d).where("highway = 'primary'")
    part = graph.components(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    low = part.join(n.select(F.col("node_id").alias("node"), "surface_elevation"), "node").groupBy("root").agg(F.min(F.struct("surface_elevation", "node")).alias("m")).select("root", "m.node")
    return outfalls.trunk_bridges(part, low, n, 300)


MASS = "CASE " + " ".join(f"WHEN h <= {b}::DOUBLE THEN {c}::DOUBLE + (h - {a}::DOUBLE) * ({e}::DOUBLE - {c}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE)" for a, b, c, e in zip(storms.HOURS, storms.HOURS[1:], storms.FRACTIONS["III"], storms.FRACTIONS["III"][1:], strict=False)) + " END"


@query(f"SELECT 1 AS rain_gage, TIMESTAMP '2000-01-01 00:00:00' + to_minutes(CAST(i * 6 AS BIGINT)) AS date, round(CASE WHEN i < 240 THEN (lead(m) OVER (ORDER BY i) - m) / 0.1::DOUBLE ELSE 0 END, 6) AS value FROM (SELECT i, {MASS} * 152.4::DOUBLE AS m FROM (SELECT i, i * 0.1::DOUBLE AS h FROM range(241) t(i)))")
def nrcs_hyetograph(spark, d):
    return storms.hyetograph(spark, 152.4, "III", "24-hr", 6).select("rain_gage", "date", F.round("value", 6).alias("value"))


@query("SELECT rain_gage, arg_min(minutes, (-n, minutes)) AS minutes FROM (SELECT rain_gage, minutes, count(*) AS n FROM (SELECT rain_gage, date_diff('second', lag(date_) OVER (ORDER BY date_), date_) / 60::DOUBLE AS minutes FROM fx_rain) WHERE minutes IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def rain_interval_mode(spark, d):
    return storms.interval_minutes(fx.rain(spark, d), "date_")


@query("SELECT min(date_) AS start, max(date_) + INTERVAL 24 HOURS AS stop FROM fx_rain")
def sim_window(spark, d):
    return storms.window(fx.rain(spark, d), 24, "date_")


@query("SELECT name, attr, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS peak, min(ts) AS first_ts FROM fx_results GROUP BY name, attr")
def result_series(spark, d):
    r = fx.results(spark, d)
    return r.groupBy("name", "attr").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("peak"), F.min("ts").alias("first_ts"))


@query("SELECT ts, value FROM fx_results WHERE name = 'J7' AND attr = 'view'")
def result_node_series(spark, d):
    return inp.series(fx.results(spark, d), "J7", "view")


@query("SELECT format('{:d}   {:s}    {:.4f}', rain_gage, strftime(date_, '%Y %m %d %H %M'), value) AS line FROM fx_rain")
def rain_dat_lines(spark, d):
    return inp.rain_lines(fx.rain(spark, d).withColumnRenamed("date_", "date"))


@query("SELECT CAST(9 AS INTEGER) AS section_no, CAST(node_id AS VARCHAR) AS ord_text, rpad('J' || node_id, 16, ' ') || ' ' || rpad(printf('%.3f', z), 12, ' ') || ' ' || rpad('3', 12, ' ') || ' ' || rpad('0', 12, ' ') || ' ' || rpad('0', 16, ' ') || ' ' || '0' AS text FROM (SELECT node_id, round(surface_elevation - 3, 3) AS z FROM fx_nodes)")
def inp_junctions(spark, d):
    n = fx.nodes(spark, d).select(F.col("node_id"), F.concat(F.lit("J"), F.col("node_id").cast("string")).alias("Name"), F.format_string("%.3f", numeric.rounded(F.col("surface_elevation") - 3, 3)).alias("InvertElev"), F.lit(3.0).alias("MaxDepth"))
    return inp.rows("JUNCTIONS", n, "node_id").select("section_no", "ord_text", "text")


@query("SELECT node_id, round(3.0::DOUBLE * sqrt(0.3048::DOUBLE), 6) AS metric, 3.0::DOUBLE AS us FROM fx_nodes")
def weir_units(spark, d):
    return fx.nodes(spark, d).select("node_id", F.round(numeric.weir_coefficient(3.0, F.lit("LPS")), 6).alias("metric"), numeric.weir_coefficient(3.0, F.lit("cfs")).alias("us"))


@query("SELECT node_id, format('{:g}', x / 7) AS a, format('{:g}', contributing_area * 1000) AS b, CASE WHEN node_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS f, sha256(CAST(node_id AS VARCHAR) || ',' || CAST(node_id + 1 AS VARCHAR)) AS h FROM fx_nodes")
def value_formats(spark, d):
    n = fx.nodes(spark, d)
    return n.select("node_id", text.general(F.col("x") / 7).alias("a"), text.general(F.col("contributing_area") * 1000).alias("b"), text.flag(F.col("node_id") % 2 == 0).alias("f"), text.box_hash(F.col("node_id"), F.col("node_id") + 1).alias("h"))
