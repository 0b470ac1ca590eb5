"""Pipe sizing, channels, outfall slopes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import design
from ..params import Channels, Hydraulics
from ..sources import fixtures as fx
from .base import query
from .graphs import BELOW, SUCC, area_accumulation, succ

PIPES = """SELECT s.node AS u, s.next AS v, a.surface_elevation AS zu, b.surface_elevation AS zv, 50::DOUBLE AS length, t.total * 0.006::DOUBLE / 3600 AS q
    FROM succ_ s JOIN fx_nodes a ON a.node_id = s.node JOIN fx_nodes b ON b.node_id = s.next
    JOIN (SELECT low, sum(contributing_area) AS total FROM below_ JOIN fx_nodes ON node_id = node GROUP BY low) t ON t.low = s.node"""


def pipes(spark, d):
    """u, v, zu, zv, length, q of the steepest-descent forest's edges."""
    n = fx.nodes(spark, d)
    z = lambda k, c: n.select(F.col("node_id").alias(k), F.col("surface_elevation").alias(c))
    s = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"))
    q = area_accumulation(spark, d).select(F.col("node").alias("u"), (F.col("total") * 0.006 / 3600).alias("q"))
    return s.join(z("u", "zu"), "u").join(z("v", "zv"), "v").join(q, "u").withColumn("length", F.lit(50.0))


@query("SELECT u, v, round(1.32::DOUBLE / 2000 * (9579.31::DOUBLE * pow(0.3::DOUBLE, 0.5737::DOUBLE) + 1163.77::DOUBLE * pow(length * 0.6 * (zu - zv + 1), 1.31::DOUBLE)), 4) AS cost_usd FROM pipes_", succ_=SUCC, below_=BELOW, pipes_=PIPES)
def pipe_cost(spark, d):
    p = pipes(spark, d)
    return p.select("u", "v", F.round(numeric.cost_usd(F.col("length") * 0.6 * (F.col("zu") - F.col("zv") + 1), F.lit(0.3)), 4).alias("cost_usd"))


FULL = "sqrt({s}) * pow({d} / 4, 2::DOUBLE / 3) / 0.012::DOUBLE * pi() * {d} * {d} / 4"


@query(f"SELECT u, v, round({FULL.format(s='(zu - zv) / length', d='0.6::DOUBLE')}, 6) AS q_full FROM pipes_", succ_=SUCC, below_=BELOW, pipes_=PIPES)
def full_pipe_capacity(spark, d):
    return pipes(spark, d).select("u", "v", F.round(numeric.full_capacity(F.lit(0.6), (F.col("zu") - F.col("zv")) / F.col("length")), 6).alias("q_full"))


@query(f"SELECT u, v, min(coalesce(dd, 3.0::DOUBLE)) AS diameter FROM (SELECT u, v, zu, zv, length, q, (SELECT min(0.15::DOUBLE + 0.075::DOUBLE * i) FROM range(39) t(i) WHERE {FULL.format(s='(zu - zv) / length', d='(0.15::DOUBLE + 0.075::DOUBLE * i)')} >= q * 20) AS dd FROM pipes_) GROUP BY u, v", succ_=SUCC, below_=BELOW, pipes_=PIPES)
def pipe_first_feasible(spark, d):
    p = pipes(spark, d).withColumn("s", (F.col("zu") - F.col("zv")) / F.col("length"))
    return p.select("u", "v", numeric.first_diameter(lambda x: numeric.full_capacity(x, F.col("s")) >= F.col("q") * 20).alias("diameter"))


AREA = "0.6::DOUBLE * 0.6 / 8 * ({t} - sin({t}))"
FLOW = "(" + AREA + ") * pow(0.6::DOUBLE / 4 * (1 - sin({t}) / {t}), 2::DOUBLE / 3) * sqrt(s) / 0.012::DOUBLE"


@query(
    f"SELECT u, v, round((1 - cos((lo + hi) / 2 / 2)) / 2, 6) AS fill, round({AREA.format(t='((lo + hi) / 2)')}, 6) AS area, round(q / ({AREA.format(t='((lo + hi) / 2)')}), 4) AS velocity FROM solve_ WHERE k = 60",
    succ_=SUCC,
    below_=BELOW,
    pipes_=PIPES,
    solve_=f"""SELECT u, v, q, s, 1e-9::DOUBLE AS lo, 5.3784::DOUBLE AS hi, 0 AS k FROM (SELECT u, v, q, (zu - zv) / length AS s FROM pipes_) WHERE q > 0 AND q < {FLOW.format(t='5.3784::DOUBLE')}
        UNION ALL SELECT u, v, q, s, CASE WHEN {FLOW.format(t='((lo + hi) / 2)')} < q THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {FLOW.format(t='((lo + hi) / 2)')} < q THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM solve_ WHERE k < 60""",
)
def partial_flow(spark, d):
    p = pipes(spark, d).withColumn("s", (F.col("zu") - F.col("zv")) / F.col("length"))
    full = numeric._discharge(F.lit(numeric.PEAK_ANGLE), F.lit(0.6), F.col("s"), numeric.ROUGHNESS)
    p = p.where((F.col("q") > 0) & (F.col("q") < full)).withColumn("h", numeric.part_full(F.col("q"), F.lit(0.6), F.col("s")))
    return p.select("u", "v", F.round("h.fill", 6).alias("fill"), F.round("h.area", 6).alias("area"), F.round("h.velocity", 4).alias("velocity"))


WIDE = "least(50, greatest(1, 2.7::DOUBLE * pow(greatest(total * 50 / 1e6::DOUBLE, 0.01::DOUBLE), 0.5::DOUBLE)))"


@query(f"SELECT low AS node, round({WIDE}, 6) AS width, round(least(5, greatest(0.3::DOUBLE, 0.4::DOUBLE * {WIDE})), 6) AS depth, round(z - least(5, greatest(0.3::DOUBLE, 0.4::DOUBLE * {WIDE})), 6) AS invert FROM (SELECT low, sum(contributing_area) AS total FROM below_ JOIN fx_nodes ON node_id = node GROUP BY low) JOIN (SELECT node_id, surface_elevation AS z FROM fx_nodes) ON node_id = low", succ_=SUCC, below_=BELOW)
def channel_geometry(spark, d):
    z = fx.nodes(spark, d).select(F.col("node_id").alias("node"), F.col("surface_elevation").alias("z"))
    t = design.channels(area_accumulation(spark, d).withColumn("total", F.col("total") * 50).join(z, "node"), Channels())
    return t.select("node", *[F.round(c, 6).alias(c) for c in ("width", "depth", "invert")])


SLOPE = "CASE WHEN zu - zv > 0 AND (zu - zv) / 5 > 0.05::DOUBLE THEN (zu - zv) / 0.05::DOUBLE ELSE 5 END"


@query(f"SELECT u, v, round({SLOPE}, 6) AS length, round(CASE WHEN zu - zv <= 0 THEN zu - 0.001::DOUBLE * 5 ELSE zv END, 6) AS sink_invert FROM (SELECT u, v, a.surface_elevation AS zu, b.surface_elevation AS zv FROM fx_edges JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v)")
def outfall_slope(spark, d):
    n = fx.nodes(spark, d)
    e = fx.edges(spark, d).join(n.select(F.col("node_id").alias("u"), F.col("surface_elevation").alias("zu")), "u").join(n.select(F.col("node_id").alias("v"), F.col("surface_elevation").alias("zv")), "v")
    return design.outfall_slopes(e.withColumn("length", F.lit(5.0)), Hydraulics()).select("u", "v", F.round("length", 6).alias("length"), F.round("sink_invert", 6).alias("sink_invert"))


@query("SELECT u, v, round(CASE WHEN zu > zv THEN least(0.03::DOUBLE, 0.5::DOUBLE * (zu - zv)) ELSE 0 END, 6) AS out_offset FROM (SELECT u, v, a.surface_elevation AS zu, b.surface_elevation AS zv FROM fx_edges JOIN fx_nodes a ON a.node_id = u JOIN fx_nodes b ON b.node_id = v)")
def manhole_drop(spark, d):
    n = fx.nodes(spark, d)
    e = fx.edges(spark, d).join(n.select(F.col("node_id").alias("u"), F.col("surface_elevation").alias("zu")), "u").join(n.select(F.col("node_id").alias("v"), F.col("surface_elevation").alias("zv")), "v")
    return e.select("u", "v", F.round(design.manhole_drop(F.col("zu") - F.col("zv"), Hydraulics()), 6).alias("out_offset"))


def _manning(v, r):
    return f"pow({v} * 0.012::DOUBLE / pow({r}, 2::DOUBLE / 3), 2)"


LIMIT = "CASE WHEN d <= 0.6::DOUBLE THEN 0.7::DOUBLE WHEN d <= 1.5::DOUBLE THEN 0.8::DOUBLE ELSE 0.85::DOUBLE END"
LOAD = "(d * d / 8 * ({t} - sin({t}))) * pow(d / 4 * (1 - sin({t}) / {t}), 2::DOUBLE / 3) * sqrt(s) / 0.012::DOUBLE"
HALF = "((a.lo + a.hi) / 2)"
#: The central angle of the water in a pipe: full beyond the peak, else by 60 halvings.
ANGLE = f"CASE WHEN q <= 0 OR s <= 0 THEN 0 WHEN q >= {LOAD.format(t='5.3784::DOUBLE')} THEN 2 * pi() ELSE list_transform([list_reduce(list_transform(range(60), lambda i: {{'lo': 1e-9::DOUBLE, 'hi': 5.3784::DOUBLE}}), lambda a, x: CASE WHEN {LOAD.format(t=HALF)} < q THEN {{'lo': {HALF}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {HALF}}} END, {{'lo': 1e-9::DOUBLE, 'hi': 5.3784::DOUBLE}})], lambda a: {HALF})[1] END"
SLOPE_OF = f"greatest({_manning('0.61::DOUBLE', 'd / 4')}, CASE WHEN q > 0 THEN least({_manning(f'(q / ({LIMIT} * pi() * d * d / 4))', 'd / 4')}, {_manning('3.05::DOUBLE', 'd / 4')}) ELSE {_manning('0.61::DOUBLE', 'd / 4')} END)"


@query(
    "SELECT u, v, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("diameter", "slope", "velocity", "fill", "cost_usd", "us_invert", "ds_invert")) + " FROM size_ WHERE u IS NOT NULL",
    succ_=SUCC,
    below_=BELOW,
    pipes_=PIPES,
    up_="SELECT node, 0 AS hops FROM succ_ UNION ALL SELECT s.next, u.hops + 1 FROM up_ u JOIN succ_ s ON s.node = u.node WHERE s.next IS NOT NULL",
    level_="SELECT p.*, coalesce(l.level, 0) AS level FROM pipes_ p LEFT JOIN (SELECT node, max(hops) AS level FROM up_ GROUP BY node) l ON l.node = p.u",
    # level after level from the leaves: a node's feeders lie in levels before
    **{"size_(u, v, level, diameter, slope, velocity, fill, cost_usd, us_invert, ds_invert) USING KEY (u)": f"""SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION (
        WITH begun AS (
            SELECT l.u, l.v, l.level, l.q, l.length, l.zu, l.zv, coalesce(f.least_d, 0) AS least_d, greatest(coalesce(f.floor, l.zu - 0.5::DOUBLE), l.zu - 5) AS above
            FROM level_ l LEFT JOIN (SELECT v, max(ds_invert) AS floor, max(diameter) AS least_d FROM recurring.size_ GROUP BY v) f ON f.v = l.u WHERE l.level = (SELECT max(level) + 1 FROM size_)),
        started AS (SELECT *, CASE WHEN above < zv + 0.001::DOUBLE * length THEN least(zv + 0.001::DOUBLE * length, zu - 0.01::DOUBLE) ELSE above END AS start FROM begun),
        tried AS (SELECT *, {SLOPE_OF} AS wished FROM started, (SELECT round(0.15::DOUBLE + 0.075::DOUBLE * i, 3) AS d FROM range(39) t(i)) WHERE d >= least_d),
        deep AS (SELECT *, zv - (start - wished * length) AS want FROM tried),
        laid AS (SELECT *, least(greatest(want, 0.5::DOUBLE), 5) AS depth, least(greatest(want, 0.5::DOUBLE), 5) <> want AS limited FROM deep),
        sloped AS (SELECT *, CASE WHEN limited THEN (start - (zv - depth)) / length ELSE wished END AS s FROM laid),
        wet AS (SELECT *, {ANGLE} AS t FROM sloped WHERE s > 0),
        flows AS (SELECT *, CASE WHEN t > 0 THEN (1 - cos(t / 2)) / 2 ELSE 0 END AS fill, CASE WHEN t > 0 THEN (d * d / 8 * (t - sin(t))) / (d * t / 2) ELSE 0 END AS radius, CASE WHEN t > 0 THEN q / (d * d / 8 * (t - sin(t))) ELSE 0 END AS vel FROM wet),
        fits AS (SELECT u, min(d) AS d FROM flows WHERE fill <= {LIMIT} AND CASE WHEN limited THEN q * 1.5::DOUBLE <= sqrt(s) * pow(d / 4, 2::DOUBLE / 3) / 0.012::DOUBLE * pi() * d * d / 4
            ELSE q <= 0 OR (vel BETWEEN 0.61::DOUBLE AND 3.05::DOUBLE AND NOT (d >= 0.45::DOUBLE AND 1000 * 9.81::DOUBLE * radius * s < 2)) END GROUP BY u),
        largest AS (SELECT *, 3.0::DOUBLE AS d, greatest((start - (zv - 5)) / length, 0.001::DOUBLE) AS s FROM started WHERE u NOT IN (SELECT u FROM fits)),
        chosen AS (SELECT u, v, level, d, s, vel, fill, start, length, zu, depth FROM flows JOIN fits USING (u, d) UNION ALL
            SELECT u, v, level, d, s, CASE WHEN t > 0 THEN q / (d * d / 8 * (t - sin(t))) ELSE 0 END, CASE WHEN t > 0 THEN (1 - cos(t / 2)) / 2 ELSE 0 END, start, length, zu, zv - (start - s * length) FROM (SELECT *, {ANGLE} AS t FROM largest))
        SELECT u, v, level, d, s, vel, fill, 1.32::DOUBLE / 2000 * (9579.31::DOUBLE * pow(d, 0.5737::DOUBLE) + 1163.77::DOUBLE * pow(greatest(length * (d + 0.3::DOUBLE) * ((zu - start + depth) / 2 + 0.1::DOUBLE), 0), 1.31::DOUBLE)), start, start - s * length FROM chosen)"""},
)
def pipe_by_pipe_full(spark, d):
    n = fx.nodes(spark, d)
    s = succ(spark, d).where("next is not null").select(F.col("node").alias("u"), F.col("next").alias("v"), F.lit(50.0).alias("length"))
    out = design.pipe_by_pipe(s, n, Hydraulics())
    return out.select("u", "v", *[F.round(c, 5).alias(c) for c in ("diameter", "slope", "velocity", "fill", "cost_usd", "us_invert", "ds_invert")])


@query("SELECT v AS node, max(0.3::DOUBLE + u % 5 * 0.075::DOUBLE) AS max_height, sum((0.3::DOUBLE + u % 5 * 0.075::DOUBLE) * (0.3::DOUBLE + u % 5 * 0.075::DOUBLE)) AS sum_d2, count(*) AS n_in, round(sqrt(sum((0.3::DOUBLE + u % 5 * 0.075::DOUBLE) * (0.3::DOUBLE + u % 5 * 0.075::DOUBLE) * pi() / 4) * 4 / pi()), 6) AS stub FROM fx_edges GROUP BY v")
def node_pipe_heights(spark, d):
    e = fx.edges(spark, d).withColumn("diameter", F.lit(0.3) + F.col("u") % 5 * 0.075)
    return e.groupBy(F.col("v").alias("node")).agg(F.max("diameter").alias("max_height"), F.sum(F.col("diameter") * F.col("diameter")).alias("sum_d2"), F.count("*").alias("n_in"), F.round(F.sqrt(F.sum(F.col("diameter") * F.col("diameter") * math.pi / 4) * 4 / math.pi), 6).alias("stub"))
