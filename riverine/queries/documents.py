"""The model's text, a query per section."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, ponds as fn
from ..operators import subcatchments
from ..params import Ponds
from ..plans import emit, inp
from ..sources import fixtures as fx
from .base import query

P = Ponds()


def g(x: str) -> str:
    """SQL of a number as C's %g writes it."""
    return f"format('{{:g}}', CAST({x} AS DOUBLE))"


def line(section: str, kind: str | None = None, **cells: str) -> str:
    """SQL of a section's line out of SQL texts for some of its columns; the others take their defaults."""
    spec = inp.COLUMNS.get(f"{section}/{kind}", inp.COLUMNS[section])
    text = [f"coalesce({cells[n]}, '{d}')" if n in cells else f"'{d}'" for n, _, d in spec]
    padded = [f"rpad({x}, greatest({w}, CAST(length({x}) AS INTEGER)), ' ')" for x, (_, w, _) in zip(text[:-1], spec, strict=False)]
    return "rtrim(concat_ws(' ', " + ", ".join([*padded, text[-1]]) + "))"


def select(section: str, order: str, source: str, kind: str | None = None, **cells: str) -> str:
    return f"SELECT CAST({inp.ORDER.index(section) + 1} AS INTEGER) AS section_no, CAST({order} AS VARCHAR) AS ord_text, {line(section, kind, **cells)} AS text FROM {source}"


def lines(section: str, df, order: str, kind: str | None = None):
    return inp.rows(section, df, order, kind).select("section_no", "ord_text", "text")


KINDS = {"primary": "pipe", "residential": "river", "footway": "orifice", "tertiary": "weir"}
LINKS = """SELECT u, v, id, length, CASE highway WHEN 'primary' THEN 'pipe' WHEN 'residential' THEN 'river' WHEN 'footway' THEN 'orifice' WHEN 'tertiary' THEN 'weir' ELSE CASE WHEN u % 2 = 0 THEN 'outfall' ELSE 'pond_outflow' END END AS edge_type,
    CASE WHEN u % 6 > 0 THEN 0.1::DOUBLE + u % 5 * 0.075::DOUBLE END AS diameter, 0.005::DOUBLE + u % 4 * 0.01::DOUBLE AS roughness, CASE WHEN u % 3 > 0 THEN 0.5::DOUBLE + u % 9 END AS channel_depth, CASE WHEN u % 3 > 0 THEN 1.5::DOUBLE + u % 7 END AS channel_width,
    CASE WHEN u % 4 > 0 THEN u % 4 * 0.25::DOUBLE END AS in_offset, CASE WHEN u % 5 > 0 THEN u % 5 * 0.125::DOUBLE END AS out_offset, CASE WHEN u % 3 = 0 THEN 'BOTTOM' END AS orifice_type, CASE WHEN u % 3 = 0 THEN 'NO' END AS flap_gate,
    CASE WHEN u % 2 = 0 THEN 0.2032::DOUBLE END AS orifice_diam_m, CASE WHEN u % 3 = 0 THEN 0.62::DOUBLE END AS orifice_cd, CASE WHEN u % 2 = 0 THEN 0.1::DOUBLE END AS orifice_offset, CASE WHEN u % 5 > 0 THEN 1 + u % 5 * 0.5::DOUBLE END AS weir_crest_m, CASE WHEN u % 4 > 0 THEN 3 + u % 4 END AS weir_length_m FROM fx_edges"""


def links(spark, d):
    u = F.col("u")
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("highway")]
    some = lambda condition, value: F.when(condition, value)
    return fx.edges(spark, d).select(
        "u", "v", "id", "length", F.coalesce(named, F.when(u % 2 == 0, F.lit("outfall")).otherwise("pond_outflow")).alias("edge_type"), some(u % 6 > 0, 0.1 + u % 5 * 0.075).alias("diameter"), (0.005 + u % 4 * 0.01).alias("roughness"),
        some(u % 3 > 0, 0.5 + u % 9).alias("channel_depth"), some(u % 3 > 0, 1.5 + u % 7).alias("channel_width"), some(u % 4 > 0, u % 4 * 0.25).alias("in_offset"), some(u % 5 > 0, u % 5 * 0.125).alias("out_offset"),
        some(u % 3 == 0, F.lit("BOTTOM")).alias("orifice_type"), some(u % 3 == 0, F.lit("NO")).alias("flap_gate"), some(u % 2 == 0, F.lit(0.2032)).alias("orifice_diam_m"), some(u % 3 == 0, F.lit(0.62)).alias("orifice_cd"),
        some(u % 2 == 0, F.lit(0.1)).alias("orifice_offset"), some(u % 5 > 0, 1 + u % 5 * 0.5).alias("weir_crest_m"), some(u % 4 > 0, (3 + u % 4).cast("double")).alias("weir_length_m"),
    )


FLOORS = "SELECT node_id, x, y, CASE WHEN node_id % 11 > 0 THEN round(surface_elevation - 3, 3) END AS floor FROM fx_nodes"


def floors(spark, d):
    return fx.nodes(spark, d).withColumn("chamber_floor_elevation", F.when(F.col("node_id") % 11 > 0, numeric.rounded(F.col("surface_elevation") - 3, 3)))


@query(select("OUTFALLS", "node_id", "floor_ WHERE node_id IN (SELECT v FROM fx_edges WHERE highway = 'track')", Name="CAST(node_id AS VARCHAR)", InvertElev=g("round(coalesce(floor, 0) - 1, 3)")), floor_=FLOORS)
def inp_outfalls(spark, d):
    sinks = fx.edges(spark, d).where("highway = 'track'").select(F.col("v").alias("node_id")).distinct()
    return lines("OUTFALLS", emit.outfall_rows(floors(spark, d), sinks).withColumn("InvertElev", numeric.rounded(F.col("InvertElev"), 3)), "node_id")


#: Stage-area curves of 2 m, embankments of up to 4 m more; some ponds have no curve, some are closed.
BANKS = "SELECT pond_id, area_m2, 10::DOUBLE AS z, CASE WHEN pond_id % 7 > 0 THEN 2::DOUBLE ELSE 1::DOUBLE END AS deep, CASE WHEN pond_id % 7 > 0 AND pond_id % 5 > 0 THEN least((pond_id % 5)::DOUBLE, 4) END AS bank, pond_id % 3 = 0 AS closed, pond_id % 7 > 0 AS has FROM fx_ponds"
TOPS = "SELECT *, CASE WHEN bank > deep + 0.05::DOUBLE THEN bank ELSE deep END AS top FROM bank_"


def banks(spark, d):
    k = F.col("pond_id")
    p = fx.ponds(spark, d).select(
        k.alias("node_id"), F.col("area_m2").alias("wb_area_m2"), F.lit(10.0).alias("chamber_floor_elevation"), F.lit(1.0).alias("wb_max_depth"), F.when(k % 7 > 0, fn.curve(F.col("area_m2"), F.lit(2.0), P)).alias("wb_curve"),
        F.when(k % 5 > 0, 10.0 + k % 5).alias("wb_embankment_elev"), (k % 3 == 0).alias("wb_closed_basin"),
    )
    return emit.storages(p, P)


@query(
    select("STORAGE", "pond_id", "top_", Name="CAST(pond_id AS VARCHAR)", InvertElev="'10'", MaxDepth=g("top"), StorageCurve="CASE WHEN has THEN 'TABULAR' ELSE 'FUNCTIONAL' END", Coefficient="CASE WHEN has THEN pond_id || '_curve' ELSE CAST(area_m2 AS VARCHAR) END",
           SurDepth="CASE WHEN closed THEN '2' ELSE '0' END", Psi="CASE WHEN closed THEN '50' ELSE '0' END", Ksat="CASE WHEN closed THEN '12.5' ELSE '0' END", IMD="CASE WHEN closed THEN '0.3' ELSE '0' END"),
    bank_=BANKS,
    top_=TOPS,
)
def inp_storage(spark, d):
    return lines("STORAGE", emit.storage_rows(banks(spark, d)), "node_id")


@query(
    select("CURVES", "pond_id * 100 + i", "point_", Name="pond_id || '_curve'", Type="CASE WHEN i = 0 THEN 'STORAGE' ELSE '' END", X=g("depth"), Y=g("area")),
    bank_=BANKS,
    top_=TOPS,
    point_="""SELECT pond_id, i, i * 0.5::DOUBLE AS depth, pow(greatest(sqrt(area_m2) - 8 * (2 - i * 0.5::DOUBLE), 0.3::DOUBLE * sqrt(area_m2)), 2) AS area FROM top_, range(5) t(i) WHERE has UNION ALL
        SELECT pond_id, 4 + k, 2 + (top - 2) * k / 4, pow(sqrt(area_m2) + 8 * (top - 2) * k / 4, 2) FROM top_, range(1, 5) t(k) WHERE has AND top > 2""",
)
def inp_curves(spark, d):
    return lines("CURVES", emit.curve_rows(banks(spark, d)), "ord")


ENDS = {"Name": "id", "InletNode": "CAST(u AS VARCHAR)", "OutletNode": "CAST(v AS VARCHAR)"}


@query(select("ORIFICES", "id", "link_ WHERE edge_type = 'orifice'", **ENDS, OrificeType="orifice_type", CrestHeight=g("orifice_offset"), DischCoeff=g("orifice_cd"), FlapGate="flap_gate"), link_=LINKS)
def inp_orifices(spark, d):
    return lines("ORIFICES", emit.orifice_rows(links(spark, d)), "id")


@query(select("WEIRS", "id", "link_ WHERE edge_type = 'weir'", **ENDS, CrestHeight=g("coalesce(weir_crest_m, 1)"), DischCoeff=g("3 * sqrt(0.3048::DOUBLE)")), link_=LINKS)
def inp_weirs(spark, d):
    return lines("WEIRS", emit.weir_rows(links(spark, d), P), "id")


OPEN = "edge_type IN ('river', 'pond_outflow', 'street_channel')"


@query(
    select("CONDUITS", "id", "link_ WHERE edge_type NOT IN ('orifice', 'weir')", **ENDS,
           Length=g(f"CASE WHEN edge_type = 'outfall' THEN greatest(length, 5 * coalesce(diameter, 0), 5) WHEN {OPEN} THEN greatest(length, coalesce(channel_depth, 0), 1) ELSE greatest(length, coalesce(diameter, 0), 1) END"),
           Roughness=g(f"CASE WHEN {OPEN} THEN CASE WHEN roughness > 0.02::DOUBLE THEN roughness ELSE 0.035::DOUBLE END WHEN roughness < 0.02::DOUBLE THEN roughness ELSE 0.01::DOUBLE END"),
           InOffset=g("coalesce(in_offset, 0)"), OutOffset=g("coalesce(out_offset, 0)"), MaxFlow=f"CASE WHEN {OPEN} THEN '0' ELSE '1e+10' END"),
    link_=LINKS,
)
def inp_conduits(spark, d):
    return lines("CONDUITS", emit.conduit_rows(links(spark, d)), "id")


@query(
    select("XSECTIONS", "id", "link_ LEFT JOIN wide_ ON n = u", Link="id", Shape=f"CASE WHEN {OPEN} OR edge_type = 'weir' THEN 'RECT_OPEN' ELSE 'CIRCULAR' END",
           Geom1=g(f"CASE WHEN edge_type = 'orifice' THEN coalesce(orifice_diam_m, 0.3::DOUBLE) WHEN edge_type = 'weir' THEN coalesce(weir_crest_m, 1) * 0.1::DOUBLE WHEN {OPEN} THEN coalesce(channel_depth, 1) ELSE greatest(coalesce(diameter, 0.3::DOUBLE), 0.15::DOUBLE, CASE WHEN edge_type = 'outfall' THEN coalesce(w, 0) ELSE 0 END) END"),
           Geom2=g(f"CASE WHEN edge_type = 'weir' THEN coalesce(weir_length_m, 4.6::DOUBLE) WHEN {OPEN} THEN coalesce(channel_width, 2) ELSE 0 END")),
    link_=LINKS,
    wide_="SELECT n, max(diameter) AS w FROM (SELECT u AS n, diameter FROM link_ WHERE edge_type = 'pipe' AND diameter > 0 UNION ALL SELECT v, diameter FROM link_ WHERE edge_type = 'pipe' AND diameter > 0) GROUP BY n",
)
def inp_xsections(spark, d):
    return lines("XSECTIONS", emit.sections(links(spark, d), P), "id")


@query(select("LOSSES", "id", "link_ WHERE edge_type = 'pond_outflow'", Link="id", FlapGate="'YES'"), link_=LINKS)
def inp_losses(spark, d):
    return lines("LOSSES", emit.loss_rows(links(spark, d)), "id")


NAMED = "SELECT *, outlet_id || '-' || (row_number() OVER (PARTITION BY outlet_id ORDER BY sub_id) - 1) || '-sub' AS name FROM fx_subs WHERE outlet_id IN (SELECT node_id FROM fx_nodes)"


def named(spark, d):
    return subcatchments.unique_names(subcatchments.with_outlet(fx.subs(spark, d), fx.nodes(spark, d)))


@query(select("SUBCATCHMENTS", "name", "named_", Name="name", Raingage="'1'", Outlet="CAST(outlet_id AS VARCHAR)", Area=g("area / 10000"), PercImperv=g("rc"), Width=g("sqrt(area / pi())"), PercSlope=g("slope")), named_=NAMED)
def inp_subcatchments(spark, d):
    s = named(spark, d).withColumn("width", F.sqrt(F.col("area") / F.pi()))
    return lines("SUBCATCHMENTS", emit.subcatchment_rows(s, "1"), "ord")


@query(select("SUBAREAS", "name", "named_", Name="name"), named_=NAMED)
def inp_subareas(spark, d):
    return lines("SUBAREAS", named(spark, d).select("name"), "name")


@query(" UNION ALL ".join(select("INFILTRATION", "name", f"named_ WHERE sub_id % 3 = {i}", kind, Subcatchment="name") for i, kind in enumerate((None, "GREEN_AMPT", "CURVE_NUMBER"))), named_=NAMED)
def inp_infiltration(spark, d):
    s = named(spark, d).withColumn("Subcatchment", F.col("name"))
    parts = [lines("INFILTRATION", s.where(f"sub_id % 3 = {i}").select("name", "Subcatchment"), "name", kind) for i, kind in enumerate((None, "GREEN_AMPT", "CURVE_NUMBER"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    select("RAINGAGES", "rain_gage", "(SELECT rain_gage, CAST(arg_min(s, (-n, s)) AS BIGINT) AS s FROM (SELECT rain_gage, s, count(*) AS n FROM (SELECT rain_gage, date_diff('second', lag(date_) OVER (ORDER BY date_), date_) AS s FROM fx_rain) WHERE s IS NOT NULL GROUP BY 1, 2) GROUP BY 1)",
           Name="'1'", Format="'INTENSITY'", Interval="lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')", Source="'FILE'", Filename="'rain.dat'", Station="'1'", Units="'MM'")
)
def inp_raingages(spark, d):
    return lines("RAINGAGES", emit.raingage_row(fx.rain(spark, d), "1", "rain.dat", date="date_"), "rain_gage")


@query(select("Polygons", "name || '/' || lpad(CAST(i AS VARCHAR), 6, '0')", "(SELECT name, i, x + CASE WHEN i IN (0, 3) THEN -25 ELSE 25 END AS px, y + CASE WHEN i < 2 THEN -25 ELSE 25 END AS pz FROM named_ JOIN fx_nodes ON node_id = sub_id, (SELECT unnest(range(4)) AS i))", Subcatchment="name", X=g("px"), Y=g("pz")), named_=NAMED)
def inp_polygons(spark, d):
    n = fx.nodes(spark, d).select(F.col("node_id").alias("sub_id"), "x", "y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    rings = named(spark, d).join(n, "sub_id").select("name", F.array(corner(-25, -25), corner(25, -25), corner(25, 25), corner(-25, 25)).alias("ring"))
    return lines("Polygons", emit.polygon_rows(rings), "ord")


@query(select("COORDINATES", "node_id", "fx_nodes", Name="CAST(node_id AS VARCHAR)", X=g("x"), Y=g("y")))
def inp_coordinates(spark, d):
    return lines("COORDINATES", fx.nodes(spark, d).select("node_id", F.col("node_id").cast("string").alias("Name"), F.col("x").alias("X"), F.col("y").alias("Y")), "node_id")


@query(select("MAP", "0", "(SELECT printf('%.3f %.3f %.3f %.3f', min(x), min(y), max(x), max(y)) AS box FROM fx_nodes)", Key="'DIMENSIONS'", Value="box"))
def inp_map(spark, d):
    return lines("MAP", emit.map_row(fx.nodes(spark, d)), "n")


def _header(section: str) -> str:
    head = " ".join([f";;{inp.COLUMNS[section][0][0]}".ljust(16), *(n.ljust(16) for n, _, _ in inp.COLUMNS[section][1:])]).rstrip()
    texts = ["", f"[{section}]"] + ([] if section in inp.ALWAYS else [head])
    return " UNION ALL ".join(f"SELECT CAST({inp.ORDER.index(section) + 1} AS INTEGER) AS section_no, '' AS ord_text, {i} AS place, '{t}' AS text" for i, t in enumerate(texts))


def _fixed(section: str, rows) -> str:
    (a, _, _), *rest = inp.COLUMNS[section]
    names = [a, *[x for x, _, _ in rest]]
    return " UNION ALL ".join(select(section, str(i), "(SELECT 1)", **{n: f"'{v}'" for n, v in zip(names, r, strict=True)}).replace(" AS ord_text,", " AS ord_text, 9 AS place,") for i, r in enumerate(rows) if r[-1])


DOCUMENT = [
    *[_header(x) for x in ("TITLE", "OPTIONS", "EVAPORATION", "REPORT", "JUNCTIONS", "CONDUITS", "COORDINATES")],
    _fixed("TITLE", [("grid",)]), _fixed("OPTIONS", inp.OPTIONS.items()), _fixed("EVAPORATION", [("CONSTANT", "0"), ("DRY_ONLY", "NO")]), _fixed("REPORT", [("INPUT", "YES"), ("CONTROLS", "YES"), ("SUBCATCHMENTS", "ALL"), ("NODES", "ALL"), ("LINKS", "ALL")]),
    *[x.replace(" AS ord_text,", " AS ord_text, 9 AS place,") for x in (
        select("JUNCTIONS", "node_id", "fx_nodes", Name="'J' || node_id", InvertElev=g("surface_elevation - 3")),
        select("CONDUITS", "id", "fx_edges", Name="id", InletNode="'J' || u", OutletNode="'J' || v", Length=g("length")),
        select("COORDINATES", "node_id", "fx_nodes", Name="'J' || node_id", X=g("x"), Y=g("y")),
    )],
]


@query("SELECT section_no, ord_text, CAST(row_number() OVER (PARTITION BY section_no ORDER BY place, coalesce(try_cast(ord_text AS DOUBLE), 0), ord_text) AS INTEGER) AS n, text FROM (" + " UNION ALL ".join(DOCUMENT) + ")")
def inp_sections(spark, d):
    """A whole document, its lines numbered in the order in which they are written."""
    from pyspark.sql import Window

    n = fx.nodes(spark, d)
    names = n.select("node_id", F.concat(F.lit("J"), F.col("node_id").cast("string")).alias("Name"), (F.col("surface_elevation") - 3).alias("InvertElev"), "x", "y")
    e = fx.edges(spark, d).select("id", F.col("id").alias("Name"), F.concat(F.lit("J"), F.col("u").cast("string")).alias("InletNode"), F.concat(F.lit("J"), F.col("v").cast("string")).alias("OutletNode"), F.col("length").alias("Length"))
    doc = inp.document(spark, {"JUNCTIONS": (names.drop("x", "y"), "node_id"), "CONDUITS": (e, "id"), "COORDINATES": (names.select("node_id", "Name", F.col("x").alias("X"), F.col("y").alias("Y")), "node_id")}, title="grid")
    return doc.select("section_no", "ord_text", F.row_number().over(Window.partitionBy("section_no").orderBy("ord", "ord_text")).alias("n"), "text")


MERGE = "SELECT u, v, id, CASE WHEN u % 3 = 0 THEN 'RECT_OPEN' WHEN u % 3 = 1 THEN 'CIRCULAR' END AS shape, 0.3::DOUBLE + u % 5 * 0.1::DOUBLE AS geom1, 1 + (u % 4)::DOUBLE AS geom2 FROM fx_edges"
SINKS = "SELECT node_id, x, y, surface_elevation - 3 AS invert FROM fx_nodes WHERE node_id % 13 = 5"


def merge_links(spark, d):
    u = F.col("u")
    return fx.edges(spark, d).select(u.cast("string").alias("u"), F.col("v").cast("string").alias("v"), "id", F.when(u % 3 == 0, F.lit("RECT_OPEN")).when(u % 3 == 1, F.lit("CIRCULAR")).alias("shape"), (0.3 + u % 5 * 0.1).alias("geom1"), (1.0 + u % 4).alias("geom2"))


@query(
    "SELECT v AS node_id, round(sum(CASE shape WHEN 'CIRCULAR' THEN pi() * geom1 * geom1 / 4 WHEN 'RECT_OPEN' THEN geom1 * geom2 ELSE 0 END), 6) AS feeder_area FROM merge_ WHERE v IN (SELECT node_id FROM sinks_) GROUP BY v", merge_=MERGE, sinks_=SINKS
)
def feeder_areas(spark, d):
    sinks = fx.nodes(spark, d).where("node_id % 13 = 5").select("node_id")
    links_ = merge_links(spark, d).withColumn("v", F.col("v").cast("long"))
    return emit.feeder_areas(links_, sinks).select("node_id", F.round("feeder_area", 6).alias("feeder_area"))


MANY = "SELECT s.* FROM sinks_ s WHERE (SELECT count(*) FROM merge_ WHERE v = node_id) > 1 OR node_id IN (SELECT u FROM merge_)"


@query(
    """SELECT id, CASE WHEN u IN (SELECT node_id FROM many_) THEN u || '_merger' ELSE CAST(u AS VARCHAR) END AS u, CASE WHEN v IN (SELECT node_id FROM many_) THEN v || '_merger' ELSE CAST(v AS VARCHAR) END AS v, round(geom1, 6) AS geom1, CAST(NULL AS DOUBLE) AS length, CAST(NULL AS DOUBLE) AS invert FROM merge_ UNION ALL
    SELECT node_id || '_merger-' || node_id, node_id || '_merger', CAST(node_id AS VARCHAR), round(w, 6), round(greatest(5 * w, 5), 6), round(invert, 6) FROM (SELECT *, greatest(sqrt(4 * coalesce((SELECT sum(CASE shape WHEN 'CIRCULAR' THEN pi() * geom1 * geom1 / 4 WHEN 'RECT_OPEN' THEN geom1 * geom2 ELSE 0 END) FROM merge_ WHERE v = node_id), 0) / pi()), 0.45::DOUBLE) AS w FROM many_)""",
    merge_=MERGE,
    sinks_=SINKS,
    many_=MANY,
)
def outfall_mergers(spark, d):
    sinks = fx.nodes(spark, d).where("node_id % 13 = 5").select("node_id", "x", "y", (F.col("surface_elevation") - 3).alias("invert"))
    out, junctions, _ = emit.one_inlet(merge_links(spark, d).withColumn("length", F.lit(None).cast("double")), sinks)
    z = junctions.select(F.col("node").alias("u"), "invert")
    stub = F.col("id").contains("_merger-")
    return out.join(z, "u", "left").select("id", "u", "v", F.round("geom1", 6).alias("geom1"), F.when(stub, F.round("length", 6)).alias("length"), F.when(stub, F.round("invert", 6)).alias("invert"))


@query(
    """SELECT s.id, s.u, s.v FROM stub_ s JOIN fx_nodes a ON a.node_id = s.u JOIN fx_nodes b ON b.node_id = s.v WHERE s.v % 5 <> 0 AND a.surface_elevation > b.surface_elevation
        AND (a.surface_elevation - b.surface_elevation + s.u % 2 * 0.5::DOUBLE) / 50 > 0.05::DOUBLE AND (SELECT count(*) FROM stub_ WHERE u = s.u) = 1 AND (SELECT count(*) FROM stub_ WHERE v = s.u) = 1 AND (SELECT count(*) FROM stub_ WHERE v = s.v) = 1 AND s.v NOT IN (SELECT u FROM stub_)""",
    stub_="SELECT id, u, v FROM fx_edges WHERE highway IN ('primary', 'footway')",
)
def promoted_stubs(spark, d):
    e = fx.edges(spark, d).where("highway in ('primary', 'footway')").select("id", "u", "v", "length", (F.col("u") % 2 * 0.5).alias("in_offset"), F.lit(None).cast("double").alias("out_offset"))
    sinks = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    z = fx.nodes(spark, d).select(F.col("node_id").alias("node"), F.col("surface_elevation").alias("invert"))
    return emit.promoted(e, e, z, sinks, sinks.where("node % 5 = 0"), 0.05)


@query(
    "SELECT node_id, round(CASE WHEN node_id % 2 = 0 AND low IS NOT NULL THEN low ELSE floor END, 6) AS floor FROM floor_ LEFT JOIN (SELECT v, arg_max(a.floor - greatest(coalesce(diameter, 0), 0.3::DOUBLE), id) AS low FROM link_ JOIN floor_ a ON a.node_id = u WHERE edge_type = 'outfall' AND a.floor IS NOT NULL GROUP BY v) ON v = node_id",
    link_=LINKS,
    floor_=FLOORS,
)
def dummy_inverts(spark, d):
    n = floors(spark, d).withColumn("node_type", F.when(F.col("node_id") % 2 == 0, F.lit("dummy_river")))
    return emit.dummy_inverts(n, links(spark, d)).select("node_id", F.round("chamber_floor_elevation", 6).alias("floor"))
