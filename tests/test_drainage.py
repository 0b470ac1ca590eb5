"""Numeric anchors and small graphs."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from riverine.functions import geo, numeric, ponds, storms, text
from riverine.network import Network
from riverine.operators import design, graph, network, outfalls, raster, spatial
from riverine.params import Hydraulics, Parameters, Ponds
from riverine.plans import inp, model
from riverine.plans.pipeline import Pipeline, Step, build_pipeline


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_turn_costs(spark):
    got = one(spark, *[numeric.turn_cost(F.lit(float(a))) for a in (180, 90, 29.9, 120, 135, 157.5)])
    assert got == pytest.approx((0, 0.2, 1, 0.6, 0.2, 0.1))


def test_slope_cost(spark):
    assert one(spark, *[numeric.slope_cost(F.lit(s / 100)) for s in (0.3, 0.5, -1.0, -5.0, 20.0, 10.0)]) == pytest.approx((0, 0, 1, 1, 1, 1), abs=1e-9)


def test_turn_angle(spark):
    c = [F.lit(float(x)) for x in (0, 0, 1, 0, 2, 0)]
    assert one(spark, geo.turn_angle(*c))[0] == pytest.approx(180)
    c = [F.lit(float(x)) for x in (0, 0, 0, 0, 2, 0)]
    assert one(spark, geo.turn_angle(*c))[0] is None


def test_weir_units(spark):
    assert one(spark, numeric.weir_coefficient(3.33, F.lit("LPS")))[0] == pytest.approx(1.838, abs=1e-3)


def test_part_full(spark):
    full = one(spark, numeric.full_capacity(F.lit(1.0), F.lit(0.01)))[0]
    half = one(spark, numeric.part_full(F.lit(full / 2), F.lit(1.0), F.lit(0.01)))[0]
    assert half["fill"] == pytest.approx(0.5, abs=1e-6)
    assert half["area"] == pytest.approx(math.pi / 8, abs=1e-6)
    assert one(spark, numeric.part_full(F.lit(0.0), F.lit(1.0), F.lit(0.01)))[0]["velocity"] == 0


def test_general_matches_c(spark):
    values = [0.0, 0.3, 1e10, 123456.0, 1234567.0, 1e-4, 1e-5, -2.5, 0.1 + 0.2, 999999.5, 3.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.general(F.col("v"))).collect()]
    assert got == ["%g" % v for v in values]


@pytest.mark.parametrize("storm", ["II", "III"])
@pytest.mark.parametrize("duration,step", [("24-hr", 6), ("6-hr", 15), ("60-min", 5)])
def test_storm_conserves_depth(spark, storm, duration, step):
    rows = storms.hyetograph(spark, 100.0, storm, duration, step).orderBy("date").collect()
    assert sum(r["value"] for r in rows) * step / 60 == pytest.approx(100, rel=1e-9)
    assert min(r["value"] for r in rows) >= 0
    assert rows[-1]["value"] == 0


def test_storm_errors(spark):
    with pytest.raises(ValueError):
        storms.hyetograph(spark, 1.0, "IV")
    with pytest.raises(ValueError):
        storms.hyetograph(spark, 1.0, step_min=7)


def test_pond_depth_holds_volume(spark):
    p = Ponds()
    for area in (600.0, 5000.0, 40000.0):
        v = one(spark, ponds.volume(F.lit(area), p))[0]
        d = one(spark, ponds.max_depth(F.lit(area), F.lit(v), p))[0]
        got = one(spark, ponds.curve_volume(ponds.curve(F.lit(area), F.lit(d), p)))[0]
        assert d == p.max_depth_m or abs(got - v) / v < 0.05


def grid(spark, n=4):
    nodes = [(i, float(i % n * 10), float(i // n * 10), 10.0 + (i * 7 % 11), 100.0) for i in range(n * n)]
    edges = [(i, i + 1) for i in range(n * n) if i % n < n - 1] + [(i, i + n) for i in range(n * (n - 1))]
    return spark.createDataFrame(nodes, "node_id long, x double, y double, surface_elevation double, contributing_area double"), spark.createDataFrame([(u, v, f"{u}-{v}", 10.0, 0, "pipe", "residential") for u, v in edges], "u long, v long, id string, length double, key int, edge_type string, highway string")


def test_components_and_isolated(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (5, 5)], "a long, b long")
    n = spark.createDataFrame([(9,), (5,)], "node long")
    got = {r["node"]: r["root"] for r in graph.components(e, n).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9, 5: 5}


def test_long_path_is_one_component(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(e).select("root").distinct().count() == 1


def test_spanning_forest_both_ways(spark):
    _, edges = grid(spark)
    e = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), (F.col("u") * 7 % 5 + F.col("v") * 3 % 4).cast("double").alias("weight"))
    small = sorted(map(tuple, graph.spanning_forest(e).collect()))
    rounds = sorted(map(tuple, graph.spanning_forest(e, one_task=-1).collect()))
    assert small == rounds and len(small) == 15


def test_dogleg_pays_for_its_turns(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, 1.0, 1.0)], "node_id long, x double, y double")
    e = spark.createDataFrame([(0, 1, 1.05), (1, 2, 1.05), (0, 3, 1.0), (3, 2, 1.0)], "u long, v long, weight double")
    root = spark.createDataFrame([(2,)], "node long")
    straight = {r["node"]: r["next"] for r in graph.turn_forest(e, n, root, 1.0).collect()}
    free = {r["node"]: r["next"] for r in graph.turn_forest(e, n, root, 0.0).collect()}
    assert straight[0] == 1 and free[0] == 3


def test_additive_forest_against_brute_force(spark):
    _, edges = grid(spark)
    both = network.double_directed(edges).withColumn("weight", (F.col("u") * 5 % 7 + 1).cast("double"))
    got = {r["node"]: r["dist"] for r in graph.shortest_forest(both, spark.createDataFrame([(5,)], "node long")).collect()}
    w = {(r["u"], r["v"]): r["weight"] for r in both.collect()}
    dist = {n: math.inf for n in range(16)} | {5: 0.0}
    for _ in range(16):
        for (u, v), x in w.items():
            dist[u] = min(dist[u], dist[v] + x)
    assert got == pytest.approx(dist)


def test_accumulate_chain(spark):
    s = spark.createDataFrame([(i, i + 1 if i < 9 else None, 1.0) for i in range(10)], "node long, next long, amount double")
    assert {r["node"]: r["total"] for r in graph.accumulate(s).collect()} == {i: i + 1.0 for i in range(10)}
    assert {r["node"]: r["most"] for r in graph.reach_max(s).collect()} == {i: 1.0 for i in range(10)}


def test_split_long(spark):
    e = spark.createDataFrame([("a", [(0.0, 0.0), (200.0, 0.0)])], "id string, geometry array<struct<x:double,y:double>>")
    got = network.split_long(e, 60).orderBy("part").collect()
    assert len(got) == 4 and all(r["length"] <= 60 for r in got)


def test_ids_collide(spark):
    e = spark.createDataFrame([(1, 2, 0, "pipe", "x"), (1, 2, 1, "river", "x"), (3, 4, 0, "pipe", "y"), (5, 6, 0, "pipe", None)], "u long, v long, key int, edge_type string, id string")
    assert sorted(r["id"] for r in network.assign_ids(e).collect()) == ["1-2", "1-2-river", "5-6", "y"]


def test_keep_types(spark):
    n = spark.createDataFrame([(i, 0.0, 0.0) for i in range(7)], "node_id long, x double, y double")
    e = spark.createDataFrame([(0, 1, "pipe"), (1, 2, "outfall"), (3, 1, "pond_connector"), (4, 5, "river"), (0, 6, "pipe")], "u long, v long, edge_type string")
    left = network.keep_types(Network(n, e), ["pipe"])
    assert sorted(r["node_id"] for r in left.nodes.collect()) == [0, 1, 6]
    assert left.edges.count() == 2


def test_match_distance_is_inclusive(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "k long, x double, y double")
    b = spark.createDataFrame([(7, 15.0, 0.0), (8, 115.001, 0.0)], "o long, x2 double, y2 double")
    assert [tuple(r) for r in spatial.nearest_points(a, b, 15.0, "k", "o").collect()] == [(1, 7, 15.0)]


def test_crossing_drops_one(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("b", 0.0, 5.0, 4.0, 5.0), ("touch", 5.0, 5.0, 9.0, 5.0)], "id string, ax double, ay double, bx double, by double")
    r = spark.createDataFrame([(1, 5.0, -5.0, 5.0, 20.0)], "river_id long, x0 double, y0 double, x1 double, y1 double")
    assert [x[0] for x in spatial.crossing(s, r, 10).collect()] == ["a"]


def test_valley_drains_to_its_floor(spark):
    cells = spark.createDataFrame([(i, j, 100 - 0.5 * i + 0.02 * (j - 5) ** 2 + 0.01 * abs(j - 5)) for i, j in itertools.product(range(12), range(11))], "row_ long, col_ long, value double")
    top = raster.flow_accumulation(raster.d8(cells)).orderBy(F.desc("cells")).first()
    assert (top["row_"], top["col_"], top["cells"]) == (11, 5, 132)


def flooded(cells):
    """{cell: the neighbour it drains to} by a heap that settles (level, distance) from the outlets inwards."""
    import heapq

    about = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (r + i, c + j) in cells]
    done, heap = {}, [(v, 0, k) for k, v in cells.items() if len(about(*k)) < 8]
    outlets = {k for _, _, k in heap}
    heapq.heapify(heap)
    while heap:
        level, far, k = heapq.heappop(heap)
        if k in done:
            continue
        done[k] = (level, far)
        for b in about(*k):
            if b not in done and b not in outlets:
                heapq.heappush(heap, (max(cells[b], level), far + 1, b))
    return {k: min((max(cells[k], done[b][0]), done[b][1] + 1, b) for b in about(*k))[2] for k in cells if k not in outlets}


def test_breach_is_brute_force_and_loses_no_cell(spark):
    import random

    rng = random.Random(11)
    cells = {(i, j): float(rng.randint(0, 12)) for i in range(15) for j in range(17) if (i, j) != (4, 9)}
    # a winding channel: the way out is far longer than the distance to the border
    for i in range(2, 13):
        for j in range(2, 15):
            cells[i, j] = cells[i, j] + 30 if i % 2 and j != (13 if i % 4 == 1 else 3) else 1.0
    want = flooded(cells)
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row_ long, col_ long, value double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in raster.breach(df).collect()}
    assert got == want


def test_breach_raises_when_rounds_run_out(spark):
    df = spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(9)], "row_ long, col_ long, value double")
    with pytest.raises(RuntimeError):
        raster.breach(df, 2)
    assert raster.breach(df).count() == 49


def test_repair_parts_keeps_area(spark):
    labels = [(0, j, 1 if j < 4 else 2) for j in range(8)] + [(1, j, 2 if j == 0 else 1 if j < 4 else 2) for j in range(8)]
    got = raster.repair_parts(spark.createDataFrame(labels, "row_ long, col_ long, id long")).collect()
    assert len(got) == 16 and {(r["row_"], r["col_"]): r["id"] for r in got}[(1, 0)] == 1


def test_pipe_series_grow_downstream(spark):
    n = spark.createDataFrame([(i, float(i), 0.0, 20.0 - i, 500_000.0) for i in range(6)], "node_id long, x double, y double, surface_elevation double, contributing_area double")
    e = spark.createDataFrame([(i, i + 1, 100.0) for i in range(5)], "u long, v long, length double")
    d = [r["diameter"] for r in design.pipe_by_pipe(e, n, Hydraulics()).orderBy("u").collect()]
    assert d == sorted(d) and len(d) == 5 and set(d) <= set(Hydraulics().diameters)


def test_nearest_bridge_joins_parts(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 2.0), (2, 30.0, 0.0, 5.0), (3, 40.0, 0.0, 6.0)], "node_id long, x double, y double, surface_elevation double")
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node long, root long")
    src = spark.createDataFrame([(0, 0), (2, 2)], "root long, node long")
    assert [tuple(r) for r in outfalls.trunk_bridges(parts, src, n, 50.0).collect()] == [(2, 1, 20.0)]


def prim(parts, src, xyz, longest):
    """Bridges as in trunk_bridges, one component at a time over all pairs."""
    joined, out = {min((xyz[n][2], r) for n, r in parts.items())[1]}, []
    while True:
        found = [(math.hypot(xyz[a][0] - xyz[b][0], xyz[a][1] - xyz[b][1]), a, b) for r, a in src.items() if r not in joined for b, p in parts.items() if p in joined]
        best = min((f for f in found if f[0] <= longest), default=None)
        if best is None:
            return out
        d, a, b = best
        joined.add(parts[a])
        out.append((a, b, d) if xyz[a][2] >= xyz[b][2] else (b, a, d))


def bridges(spark, parts, src, xyz, longest):
    n = spark.createDataFrame([(i, *v) for i, v in xyz.items()], "node_id long, x double, y double, surface_elevation double")
    got = outfalls.trunk_bridges(spark.createDataFrame(list(parts.items()), "node long, root long"), spark.createDataFrame(list(src.items()), "root long, node long"), n, longest)
    return sorted(tuple(r) for r in got.collect())


def test_bridges_are_those_of_brute_force(spark):
    import random

    rng = random.Random(7)
    xyz = {i: (rng.randint(0, 30) * 10.0, rng.randint(0, 30) * 10.0, float(rng.randint(0, 9))) for i in range(120)}
    parts = {i: i - i % 3 for i in xyz}
    src = {r: min((xyz[n][2], n) for n in range(r, r + 3))[1] for r in set(parts.values())}
    for longest in (25.0, 60.0):
        want = prim(parts, src, xyz, longest)
        assert bridges(spark, parts, src, xyz, longest) == sorted(want) and want


def test_bridges_have_no_limit_of_components(spark):
    xyz = {i: (10.0 * i, 0.0, float(i)) for i in range(1500)}
    same = {i: i for i in xyz}
    assert bridges(spark, same, same, xyz, 15.0) == [(i + 1, i, 10.0) for i in range(1499)]


def test_rounds_that_run_out_raise(spark):
    from riverine.operators import simplify, subcatchments

    s = spark.createDataFrame([(i, 100 + i) for i in range(4)], "sub_id long, outlet_id long")
    t = spark.createDataFrame([(i + 1, i, 1) for i in range(3)], "a long, b long, border int")
    assert {r["sub_id"]: r["outlet_id"] for r in subcatchments.adopt(s, s.where("sub_id > 0"), t).collect()} == {i: 100 for i in range(4)}
    with pytest.raises(RuntimeError):
        subcatchments.adopt(s, s.where("sub_id > 0"), t, rounds=1)
    succ = spark.createDataFrame([(1, 3), (2, 3), (3, 9), (9, None)], "node long, next long")
    with pytest.raises(RuntimeError):
        simplify.dangling(succ, succ.select("node", F.lit(1.0).alias("area")), succ.where("node = 9").select("node"), 100.0, rounds=1)


@pytest.mark.parametrize("block", [5, 12])
def test_turn_forest_by_blocks(spark, block):
    """Small blocks, solved again while labels beyond them change, give what one heap over everything gives."""
    import random

    rng = random.Random(2)
    side = 7
    nodes = spark.createDataFrame([(i * side + j, 10.0 * i, 10.0 * j) for i in range(side) for j in range(side)], "node_id long, x double, y double")
    pairs = [(a, b) for i in range(side) for j in range(side) for a, b in ((i * side + j, (i + 1) * side + j), (i * side + j, i * side + j + 1)) if b < side * side and (b - a == side or b % side)]
    edges = spark.createDataFrame([(u, v, rng.choice([1.0, 1.5, rng.random() + 0.1])) for a, b in pairs for u, v in ((a, b), (b, a))], "u long, v long, weight double")
    roots = spark.createDataFrame([(0,), (side * side - 1,)], "node long")
    whole = sorted(tuple(r) for r in graph.turn_forest(edges, nodes, roots, 0.3).collect())
    assert sorted(tuple(r) for r in graph.turn_forest(edges, nodes, roots, 0.3, block=block).collect()) == whole and len(whole) == side * side


def test_pipeline_resumes(spark, tmp_path):
    nodes, edges = grid(spark)
    nodes = nodes.withColumn("node_type", F.when(F.col("node_id") == 0, "river_outfall"))
    folder = f"file://{tmp_path}"
    key = lambda n: sorted(((r["u"], r["v"], r["diameter"]) for r in n.edges.collect()), key=repr)
    whole = key(build_pipeline().run(Network(nodes, edges), folder=folder))
    again = key(build_pipeline().run(None, spark=spark, folder=folder, resume_after="weights"))
    assert whole == again and sum(d is not None for _, _, d in whole) == 15
    assert [len(build_pipeline(**k).steps) for k in ({}, {"with_ponds": True}, {"bare": True})] == [28, 36, 24]
    with pytest.raises(ValueError):
        build_pipeline().run(None, spark=spark, folder=folder, resume_after="nothing")
    with pytest.raises(FileNotFoundError):
        build_pipeline().run(None, spark=spark, folder=folder + "/none", resume_after="weights")
    with pytest.raises(ValueError):
        Pipeline([Step("a", lambda n, p: n), Step("a", lambda n, p: n)])


def test_parameters(spark):
    p = Parameters()
    assert p.hydraulics.precipitation == 0.006 and len(p.hydraulics.diameters) == 39 and p.hydraulics.diameters[-1] == 3.0
    assert p.override({"ponds": {"weir_cw": 2.0}}).ponds.weir_cw == 2.0
    with pytest.raises(ValueError):
        p.override({"ponds": {"nothing": 1}})
    with pytest.raises(ValueError):
        p.override({"none": {}})


def test_model_text(spark, tmp_path):
    n = spark.createDataFrame([(2, "J2", 1.5), (1, "J1", 0.25)], "node_id long, Name string, invert_elev double")
    doc = inp.document(spark, {"JUNCTIONS": (n, "node_id"), "WEIRS": (spark.createDataFrame([], "Name string, k long"), "k")}, title="t")
    path = str(tmp_path / "model")
    inp.write(doc, path)
    lines = [r[0] for r in spark.read.text(sorted(str(p) for p in (tmp_path / "model").glob("part-*"))).collect()]
    assert "[WEIRS]" not in lines and "[EVAPORATION]" in lines
    at = lines.index("[JUNCTIONS]")
    assert lines[at + 1].startswith(";;Name") and lines[at + 2].split() == ["J1", "0.25", "0", "0", "0", "0"] and lines[at + 3].startswith("J2 ")
    with pytest.raises(ValueError):
        inp.options(spark, {"NO_SUCH": "1"})


def test_rain_file(spark, tmp_path):
    s = storms.hyetograph(spark, 10.0, "II", "60-min", 15)
    (tmp_path / "a.dat").write_text(";comment\n" + "\n".join(r[0] for r in inp.rain_lines(s).collect()) + "\n")
    back = inp.read_rain(spark, str(tmp_path / "a.dat"))
    assert back.count() == 5 and back.agg(F.round(F.sum("value"), 3)).first()[0] == pytest.approx(40, abs=0.01)


def test_model_from_lines(spark, tmp_path):
    point = lambda x, y: (float(x), float(y))
    streets = [([point(i * 50, j * 50), point((i + 1) * 50, j * 50)], "residential", "2", "pipe") for i in range(3) for j in range(3)]
    streets += [([point(i * 50, j * 50), point(i * 50, (j + 1) * 50)], "residential", "2", "pipe") for i in range(4) for j in range(2)]
    streets += [([point(0, 0), point(-40, -40)], "residential", "2", "pipe"), ([point(-40, -40), point(-80, -80)], None, None, "river"), ([point(75, 20), point(76, 90)], "footway", "1", "pipe")]
    lines = spark.createDataFrame(streets, "geometry array<struct<x:double,y:double>>, highway string, lanes string, edge_type string")
    cells = spark.createDataFrame([(r, c, 5.0 + 0.2 * (r + c)) for r in range(-6, 14) for c in range(-6, 20)], "row_ long, col_ long, value double")
    n, doc = model.synthesise(spark, lines, cells, 10.0, folder=f"file://{tmp_path}/run")
    kinds = {r["edge_type"]: r["count"] for r in n.edges.groupBy("edge_type").count().collect()}
    assert kinds == {"pipe": 11, "outfall": 1, "river": 1, "street_channel": 11, "orifice": 12}
    assert n.subs.agg(F.sum("area")).first()[0] == cells.count() * 100
    assert n.edges.where("edge_type = 'pipe' and (diameter is null or diameter < 0.15)").count() == 0
    text = [r["text"] for r in doc.orderBy("section_no", "ord", "ord_text").collect()]
    for section in ("[TITLE]", "[SUBCATCHMENTS]", "[SUBAREAS]", "[INFILTRATION]", "[JUNCTIONS]", "[OUTFALLS]", "[CONDUITS]", "[ORIFICES]", "[XSECTIONS]", "[MAP]", "[COORDINATES]"):
        assert section in text
    body = lambda name: [x.split() for x in text[text.index(f"[{name}]") + 2 : next((i for i, x in enumerate(text[text.index(f"[{name}]") :], text.index(f"[{name}]")) if not x), len(text))]]
    links, ends = body("CONDUITS") + body("ORIFICES"), {x[0] for x in body("OUTFALLS")}
    names = {x[0] for x in body("JUNCTIONS")} | ends
    assert {x[0] for x in body("COORDINATES")} == names and all(x[1] in names and x[2] in names for x in links)
    assert all(sum(x[2] == e for x in links) <= 1 and not any(x[1] == e for x in links) for e in ends) and ends
    assert all(x[2] in names for x in body("SUBCATCHMENTS"))


def test_ponds_in_the_pipeline(spark, tmp_path):
    nodes, edges = grid(spark)
    nodes = nodes.withColumn("node_type", F.when(F.col("node_id") == 0, "river_outfall"))
    water = spark.createDataFrame([(901, 21.0, 12.0, 900.0, "pond"), (902, 22.0, 11.0, 600.0, None), (903, 5.0, 5.0, 900.0, "lake"), (904, 900.0, 900.0, 900.0, "pond")], "pond_id long, x double, y double, area_m2 double, water string")
    out = build_pipeline(bare=True, with_ponds=True).run(Network(nodes, edges, meta={"ponds": water}), folder=f"file://{tmp_path}")
    kinds = {r["edge_type"]: r["count"] for r in out.edges.groupBy("edge_type").count().collect()}
    assert kinds == {"pipe": 14, "orifice": 1, "weir": 1, "pond_outflow": 1, "pond_inflow": 1}
    text = [r["text"] for r in model.document(spark, out).orderBy("section_no", "ord", "ord_text").collect()]
    at = text.index("[STORAGE]")
    assert text[at + 2].split()[0] == "901" and text[at + 2].split()[4:6] == ["TABULAR", "901_curve"] and "[WEIRS]" in text and "[LOSSES]" in text and "[CURVES]" in text
    assert {r["node_id"] for r in out.nodes.where("node_type in ('water_body', 'outlet_junction')").collect()} == {901, -901}
