"""Readers, writers, streams and simplification on small inputs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from riverine.network import Network
from riverine.operators import ponds, simplify, subcatchments
from riverine.sources import readers, writers
from riverine.streaming import rain


def result_file(series):
    """A binary result file of two nodes and a link."""
    names = [[], ["N1", "N2"], ["L1"], []]
    out = struct.pack("<7i", readers.RESULT_MAGIC, 51000, 3, 0, 2, 1, 0)
    ids = len(out)
    for part in names:
        for n in part:
            out += struct.pack("<i", len(n)) + n.encode()
    props = len(out)
    for n in (0, 2, 1):
        out += struct.pack("<i", 1) + struct.pack("<i", 0) + struct.pack(f"<{n}f", *[0.0] * n)
    for k in (8, 6, 5, 14):
        out += struct.pack("<i", k) + struct.pack(f"<{k}i", *range(k))
    out += struct.pack("<di", 40000.0, 900)
    results = len(out)
    for day, base in series:
        out += struct.pack("<d", day) + struct.pack("<12f", *[base + i for i in range(12)]) + struct.pack("<5f", *[100 + base] * 5) + struct.pack("<14f", *[7.0] * 14)
    return out + struct.pack("<6i", ids, props, results, len(series), 0, readers.RESULT_MAGIC)


def test_results(spark, tmp_path):
    (tmp_path / "a.out").write_bytes(result_file([(36526.0, 0.0), (36526.5, 50.0)]))
    r = readers.results(spark, str(tmp_path / "a.out"))
    assert r.count() == 2 * (12 + 5 + 14)
    got = r.where("name = 'N2' and attr = 'total_inflow'").orderBy("ts").collect()
    assert [x["value"] for x in got] == [10.0, 60.0]
    assert [str(x["ts"]) for x in got] == ["2000-01-01 00:00:00", "2000-01-01 12:00:00"]
    with pytest.raises(ValueError):
        list(readers.parse_results(b"\0" * 60))


def test_graph_json(spark, tmp_path):
    doc = {"directed": True, "nodes": [{"id": 1, "x": 0.0, "y": 0.0}, {"id": 2, "x": 3.0, "y": 4.0}], "links": [{"source": 1, "target": 2, "key": 0, "geometry": "LINESTRING (0 0, 3 4)"}, {"source": 2, "target": 1, "key": 0, "geometry": None}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2
    assert [[tuple(p) for p in r["geometry"]] if r["geometry"] else None for r in edges.orderBy("u").collect()] == [[(0.0, 0.0), (3.0, 4.0)], None]


def test_design_rain(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Point estimates\nby duration for ARI (years):, 1,2,5,10\n5-min:, 100,120,150,180\n60-min:, 30,36,45,6\n")
    assert readers.design_rain(spark, str(tmp_path / "a.csv"), 10, "60-min") == pytest.approx(0.006)
    for years, duration in ((25, "60-min"), (10, "7-day")):
        with pytest.raises(ValueError):
            readers.design_rain(spark, str(tmp_path / "a.csv"), years, duration)


def test_basins_and_register(spark, tmp_path):
    square = lambda s: [[(0.0, 0.0), (s, 0.0), (s, s), (0.0, s)]]
    df = spark.createDataFrame([(1, square(10.0)), (2, square(20.0)), (3, square(1000.0))], "id long, rings array<array<struct<x:double,y:double>>>")
    assert [(r["id"], r["area_m2"]) for r in readers.basins(df).collect()] == [(2, 400.0)]
    asked = []
    source = {"basins": lambda: asked.append(1) or readers.basins(df), "none": lambda: None}
    for _ in range(2):
        got = readers.register(source, spark, f"file://{tmp_path}/raw")
        assert set(got) == {"basins"} and got["basins"].count() == 1
    assert len(asked) == 1


def test_layers(spark, tmp_path):
    n = spark.createDataFrame([(1, "water_body"), (2, None)], "node_id long, node_type string")
    e = spark.createDataFrame([("1-grate", "orifice"), ("b", "orifice"), ("c", "pond_inflow"), ("d", "what")], "id string, edge_type string")
    writers.write_layers(Network(n, e), f"file://{tmp_path}/l")
    got = {r["id"]: r["layer"] for r in spark.read.parquet(f"file://{tmp_path}/l/edges").collect()}
    assert got == {"1-grate": "grates", "b": "orifices", "c": "pond_links", "d": "other"}
    assert spark.read.parquet(f"file://{tmp_path}/l/nodes").where("layer = 'storage'").count() == 1


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("SELECT CAST(1 AS INT) AS rain_gage, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 5 AS INT)) AS date, CAST(id AS DOUBLE) AS value FROM range(12)")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = rain.depths(rain.readings(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("rain_depths").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["depth"], r["n"]) for r in spark.table("rain_depths").orderBy("start").collect()] == [(3.0, 3), (12.0, 3), (21.0, 3), (30.0, 3)]


def test_dangling_leaves_go_until_none_is_small(spark):
    # 1 -> 2 -> 3 -> 9 and 4 -> 3; the chains above the branching node 3 are 1-2 (10) and 4 (50)
    s = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, 9), (9, None)], "node long, next long")
    a = spark.createDataFrame([(1, 5.0), (2, 5.0), (4, 50.0), (3, 1.0), (9, 0.0)], "node long, area double")
    k = spark.createDataFrame([(9,)], "node long")
    assert {tuple(r) for r in simplify.dangling(s, a, k, 20.0).collect()} == {(1, 3), (2, 3)}
    assert simplify.dangling(s, a, k, 10.0).count() == 0
    assert {tuple(r) for r in simplify.dangling(s, a, k, 1000.0).collect()} == {(1, 9), (2, 9), (3, 9), (4, 9)}


def test_chain_merges(spark):
    p = spark.createDataFrame([(1, 0, 100.0, 0.6, 0.01, 100.0, 0.1, 0.0), (1, 1, 100.0, 0.9, 0.02, 180.0, 0.0, 0.2)], "chain long, pos int, length double, diameter double, roughness double, contributing_area double, in_offset double, out_offset double")
    r = simplify.merge_chain(p).first()
    assert (r["length"], r["diameter"], r["contributing_area"], r["in_offset"], r["out_offset"]) == (200.0, 0.9, 280.0, 0.1, 0.2)
    assert r["roughness"] == pytest.approx(0.015)
    assert simplify.split_points(p, 500).count() == 0


def test_dissolve_anchor(spark):
    s = spark.createDataFrame([(i, 1 if i < 2 else 5, 100.0, 50.0, 0.01) for i in range(3)], "sub_id long, outlet_id long, area double, rc double, slope double")
    r = subcatchments.dissolve(s, spark.createDataFrame([(5, 1)], "node_id long, into long")).first()
    assert (r["area"], r["impervious_area"], r["rc"]) == (300.0, 150.0, 50.0)


def test_capacity_skips_what_does_not_fit(spark):
    o = spark.createDataFrame([(1, 10.0, 1, 1.0, 6.0), (1, 10.0, 2, 2.0, 5.0), (1, 10.0, 3, 3.0, 4.0)], "pond_id long, capacity double, sub_id long, distance double, area double")
    assert [r["sub_id"] for r in ponds.capacity_fill(o).orderBy("sub_id").collect()] == [1, 3]


def test_ponds_with_a_low_enough_outfall(spark):
    from riverine.params import Ponds

    e = spark.createDataFrame([(1, 2, 100.0), (2, 3, 100.0), (4, 5, 10.0)], "u long, v long, length double")
    p = spark.createDataFrame([(1, 5.0), (4, 5.0)], "pond_id long, head double")
    for low, far, want in ((4.6, 4.95, {1}), (2.5, 2.5, {1, 4}), (4.95, 4.95, set())):
        t = spark.createDataFrame([(3, low, True), (5, far, False)], "node long, invert double, is_stage boolean")
        assert {r["pond_id"] for r in ponds.viable(e, p, t, Ponds()).collect()} == want


def test_intake_cycles(spark):
    e = spark.createDataFrame([(10, 11), (11, 12), (20, 21)], "u long, v long")
    i = spark.createDataFrame([(12, 10), (30, 20)], "u long, v long")
    assert [tuple(r) for r in ponds.intake_cycles(i, e).collect()] == [(12, 10)]


def test_adopt_by_longest_border(spark):
    s = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, 400)], "sub_id long, outlet_id long")
    lost = s.where("sub_id in (3, 4)")
    t = spark.createDataFrame([(3, 1, 5), (3, 2, 7), (4, 3, 9)], "a long, b long, border int")
    assert {r["sub_id"]: r["outlet_id"] for r in subcatchments.adopt(s, lost, t).collect()} == {1: 100, 2: 200, 3: 200, 4: 200}


def test_edge_features(spark):
    e = spark.createDataFrame([("a", ["x", "y"], [(0.0, 1.0), (2.0, 3.0)])], "id string, highway array<string>, geometry array<struct<x:double,y:double>>")
    f = json.loads(writers.edge_features(e).first()[0])
    assert f["geometry"] == {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]} and f["properties"]["highway"] == "x,y"
    assert writers.edge_features(e).where(F.col("feature").isNull()).count() == 0
