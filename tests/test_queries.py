"""Every drainage query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from riverine.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 4) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    theirs = plain(got.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - float(y)) < 2e-4), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_trunk_inference_takes_the_whole_network(spark):
    from pyspark.sql import functions as F

    from riverine.operators import graph
    from riverine.sources import fixtures as fx

    e = fx.edges(spark, DATA).where("highway = 'primary'")
    n = {r["node_id"]: r["surface_elevation"] for r in fx.nodes(spark, DATA).collect()}
    part = {r["node"]: r["root"] for r in graph.components(e.select(F.col("u").alias("a"), F.col("v").alias("b"))).collect()}
    low = {}
    for i, r in part.items():
        low[r] = min(low.get(r, (math.inf, 0)), (n[i], i))
    place = lambda i: (i % 40 * 50, i // 40 * 50)
    joined, want = {min((n[i], r) for i, r in part.items())[1]}, []
    while near := [m for r, (_, a) in low.items() if r not in joined for b, p in part.items() if p in joined and (m := (math.dist(place(a), place(b)), a, b))[0] <= 300]:
        d, a, b = min(near)
        joined.add(part[a])
        want.append((a, b, d) if n[a] >= n[b] else (b, a, d))
    assert len(part) == e.select(F.explode(F.array("u", "v")).alias("node")).distinct().count()
    assert sorted(tuple(r) for r in QUERIES["trunk_inference"](spark, DATA).collect()) == sorted(want) and len(want) > 1


def test_bfs_whole_is_brute_force(spark):
    from riverine.sources import fixtures as fx

    next_to = {}
    for r in fx.edges(spark, DATA).collect():
        next_to.setdefault(r["u"], set()).add(r["v"])
        next_to.setdefault(r["v"], set()).add(r["u"])
    best = {}
    for start in [r["node_id"] for r in fx.nodes(spark, DATA).collect() if r["node_id"] % 211 == 5]:
        seen, front, hops = set(), {start}, 0
        while front:
            for i in front:
                best[i] = min(best.get(i, (math.inf, 0)), (hops, start))
            seen |= front
            front, hops = {b for i in front for b in next_to.get(i, ())} - seen, hops + 1
    got = {r["node"]: (r["hops"], r["source"]) for r in QUERIES["bfs_sink_partition"](spark, DATA).collect()}
    assert got == best and set(got) == set(next_to)


def test_regions_whole_is_brute_force(spark):
    from riverine.sources import fixtures as fx

    cells = {(r["row_"], r["col_"]): int(math.floor(r["value"] or 0)) % 3 for r in fx.dem(spark, DATA).collect()}
    part = {}
    for start in sorted(cells):  # the least cell of a part is met first
        front = [start] if start not in part else []
        while front:
            r, c = front.pop()
            if (r, c) not in part:
                part[r, c] = start[0] * 1_000_000_000 + start[1]
                front += [b for b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if cells.get(b) == cells[r, c]]
    got = {(r["row_"], r["col_"]): (r["id"], r["part"]) for r in QUERIES["raster_regions"](spark, DATA).collect()}
    assert got == {k: (cells[k], part[k]) for k in cells} and len(got) > 168


def test_whole_queries_take_all_rows(spark):
    from riverine.sources import fixtures as fx

    rows = lambda name, *c: sorted(tuple(r[x] for x in c) for r in QUERIES[name](spark, DATA).collect())
    nodes, ponds, edges = (sorted(f(spark, DATA).collect()) for f in (fx.nodes, fx.ponds, fx.edges))
    z = {n["node_id"]: n["surface_elevation"] for n in nodes}
    assert rows("weir_units", "node_id", "us") == [(n["node_id"], 3.0) for n in nodes]
    slopes = {(r["u"], r["v"]): (r["length"], r["sink_invert"]) for r in QUERIES["outfall_slope"](spark, DATA).collect()}
    assert len(slopes) == len(edges)
    for e in edges:
        up, down = z[e["u"]], z[e["v"]]
        want = ((up - down) / 0.05 if (up - down) / 5 > 0.05 else 5.0, down if up > down else up - 0.005)
        assert slopes[e["u"], e["v"]] == pytest.approx(want, abs=1e-5)
    far = lambda a, b: math.dist((a["x"], a["y"]), (b["x"], b["y"]))
    anchors = {}
    for p in ponds:
        near = [(far(p, n), n["node_id"]) for n in nodes if far(p, n) <= 200 and n["surface_elevation"] - 3 + 0.001 * far(p, n) < 12]
        if near:
            anchors[p["pond_id"]] = min(near)[1]
    assert rows("drainable_anchor", "pond_id", "node_id") == sorted(anchors.items()) and anchors
    lines = [r["x"] for r in fx.rivers(spark, DATA).collect()]
    apart = lambda a, b: any(min(a["x"], b["x"]) < x < max(a["x"], b["x"]) for x in lines)
    want = sorted((a["node_id"], b["node_id"]) for a in nodes for b in nodes if a is not b and far(a, b) <= 120 and not apart(a, b))
    assert rows("bridge_candidates", "a", "b") == want and want
    subs = [r["sub_id"] for r in QUERIES["pond_capacity_fill"](spark, DATA).collect()]
    assert any(i % 2 for i in subs) and set(subs) <= set(z)
