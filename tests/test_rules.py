"""Rules of outfalls, ponds, simplification and subcatchments: brute force and anchors."""

import random

import pytest
from pyspark.sql import functions as F

from riverine.network import Network
from riverine.operators import graph, outfalls, ponds, raster, simplify, subcatchments
from riverine.operators.iterate import cut, scratch
from riverine.params import Outfalls, Ponds, Simplification
from riverine.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def slow_dangling(succ, area, keep, least):
    """Round by round: every leaf whose chain down to a kept or branching node has less than `least` goes with it."""
    nxt, area, gone = dict(succ), dict(area), {}
    while True:
        above = {}
        for a, b in nxt.items():
            if b is not None:
                above[b] = above.get(b, 0) + 1
        inner = lambda n: above.get(n, 0) == 1 and n not in keep and nxt[n] is not None
        out = {}
        for leaf in nxt:
            if above.get(leaf, 0) or leaf in keep or nxt[leaf] is None:
                continue
            chain, at = [leaf], nxt[leaf]
            while inner(at):
                chain.append(at)
                at = nxt[at]
            if sum(area[n] for n in chain) < least:
                out |= {n: at for n in chain}
        if not out:
            break
        for n, end in out.items():
            area[end] = area.get(end, 0) + area[n]
        for n in out:
            del nxt[n]
        gone |= out
    end = lambda n: end(gone[n]) if n in gone else n
    return {n: end(n) for n in gone}


@pytest.mark.parametrize("seed", [1, 2])
def test_dangling_leaves_by_rounds(spark, seed):
    rng = random.Random(seed)
    succ = {0: None} | {i: rng.randrange(max(0, i - 4), i) for i in range(1, 60)}
    area = {i: float(rng.randint(0, 9)) for i in succ}
    keep = {i for i in succ if i % 13 == 5}
    got = simplify.dangling(
        spark.createDataFrame(list(succ.items()), "node long, next long"), spark.createDataFrame(list(area.items()), "node long, area double"), spark.createDataFrame([(k,) for k in keep], "node long"), 12.0
    )
    assert {r["node_id"]: r["into"] for r in got.collect()} == slow_dangling(succ, area, keep, 12.0)


def test_the_query_on_dangling_leaves_is_the_brute_force(spark):
    from riverine.queries.graphs import succ
    from riverine.sources import fixtures as fx

    n = {r["node_id"]: r["contributing_area"] for r in fx.nodes(spark, DATA).collect()}
    down = {r["node"]: r["next"] for r in succ(spark, DATA).collect()}
    want = slow_dangling(down, n, {i for i in n if i % 50 == 0}, 1500)
    assert {r["node_id"]: r["into"] for r in QUERIES["dangling_removed"](spark, DATA).collect()} == want and want


def box(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def test_footprints_match_up_to_the_limit(spark):
    """A storage 5 m off its basin has it, one 5.001 m off hasn't; no limit, no match."""
    basins = spark.createDataFrame([(1, box(0.0, 0.0, 10.0)), (2, box(200.0, 0.0, 10.0))], "basin_id long, ring array<struct<x:double,y:double>>")
    storages = spark.createDataFrame([(11, 15.0, 0.0, 500.0), (12, 215.001, 0.0, 500.0), (13, 0.0, 3.0, 500.0)], "pond_id long, x double, y double, area_m2 double")
    got = lambda p: {r["pond_id"] for r in outfalls.storage_basins(storages, basins, p).collect()}
    assert got(Outfalls()) == {11, 13} and got(Outfalls(pond_intake_min_area_m2=501)) == set() and got(Outfalls(pond_footprint_match_m=0)) == set()


def street(spark, spacing, far):
    """Six street nodes in a row, a river parallel to them."""
    nodes = spark.createDataFrame([(i, i * spacing, 20.0, 10.0 + i) for i in range(6)], "node_id long, x double, y double, surface_elevation double").withColumn("node_type", F.lit(None).cast("string"))
    edges = spark.createDataFrame([(i, i + 1, "pipe", spacing) for i in range(5)], "u long, v long, edge_type string, length double")
    rivers = spark.createDataFrame([(1, -100.0, 20.0 - far, 6 * spacing + 100.0, 20.0 - far)], "river_id long, x0 double, y0 double, x1 double, y1 double")
    return nodes, edges, rivers


@pytest.mark.parametrize("spacing", [20.0, 50.0, 200.0])
def test_one_outfall_a_cluster_at_any_scale(spark, spacing):
    n, e, r = street(spark, spacing, 15.0)
    for factor, many in ((1.5, 1), (0.5, 6)):
        sinks, links = outfalls.identify(n, e, r, Outfalls(outfall_clustering_factor=factor))
        assert links.count() == many == sinks.where("node_type = 'river_outfall' and y = 5").count()
        assert all(x["length"] == pytest.approx(15.0) and x["weight"] == factor * spacing for x in links.collect())


def test_far_streets_get_a_dummy_at_the_lowest(spark):
    n, e, r = street(spark, 50.0, 200.0)
    sinks, links = outfalls.identify(n, e, r, Outfalls())
    assert [(x["u"], x["length"]) for x in links.collect()] == [(0, 50.0)]
    assert [(x["node_type"], x["x"], x["y"]) for x in sinks.collect()] == [("dummy_river", 1.0, 21.0)]


def test_streets_below_the_water_are_no_candidates(spark):
    n, e, r = street(spark, 50.0, 15.0)
    cells = spark.createDataFrame([(0, c, 12.5) for c in range(6)], "row_ long, col_ long, value double")
    pairs = outfalls.pair_receiving(n, r, None, Outfalls(), cells, 50.0)
    assert sorted(x["node_id"] for x in pairs.collect()) == [3, 4, 5]


def test_ponds_that_reach_only_high_ends_are_not_viable(spark):
    e = spark.createDataFrame([(1, 2, 10.0), (2, 3, 10.0)], "u long, v long, length double")
    pond = spark.createDataFrame([(1, 5.0)], "pond_id long, head double")
    fine = lambda z, stage: ponds.viable(e, pond, spark.createDataFrame([(3, z, stage)], "node long, invert double, is_stage boolean"), Ponds()).count()
    assert (fine(4.7, False), fine(2.5, False), fine(4.7, True), fine(4.95, True)) == (0, 1, 1, 0)


def test_unlimited_ponds_take_all(spark):
    rows = [(1, 0.0, i, float(i), 1000.0) for i in range(5)] + [(2, 2500.0, 10 + i, float(i), 1000.0) for i in range(5)]
    offers = spark.createDataFrame(rows, "pond_id long, capacity double, sub_id long, distance double, area double")
    took = lambda o: sorted((r["pond_id"], r["sub_id"]) for r in ponds.capacity_fill(o).collect())
    assert took(offers) == [(1, i) for i in range(5)] + [(2, 10), (2, 11)]
    assert took(offers.withColumn("captured", F.lit(1000.0))) == [(1, i) for i in range(5)] + [(2, 10)]


def chain(spark, lengths, kinds=None):
    """0 -> 1 -> ... with a branch into the first and the last node, so that both are kept."""
    k = len(lengths)
    nodes = spark.createDataFrame([(i, None, 10.0) for i in range(k + 3)], "node_id long, node_type string, contributing_area double")
    row = lambda u, v, n: (u, v, f"{u}-{v}", "pipe", n, 0.3, 0.01, 1.0, 0.0, 0.0)
    rows = [row(i, i + 1, n) for i, n in enumerate(lengths)] + [row(k + 1, 0, 5.0), row(k + 2, 0, 5.0)]
    edges = spark.createDataFrame(rows, "u long, v long, id string, edge_type string, length double, diameter double, roughness double, contributing_area double, in_offset double, out_offset double")
    return Network(nodes, edges)


def test_chains_are_merged_and_cut_again(spark):
    n = simplify.network(chain(spark, [40.0, 30.0, 30.0]), Simplification(enabled=True))
    assert {(r["u"], r["v"], r["length"]) for r in n.edges.collect()} == {(0, 3, 100.0), (4, 0, 5.0), (5, 0, 5.0)}
    assert {r["node_id"]: r["contributing_area"] for r in n.nodes.collect()} == {0: 10.0, 3: 30.0, 4: 10.0, 5: 10.0}
    n = simplify.network(chain(spark, [40.0, 30.0, 30.0]), Simplification(enabled=True, max_conduit_length=60))
    assert {(r["u"], r["v"], r["length"]) for r in n.edges.where("v > 0").collect()} == {(0, 2, 70.0), (2, 3, 30.0)}
    same = chain(spark, [40.0, 30.0])
    assert simplify.network(same, Simplification()) is same


def test_rings_without_an_end_stay(spark):
    row = lambda u, v: (u, v, f"{u}-{v}", "pipe", 10.0, 0.3, 0.01, 1.0, 0.0, 0.0)
    edges = spark.createDataFrame([row(0, 1), row(1, 2), row(2, 0)], "u long, v long, id string, edge_type string, length double, diameter double, roughness double, contributing_area double, in_offset double, out_offset double")
    nodes = spark.createDataFrame([(i,) for i in range(3)], "node long")
    out, gone = simplify.consolidate(nodes, edges, nodes.where("false"), 500)
    assert out.count() == 3 and gone.count() == 0


def test_subcatchments_share_out_the_grid(spark):
    """Every cell belongs to one subcatchment, each is in one piece, and areas add up; no pour point on the grid raises."""
    rng = random.Random(3)
    cells = spark.createDataFrame([(r, c, 20.0 - r - 0.3 * c + rng.random()) for r in range(14) for c in range(12)], "row_ long, col_ long, value double")
    nodes = spark.createDataFrame([(i, rng.uniform(0, 120), rng.uniform(0, 140)) for i in range(9)] + [(50, 61.0, 61.0), (51, 62.0, 62.0)], "node_id long, x double, y double")
    pointer = cut(raster.d8(cells))
    subs, labels = subcatchments.derive(pointer, nodes, raster.slope_pct(cells, 10).withColumnRenamed("slope", "value"), 10.0)
    assert labels.select("row_", "col_").distinct().count() == labels.count() == 14 * 12
    assert subs.agg(F.sum("area")).first()[0] == 14 * 12 * 100 and {r["sub_id"] for r in subs.collect()} <= {r["node_id"] for r in nodes.collect()}
    assert raster.regions(labels).groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        subcatchments.derive(pointer, nodes.withColumn("x", F.lit(-1e6)), cells, 10.0)


def test_islands_take_the_nearest_id(spark):
    rows = [(0, c, 1) for c in range(4)] + [(0, 9, 1), (0, 7, 2), (1, 7, 2), (5, 5, 2)]
    got = {(r["row_"], r["col_"]): r["id"] for r in raster.rehome(spark.createDataFrame(rows, "row_ long, col_ long, id long")).collect()}
    assert got[0, 0] == 1 and got[0, 7] == 2 and got[0, 9] == 2 and got[5, 5] == 2


def test_many_rounds_keep_plans_small(spark):
    """Estimated sizes and files of earlier rounds don't pile up."""
    a = cut(spark.range(10).selectExpr("id", "id as v"))
    for _ in range(30):
        a = cut(a.join(a.selectExpr("id", "v as w"), "id").selectExpr("id", "v + w % 2 as v"))
    assert a._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64 and a.count() == 10
    assert scratch(spark, "x") != scratch(spark, "x")


@pytest.mark.parametrize("block", [6, 15])
def test_pipes_by_blocks(spark, block):
    """One large component, cut into blocks that are sized again while the pipes at their rim change."""
    from riverine.operators import design
    from riverine.params import Hydraulics

    rng = random.Random(5)
    nodes = [(i, 40.0 * (i % 7), 40.0 * (i // 7), 10.0 + 0.4 * i + rng.random(), 4000.0 * rng.random()) for i in range(49)]
    edges = [(i, rng.choice([j for j in (i - 1, i - 7) if j >= 0 and (i - j == 7 or i % 7)]), 40.0) for i in range(1, 49)]
    n = spark.createDataFrame(nodes, "node_id long, x double, y double, surface_elevation double, contributing_area double")
    e = spark.createDataFrame(edges, "u long, v long, length double")
    rows = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    whole = rows(design.pipe_by_pipe(e, n, Hydraulics()))
    assert rows(design.pipe_by_pipe(e, n, Hydraulics(), block=block)) == whole and len(whole) == 48


def test_longest_paths_refuse_rings(spark):
    with pytest.raises(RuntimeError):
        graph.longest_path(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "u long, v long, weight double"), rounds=5)
