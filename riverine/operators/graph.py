"""Iterative graph operators on node and edge tables.

Each round is one or two joins; the state (a row per node) is cut into the
shared checkpoint folder, so plans stay short.  Rounds end when a count or
checksum says that nothing changed.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .iterate import cut


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """(node, root) for edges (a, b), root the least node of the component; with nodes(node), isolated ones too.

    Least labels of the neighbours, then the label's own label (pointer
    jumping), so the number of rounds grows with the logarithm of a path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    state = both.select(F.col("a").alias("node")).distinct()
    if nodes is not None:
        state = state.unionByName(nodes.select("node")).distinct()
    state = cut(state.withColumn("root", F.col("node")))
    last = None
    for _ in range(rounds):
        # the least label next to any member goes to the member's root as well: whole trees move at once
        least = both.join(state.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy("a").agg(F.min("r").alias("r"))
        near = state.join(least.withColumnRenamed("a", "node"), "node", "left").withColumn("r", F.least("root", F.coalesce("r", "root")))
        hook = near.groupBy("root").agg(F.min("r").alias("to"))
        moved = near.join(hook, "root").select("node", F.least("r", "to").alias("root"))
        # of the labels' own labels only those of labels: few once a network is one component, so no task gets all its rows
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("up")).join(moved.select("root").distinct(), "root", "left_semi")
        state = cut(moved.join(jump, "root").select("node", F.col("up").alias("root")))
        now = state.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return state
        last = now
    raise RuntimeError("components did not settle")


def reach(edges: DataFrame, starts: DataFrame, backwards=False, rounds: int = 10_000) -> DataFrame:
    """(node, hops, source) of all nodes reachable from starts(node) along edges (u, v); ties: fewest hops, then least source."""
    e = edges.select(F.col("v" if backwards else "u").alias("node"), F.col("u" if backwards else "v").alias("next")).distinct()
    e = cut(e)
    front = cut(starts.select("node").distinct().select("node", F.lit(0).alias("hops"), F.col("node").alias("source")))
    found = front
    for hop in range(1, rounds):
        step = front.join(e, "node").groupBy("next").agg(F.min("source").alias("source")).select(F.col("next").alias("node"), F.lit(hop).alias("hops"), "source")
        front = cut(step.join(found, "node", "left_anti"))
        if not front.take(1):
            return found
        found = found.unionByName(front)
        if hop % 8 == 0:
            found = cut(found)
    raise RuntimeError("reach did not end")


def levels(succ: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, level) in a forest of (node, next): the longest way from a leaf; nodes of a cycle lack."""
    succ = cut(succ.select("node", "next"))
    every = succ.select("node").unionByName(succ.where("next is not null").select(F.col("next").alias("node"))).distinct()
    waiting = every.join(succ.where("next is not null").groupBy(F.col("next").alias("node")).count(), "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("waits"))
    waiting, parts = cut(waiting), []
    for level in range(rounds):
        ready = cut(waiting.where("waits = 0").select("node", F.lit(level).alias("level")))
        if not ready.take(1):
            break
        parts.append(ready)
        done = ready.join(succ, "node").where("next is not null").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"))
        waiting = cut(waiting.where("waits > 0").join(done, "node", "left").select("node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accumulate(succ: DataFrame, amount: str = "amount", rounds: int = 10_000) -> DataFrame:
    """(node, total): the amounts of a node and all nodes above it in a forest of (node, next, amount).

    Pointer doubling: in round k every node hands what it has gathered to the
    node 2^k steps below, so rounds grow with the logarithm of the depth.
    """
    state = cut(succ.select("node", F.col("next").alias("far"), F.col(amount).alias("total")))
    for _ in range(rounds):
        if not state.where("far is not null").take(1):
            return state.select("node", "total")
        given = state.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("total").alias("more"))
        hop = state.select(F.col("node").alias("far"), F.col("far").alias("beyond"))
        state = cut(state.join(hop, "far", "left").join(given, "node", "left").select("node", F.col("beyond").alias("far"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    raise RuntimeError("accumulation did not end")


def resolve(mapping: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, into) with a -> b -> c followed to the end, by pointer doubling."""
    state = cut(mapping.select("node", "into"))
    for _ in range(rounds):
        jump = state.select(F.col("node").alias("into"), F.col("into").alias("beyond"))
        nxt = cut(state.join(jump, "into", "left").select("node", F.coalesce("beyond", "into").alias("into"), F.col("beyond").isNotNull().alias("moved")))
        state = nxt.select("node", "into")
        if not nxt.where("moved").take(1):
            return state
    raise RuntimeError("the mapping has a cycle")


def shortest_forest(edges: DataFrame, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, dist, next, root): least total weight to any root along edges (u, v, weight) (u drains to v); unreachable nodes lack.

    Label correcting from the roots backwards: only nodes whose label fell in
    the last round offer labels in the next.  Ties: least next, then root.
    """
    e = cut(edges.groupBy("u", "v").agg(F.min("weight").alias("weight")))
    state = cut(roots.select("node").distinct().select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("next"), F.col("node").alias("root")))
    fresh = state
    for _ in range(rounds):
        offer = fresh.join(e.withColumnRenamed("v", "node"), "node").select(F.col("u").alias("who"), F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("node").alias("next"), "root").alias("label"))
        best = offer.groupBy("who").agg(F.min("label").alias("label")).select(F.col("who").alias("node"), "label.*")
        old = state.select("node", F.struct("dist", F.coalesce("next", F.lit(-1)).alias("next"), "root").alias("old"))
        better = cut(best.join(old, "node", "left").where(F.col("old").isNull() | (F.struct("dist", "next", "root") < F.col("old"))).drop("old"))
        if not better.take(1):
            return state
        state, fresh = cut(state.join(better, "node", "left_anti").unionByName(better)), better
    raise RuntimeError("labels did not settle")


#: Stands for no next node, before all ids.
_NONE = -(1 << 63) + 1


def blocks(nodes: DataFrame, size: int) -> DataFrame:
    """(node, x, y, tile): nodes (node_id, x, y) in blocks of about so many neighbours, cut from a curve that winds through the plane."""
    n = nodes.select(F.col("node_id").alias("node"), "x", "y")
    many = -(-nodes.count() // size)
    if many <= 1:
        return n.withColumn("tile", F.lit(0))
    box = n.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    grid = lambda c, lo, hi: F.least(F.greatest(F.floor((F.coalesce(F.col(c), F.lit(lo)) - lo) / max(hi - lo, 1e-9) * 65_536), F.lit(0)), F.lit(65_535)).cast("long")
    n = n.withColumn("gx", grid("x", box["a"], box["c"])).withColumn("gy", grid("y", box["b"], box["d"]))
    key = F.lit(0).cast("long")
    for bit in range(16):
        for at, c in enumerate(("gx", "gy")):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), 2 * bit + at))
    at = n.withColumn("key", key).repartitionByRange(many, "key", "node").withColumn("tile", F.spark_partition_id())
    return cut(at.select("node", "x", "y", "tile"))


def turn_forest(edges: DataFrame, nodes: DataFrame, roots: DataFrame, angle_scale: float = 0.3, block: int = 50_000, rounds: int = 10_000) -> DataFrame:
    """(node, dist, next, root) with a cost of turning at each node, which depends on the node's final next.

    Labels settle in ascending order, by a heap, within blocks of neighbouring
    nodes, one task each; a block takes the labels that nodes beyond it had in
    the last round as they are.  Blocks are solved again while such a label
    changes: a network is one block up to `block` nodes, and however large it
    is, no task sees more.  Ties: distance, then node, next and root.
    """
    at = blocks(nodes, block)
    end = lambda c: at.withColumnsRenamed({"node": c, "x": f"{c}x", "y": f"{c}y", "tile": f"{c}t"})
    arcs = cut(edges.groupBy("u", "v").agg(F.min("weight").alias("weight")).join(end("u"), "u").join(end("v"), "v"))
    starts = roots.select("node").distinct().join(at, "node").select(F.col("node").alias("u"), F.lit(_NONE).alias("v"), F.lit(0.0).alias("weight"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("tile").alias("ut"), *[F.lit(None).cast("double").alias(c) for c in ("vx", "vy")], F.col("tile").alias("vt"))
    rows = cut(arcs.select("u", "v", "weight", "ux", "uy", "ut", "vx", "vy", "vt").unionByName(starts)).withColumnRenamed("ut", "tile")
    over = cut(arcs.where("ut <> vt").select(F.col("ut").alias("tile"), F.col("v").alias("node")).distinct())
    kinds = "tile int, node long, dist double, next long, root long, nx double, ny double"

    def solve(key, inside: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        found = settle(inside, beyond, angle_scale)
        out = pd.DataFrame([(key[0], *x) for x in found], columns=["tile", "node", "dist", "next", "root", "nx", "ny"])
        return out.astype({"nx": "float64", "ny": "float64"})

    empty = edges.sparkSession.createDataFrame([], kinds)
    state, active = empty, None
    for _ in range(rounds):
        some = rows if active is None else rows.join(active, "tile", "left_semi")
        known = over.join(state.drop("tile"), "node")
        known = known if active is None else known.join(active, "tile", "left_semi")
        solved = cut(some.groupBy("tile").cogroup(known.groupBy("tile")).applyInPandas(solve, kinds))
        kept = empty if active is None else state.join(active, "tile", "left_anti")
        was = state.select("node", F.struct("dist", "next", "root").alias("was"))
        rim = over.select("node").distinct()
        changed = rim.join(solved, "node").join(was, "node", "left").where(~F.col("was").eqNullSafe(F.struct("dist", "next", "root"))).select("node")
        gone = rim.join(was, "node").join(solved.select("node"), "node", "left_anti") if active is None else rim.join(state.join(active, "tile", "left_semi"), "node").join(solved.select("node"), "node", "left_anti")
        active = cut(over.join(changed.unionByName(gone.select("node")), "node").select("tile").distinct())
        state = cut(kept.unionByName(solved))
        if not active.take(1):
            return state.select("node", "dist", F.when(F.col("next") != _NONE, F.col("next")).alias("next"), "root")
    raise RuntimeError("labels did not settle")


def _bend(xy, a, b, c) -> float:
    """Cost of turning at b on the way from a to c."""
    import math

    ux, uy, wx, wy = xy[a][0] - xy[b][0], xy[a][1] - xy[b][1], xy[c][0] - xy[b][0], xy[c][1] - xy[b][1]
    m = math.hypot(ux, uy) * math.hypot(wx, wy)
    if m == 0:
        return 0.0
    t = math.degrees(math.acos(max(-1.0, min(1.0, (ux * wx + uy * wy) / m))))
    return 1.0 if t < 30 else 0.8 * abs(90 - t) / 60 + 0.2 if t < 135 else 0.4 * (180 - t) / 90


def settle(inside: pd.DataFrame, beyond: pd.DataFrame, angle_scale: float) -> list[tuple]:
    """(node, dist, next, root, x and y of next) of a block's nodes; beyond: labels of nodes outside, which are taken as they are.

    inside has an arc (u, v, weight, ends' places) a row, and one without v for each root; no next is _NONE, so that ids stay whole numbers.
    """
    xy, into, heap = {}, {}, []
    for u, v, weight, ux, uy, vx, vy in zip(*[inside[c].tolist() for c in ("u", "v", "weight", "ux", "uy", "vx", "vy")], strict=True):
        xy[u] = (ux, uy)
        if v == _NONE:
            heap.append((0.0, u, _NONE, u))
        else:
            xy[v] = (vx, vy)
            into.setdefault(v, []).append((u, weight))

    def offer(node, dist, nxt, root, done):
        for up, weight in into.get(node, ()):
            if up not in done:
                bend = 0.0 if nxt == _NONE else angle_scale * _bend(xy, up, node, nxt)
                heapq.heappush(heap, (dist + weight + bend, up, node, root))

    done: dict = {}
    heapq.heapify(heap)
    for node, dist, nxt, root, nx, ny in zip(*[beyond[c].tolist() for c in ("node", "dist", "next", "root", "nx", "ny")], strict=True):
        if nxt != _NONE:
            xy.setdefault(nxt, (nx, ny))
        offer(node, dist, nxt, root, done)
    while heap:
        dist, node, nxt, root = heapq.heappop(heap)
        if node not in done:
            done[node] = (dist, nxt, root)
            offer(node, dist, nxt, root, done)
    out = []
    for node, (dist, nxt, root) in sorted(done.items()):
        out.append((node, dist, nxt, root, *xy.get(nxt, (None, None))))
    return out


def _kruskal(batches):
    """Edges of one task that its own spanning forest keeps; ascending by (weight, a, b)."""
    rows = pd.concat(list(batches) or [pd.DataFrame({"a": [], "b": [], "weight": []})])
    rows = rows.sort_values(["weight", "a", "b"], kind="stable")
    up: dict = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    keep = []
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        ra, rb = top(a), top(b)
        keep.append(ra != rb)
        up[max(ra, rb)] = min(ra, rb)
    yield rows[pd.Series(keep, index=rows.index, dtype=bool)] if len(rows) else rows


def spanning_forest(edges: DataFrame, rounds: int = 64, one_task: int = 1_000_000) -> DataFrame:
    """Edges (a, b, weight) of a minimum spanning forest; ties by (weight, a, b).

    What a task's own spanning forest drops can't be in the whole one, so each
    task filters its edges first; a checked count of at most `one_task` edges
    is finished in one task, more by Boruvka rounds.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    edges = cut(edges.mapInPandas(_kruskal, edges.schema))
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInPandas(_kruskal, edges.schema)
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    e = cut(e)
    names = cut(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("part")))
    kept = None
    for _ in range(rounds):
        apart = e.join(names.withColumnsRenamed({"node": "a", "part": "pa"}), "a").join(names.withColumnsRenamed({"node": "b", "part": "pb"}), "b").where("pa <> pb")
        best = apart.select(F.explode(F.array("pa", "pb")).alias("part"), F.struct("weight", "a", "b", "pa", "pb").alias("e")).groupBy("part").agg(F.min("e").alias("e"))
        best = cut(best.select("e.*").distinct())
        if not best.take(1):
            return kept if kept is not None else e.limit(0)
        kept = best.select("a", "b", "weight") if kept is None else cut(kept.unionByName(best.select("a", "b", "weight")))
        merged = components(best.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        names = cut(names.join(merged.withColumnsRenamed({"node": "part", "root": "to"}), "part", "left").select("node", F.coalesce("to", "part").alias("part")))
    raise RuntimeError("the forest did not settle")


def steepest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, next): each node's lowest neighbour that lies lower (ties: least id), else null."""
    z = nodes.select("node_id", F.col("surface_elevation").alias("z"))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    down = both.join(z.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(z.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v").where("zv < zu")
    best = down.groupBy("u").agg(F.min(F.struct("zv", "v")).alias("m"))
    return nodes.select("node_id").join(best, nodes.node_id == best.u, "left").select(F.col("node_id").alias("node"), F.col("m.v").alias("next"))


def degrees(edges: DataFrame, types=("pipe",)) -> DataFrame:
    """(node, n_in, n_out, pipe_in, pipe_out) over both ends."""
    pipe = F.col("edge_type").isin(*types).cast("int")
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), pipe.alias("p")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), pipe.alias("p")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum(F.col("i") * F.col("p")).alias("pipe_in"), F.sum(F.col("o") * F.col("p")).alias("pipe_out"))


def chains(succ: DataFrame) -> DataFrame:
    """(node, end, pos): interior nodes of maximal chains in a forest of (node, next): one above, one below.

    end is the first node below that is no interior node, pos the number of
    steps to it; found by pointer doubling.
    """
    above = succ.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("n"))
    inner = cut(succ.join(above, "node").where("n = 1 and next is not null").select("node", "next"))
    state = cut(inner.select("node", F.col("next").alias("end"), F.lit(1).cast("long").alias("pos")))
    while True:
        hop = state.select(F.col("node").alias("end"), F.col("end").alias("beyond"), F.col("pos").alias("more"))
        nxt = cut(state.join(hop, "end", "left").select("node", F.coalesce("beyond", "end").alias("end"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.col("beyond").isNotNull().alias("moved")))
        if not nxt.where("moved").take(1):
            return nxt.select("node", "end", "pos")
        state = nxt.drop("moved")


def numbered(df: DataFrame, *by, order) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def reach_max(succ: DataFrame) -> DataFrame:
    """(node, most): the greatest amount of a node and all above it in a forest of (node, next, amount), by pointer doubling."""
    state = cut(succ.select("node", F.col("next").alias("far"), F.col("amount").alias("most")))
    while state.where("far is not null").take(1):
        given = state.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.max("most").alias("more"))
        hop = state.select(F.col("node").alias("far"), F.col("far").alias("beyond"))
        state = cut(state.join(hop, "far", "left").join(given, "node", "left").select("node", F.col("beyond").alias("far"), F.greatest("most", F.coalesce("more", "most")).alias("most")))
    return state.select("node", "most")


def longest_path(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, far) along the heaviest way through an acyclic graph (u, v, weight); ties: smaller ids.

    Labels grow until none does: a node's is the greatest weight of a way to
    it; then the way is followed back from the best end.
    """
    e = cut(edges.groupBy("u", "v").agg(F.max("weight").alias("weight")))
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = cut(nodes.select("node", F.lit(0.0).alias("far"), F.lit(None).cast("long").alias("prev")))
    for _ in range(rounds):
        offer = state.join(e.withColumnRenamed("u", "node"), "node").groupBy(F.col("v").alias("at")).agg(F.min(F.struct((-(F.col("far") + F.col("weight"))).alias("n"), "node")).alias("m"))
        nxt = state.join(offer.select(F.col("at").alias("node"), "m"), "node", "left")
        grown = F.coalesce(-F.col("m.n") > F.col("far"), F.lit(False))
        moved = grown | (F.col("m.n").isNotNull() & (-F.col("m.n") == F.col("far")) & (F.col("far") > 0) & ~F.col("m.node").eqNullSafe(F.col("prev")))
        nxt = cut(nxt.select("node", F.when(moved, -F.col("m.n")).otherwise(F.col("far")).alias("far"), F.when(moved, F.col("m.node")).otherwise(F.col("prev")).alias("prev"), moved.alias("moved")))
        state = nxt.drop("moved")
        if not nxt.where("moved").take(1):
            break
    else:
        raise RuntimeError("the longest path did not settle: is there a cycle?")
    end = state.agg(F.min(F.struct((-F.col("far")).alias("n"), "node")).alias("m")).select(F.col("m.node").alias("node"))
    back = state.where("prev is not null").select(F.col("node").alias("u"), F.col("prev").alias("v"))
    return reach(back, end).select("node").join(state, "node").select("node", "far")
