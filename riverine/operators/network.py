"""Cleaning steps on the street graph: filters, ids, direction, splitting, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..network import Network
from .graph import components

MAJOR = "motorway|trunk|primary|secondary"
#: Types whose removal keeps both endpoints, or removes just the named one.
KEEPS_BOTH, DROPS_V = ("street_channel",), ("outfall",)


def without_highways(edges: DataFrame, omit=("corridor", "track", "footway", "path")) -> DataFrame:
    """Edges of unwanted highway kinds go; those without a kind stay."""
    return edges.where(~F.coalesce(F.col("highway").isin(*omit), F.lit(False)))


def major(highway: Column) -> Column:
    return F.coalesce(highway.rlike(MAJOR), F.lit(False))


def clip(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return nodes.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def keep_types(network: Network, types: list[str]) -> Network:
    """Edges of other types go, and with them their nodes: both ends, but only v of an outfall, only the pond (u) of a
    pond_connector and none of a street_channel; all edges at a dropped node go too, then nodes without an edge."""
    gone = network.edges.where(~F.col("edge_type").isin(*types))
    dropped = gone.select(
        F.explode(
            F.when(F.col("edge_type").isin(*KEEPS_BOTH), F.array().cast("array<bigint>"))
            .when(F.col("edge_type").isin(*DROPS_V), F.array("v"))
            .when(F.col("edge_type") == "pond_connector", F.array("u"))
            .otherwise(F.array("u", "v"))
        ).alias("node_id")
    ).distinct()
    edges = network.edges.where(F.col("edge_type").isin(*types))
    for end in ("u", "v"):
        edges = edges.join(dropped.withColumnRenamed("node_id", end), end, "left_anti")
    return network.with_edges(edges).with_nodes(network.nodes.join(dropped, "node_id", "left_anti")).drop_isolated()


def assign_ids(edges: DataFrame) -> DataFrame:
    """id: the edge's own if unique, else u-v, else u-v-type; of edges that still collide the first by key stays."""
    plain = F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))
    # edges without an id, often all of them, are kept out of the join by id
    named, bare = edges.where("id is not null"), edges.where("id is null")
    more = named.groupBy("id").agg(F.count("*").alias("uses"))
    named = named.join(more, "id").withColumn("id", F.when(F.col("uses") == 1, F.col("id"))).select(*edges.columns)
    out = named.unionByName(bare).withColumn("plain", plain)
    first = Window.partitionBy("plain", F.col("id").isNull()).orderBy("edge_type", "key")
    out = out.withColumn("n", F.row_number().over(first)).withColumn("id", F.coalesce("id", F.when(F.col("n") == 1, F.col("plain")).otherwise(F.concat_ws("-", "plain", "edge_type"))))
    last = Window.partitionBy("id").orderBy("n", "u", "v", "key")
    return out.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "plain")


def parallel_keys(edges: DataFrame, order: str = "id") -> DataFrame:
    """key: the number of an edge among those from u to v."""
    return edges.withColumn("key", (F.row_number().over(Window.partitionBy("u", "v").orderBy(order)) - 1).cast("int"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of ends once, smaller id first; of parallels the one of least id."""
    pair = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "id", "length")
    return pair.groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("length", "id").alias("length")).withColumnsRenamed({"a": "u", "b": "v"})


def double_directed(edges: DataFrame) -> DataFrame:
    """Each pipe in both directions, the way back under the id v-u with its geometry reversed."""
    back = {"u": F.col("v"), "v": F.col("u"), "id": F.concat_ws("-", F.col("v").cast("string"), F.col("u").cast("string"))}
    if "geometry" in edges.columns:
        back["geometry"] = geo.reverse(F.col("geometry"))
    return edges.unionByName(edges.select(*[back.get(c, F.col(c)).alias(c) for c in edges.columns]))


def orient_downhill(edges: DataFrame, elevation: DataFrame) -> DataFrame:
    """Rivers once each, from the higher end to the lower; ties keep their direction."""
    z = elevation.select("node_id", F.col("surface_elevation").alias("z"))
    out = edges.join(z.withColumnsRenamed({"node_id": "u", "z": "zu"}), "u").join(z.withColumnsRenamed({"node_id": "v", "z": "zv"}), "v")
    turn = F.col("zv") > F.col("zu")
    named = {"u": F.when(turn, F.col("v")).otherwise(F.col("u")), "v": F.when(turn, F.col("u")).otherwise(F.col("v"))}
    if "geometry" in edges.columns:
        named["geometry"] = F.when(turn, geo.reverse(F.col("geometry"))).otherwise(F.col("geometry"))
    return out.select(*[named.get(c, F.col(c)).alias(c) for c in edges.columns])


def fix_geometry(edges: DataFrame) -> DataFrame:
    """Needs ux, uy, vx, vy: a line that runs backwards is reversed, one that misses its ends becomes the chord."""
    a, b = F.element_at("geometry", 1), F.element_at("geometry", -1)
    u, v = geo.point("ux", "uy"), geo.point("vx", "vy")
    return edges.withColumn("geometry", F.when((a == u) & (b == v), F.col("geometry")).when((a == v) & (b == u), geo.reverse(F.col("geometry"))).otherwise(F.array(u, v)))


def split_long(edges: DataFrame, longest: float = 60, shortest: float = 1) -> DataFrame:
    """One row per piece (id, part, ax, ay, bx, by, length) of lines cut into segments of at most `longest`."""
    # pieces of a line of two points are longer than half of `longest`; if none can be too short, they come without lambdas
    g, two = F.col("geometry"), F.coalesce(F.size("geometry") == 2, F.lit(False)) & F.lit(longest > 2.01 * shortest)
    bent = F.when(~two, geo.segments(geo.collapse(geo.segmentize(g, longest), shortest)))
    l = edges.select("id", two.alias("two"), bent.alias("bent"), *[F.get(g, i)[c].alias(f"{c}{i}") for i in (0, 1) for c in ("x", "y")])
    count = F.greatest(F.ceil(geo.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) / longest), F.lit(1))
    l = l.withColumn("n", F.when(F.col("two"), count).otherwise(F.size("bent")).cast("int"))
    l = l.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, i: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * i / F.col("n")
    start = lambda c: F.when(F.col("part") == 0, F.col(f"{c}0")).otherwise(at(c, F.col("part")))
    ends = {"ax": start("x"), "ay": start("y"), "bx": at("x", F.col("part") + 1), "by": at("y", F.col("part") + 1)}
    pieces = l.select("id", "part", *[F.when(F.col("two"), e).otherwise(F.get("bent", F.col("part"))[c]).alias(c) for c, e in ends.items()])
    return pieces.withColumn("length", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where("length > 0").dropDuplicates(["ax", "ay", "bx", "by"])


def short_clusters(edges: DataFrame, nodes: DataFrame, shortest: float = 5, widest: float = 15) -> DataFrame:
    """(node_id, into): ends of edges shorter than `shortest` are merged into the best connected node of their cluster
    (ties: least id), unless the cluster is wider than `widest`."""
    xy = nodes.select("node_id", "x", "y")
    near = (
        edges.join(xy.withColumnsRenamed({"node_id": "u", "x": "ux", "y": "uy"}), "u")
        .join(xy.withColumnsRenamed({"node_id": "v", "x": "vx", "y": "vy"}), "v")
        .where(geo.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")) < shortest)
    )
    part = components(near.select(F.col("u").alias("a"), F.col("v").alias("b")))
    degree = edges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    members = part.withColumnRenamed("node", "node_id").join(degree, "node_id").join(xy, "node_id")
    # the widest pair of a cluster lies within its box, whose diagonal bounds it; exact where the box is not within the limit
    box = members.groupBy("root").agg(F.max_by("node_id", F.struct("degree", -F.col("node_id"))).alias("into"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    unsure = box.where((F.hypot("w", "h") > widest) & (F.greatest("w", "h") <= widest)).select("root")
    some = members.join(unsure, "root", "left_semi").select("root", "x", "y")
    wide = some.join(some.withColumnsRenamed({"x": "x2", "y": "y2"}), "root").where(geo.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) > widest).select("root").distinct()
    fine = box.where(F.greatest("w", "h") <= widest).join(wide, "root", "left_anti")
    return members.join(fine, "root").select("node_id", "into")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends renamed by (node_id, into); loops go."""
    for end in ("u", "v"):
        edges = edges.join(mapping.withColumnsRenamed({"node_id": end, "into": "new"}), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return edges.where("u <> v")


def split_kinds(edges: DataFrame) -> dict[str, DataFrame]:
    """What isn't a street: rivers, outfalls and pond connectors, each a table."""
    return {k: edges.where(F.col("edge_type") == k) for k in ("river", "outfall", "pond_connector")}


def end_points(edges: DataFrame) -> DataFrame:
    """(node_id, kinds): the sorted edge types at each node."""
    return edges.select(F.explode(F.array("u", "v")).alias("node_id"), "edge_type").groupBy("node_id").agg(F.array_sort(F.collect_set("edge_type")).alias("kinds"))


def union_later(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, of equal keys those of the later one."""
    return first.join(later.select(key), key, "left_anti").unionByName(later, allowMissingColumns=True)


def noded(lines: DataFrame, size: float = 100, digits: int = 3) -> DataFrame:
    """(ax, ay, bx, by): the segments (id, ax, ay, bx, by) cut where others cross or touch them, each piece once, smaller end first."""
    from .spatial import line_tiles

    t = line_tiles(lines, "ax", "ay", "bx", "by", size)
    o = t.select(*[F.col(c).alias(f"o{c}") for c in ("id", "ax", "ay", "bx", "by")], "i", "j")
    pairs = t.join(o, ["i", "j"]).where("id <> oid").dropDuplicates(["id", "oid"])
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    den = dx * ey - dy * ex
    cross = lambda px, py, qx, qy: (F.col("oax") - F.col("ax")) * qy - (F.col("oay") - F.col("ay")) * qx
    s, r = cross(0, 0, ex, ey) / F.nullif(den, F.lit(0.0)), cross(0, 0, dx, dy) / F.nullif(den, F.lit(0.0))
    cuts = pairs.withColumn("s", s).withColumn("r", r).where("s > 1e-9 and s < 1 - 1e-9 and r > -1e-9 and r < 1 + 1e-9").groupBy("id").agg(F.array_sort(F.array_distinct(F.collect_list(F.round("s", 9)))).alias("cuts"))
    at = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    whole = lines.join(cuts, "id", "left").withColumn("at", at).select("*", F.explode(F.sequence(F.lit(0), F.size("at") - 2)).alias("k"))
    end = lambda c, k: F.round(F.col(f"a{c}") + F.get("at", k) * (F.col(f"b{c}") - F.col(f"a{c}")), digits)
    p = F.struct(end("x", F.col("k")).alias("x"), end("y", F.col("k")).alias("y"))
    q = F.struct(end("x", F.col("k") + 1).alias("x"), end("y", F.col("k") + 1).alias("y"))
    out = whole.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).where("a <> b").distinct()
    return out.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def simplify_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, geometry) with points dropped that lie within half the tolerance of the line without them (Douglas and Peucker), which is
    where growing the tolerance until the shape moves ends: the first step already moves nothing."""
    import pandas as pd

    def reduce(line):
        import numpy as np

        g = np.array([(p["x"], p["y"]) for p in line])
        keep, todo = {0, len(g) - 1}, [(0, len(g) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = g[b] - g[a]
            n = float(d @ d)
            rel = g[a + 1 : b] - g[a]
            t = np.clip(rel @ d / n, 0, 1) if n else np.zeros(len(rel))
            off = np.hypot(*(rel - t[:, None] * d).T)
            k = int(off.argmax())
            if off[k] > tolerance / 2:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return [line[i] for i in sorted(keep)]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "geometry": [reduce(list(x)) for x in b["geometry"]]})

    return lines.select("id", "geometry").mapInPandas(run, lines.select("id", "geometry").schema)
