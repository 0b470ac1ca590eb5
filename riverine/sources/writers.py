"""Writers: GeoJSON features, node-link JSON, layers, rain files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..network import Network

# The layers of a model and the edge and node types that go there.
EDGE_LAYERS = {"pipes": ("pipe",), "rivers": ("river",), "outfalls": ("outfall", "waste-outfall"), "orifices": ("orifice",), "weirs": ("weir",), "pond_links": ("pond_connector", "pond_outflow", "pond_inflow"), "street_channels": ("street_channel",)}
NODE_LAYERS = {"storage": ("water_body",), "outfall_nodes": ("river_outfall", "water_body_outfall", "dummy_river", "waste"), "surface_nodes": ("surface",)}


def _coordinates(g: Column) -> Column:
    return F.transform(g, lambda p: F.array(p["x"], p["y"]))


def _plain(df: DataFrame, skip: set[str]) -> Column:
    """The other columns as one struct; lists of text joined by commas."""
    cells = [F.concat_ws(",", c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes if c not in skip]
    return F.struct(*cells)


def node_features(nodes: DataFrame) -> DataFrame:
    """feature: one GeoJSON point per node."""
    return nodes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), _plain(nodes, {"x", "y"}).alias("properties"))).alias("feature"))


def edge_features(edges: DataFrame) -> DataFrame:
    """feature: one GeoJSON line per edge."""
    return edges.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), _coordinates(F.col("geometry")).alias("coordinates")).alias("geometry"), _plain(edges, {"geometry"}).alias("properties"))).alias("feature"))


def to_wkt(g: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(g, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def edge_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their geometry, those without as the chord between their ends."""
    e = edges
    for end in ("u", "v"):
        e = e.join(nodes.select(F.col("node_id").alias(end), F.struct("x", "y").alias(f"{end}p")), end)
    return e.withColumn("geometry", F.coalesce("geometry", F.array("up", "vp"))).drop("up", "vp")


def layers(network: Network) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) with their layer; orifices that end in -grate go to grates, nodes of no layer to junctions."""
    kind = F.lit("other")
    for name, types in EDGE_LAYERS.items():
        kind = F.when(F.col("edge_type").isin(*types), F.lit(name)).otherwise(kind)
    edges = network.edges.withColumn("layer", F.when((F.col("edge_type") == "orifice") & F.col("id").endswith("-grate"), F.lit("grates")).otherwise(kind))
    kind = F.lit("junctions")
    for name, types in NODE_LAYERS.items():
        kind = F.when(F.col("node_type").isin(*types), F.lit(name)).otherwise(kind)
    return edges, network.nodes.withColumn("layer", kind)


def write_layers(network: Network, path: str) -> None:
    """Parquet, one folder per layer, which readers prune by."""
    edges, nodes = layers(network)
    edges.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/edges")
    nodes.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/nodes")
    if network.subs is not None:
        network.subs.write.mode("overwrite").parquet(f"{path}/subcatchments")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as node-link JSON in two folders of lines, one object each; geometries as WKT.  read_graph_lines reads them in many tasks."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    e = edges.withColumn("geometry", to_wkt(F.col("geometry"))) if "geometry" in edges.columns else edges
    e.withColumnsRenamed({"u": "source", "v": "target"}).write.mode("overwrite").json(f"{path}/links")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """text: the whole graph as one node-link JSON document, for readers that want a single file of a small graph."""
    e = edges.withColumn("geometry", to_wkt(F.col("geometry"))) if "geometry" in edges.columns else edges
    n = nodes.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*nodes.columns)))).alias("n"))
    l = e.withColumnsRenamed({"u": "source", "v": "target"})
    l = l.agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target", *[c for c in l.columns if c not in ("source", "target")])))).alias("l"))
    return n.crossJoin(l).select(F.concat(F.lit('{"directed": true, "multigraph": true, "graph": {}, "nodes": '), "n", F.lit(', "links": '), "l", F.lit("}")).alias("text"))


def write_cells(cells: DataFrame, path: str, tile: int = 256) -> None:
    """A grid as Parquet, a folder per tile row, so that a window reads just its rows."""
    cells.withColumn("tile_row", F.floor(F.col("row_") / tile).cast("int")).write.mode("overwrite").partitionBy("tile_row").parquet(path)


def config_rows(spark, params) -> DataFrame:
    """(group, name, value): every parameter of a run, its value as JSON."""
    import json
    from dataclasses import asdict

    rows = [(g, n, json.dumps(v)) for g, values in asdict(params).items() for n, v in values.items()]
    return spark.createDataFrame(rows, "`group` string, name string, value string")
