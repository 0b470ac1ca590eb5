"""Readers of street, river, water, rain and result data, by Spark's own sources."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, text

LINE = "array<struct<x:double,y:double>>"


def layer(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A vector layer with bounds columns x0, y0, x1, y1 where it has them: the box then is pushed down to the scan."""
    df = spark.read.parquet(path)
    if bbox and {"x0", "y0", "x1", "y1"} <= set(df.columns):
        a, b, c, d = bbox
        df = df.where((F.col("x1") >= a) & (F.col("x0") <= c) & (F.col("y1") >= b) & (F.col("y0") <= d))
    return df


def streets(df: DataFrame) -> DataFrame:
    """Lines of more than one different point; highway kinds given as lists are joined by commas."""
    if dict(df.dtypes)["highway"].startswith("array"):
        df = df.withColumn("highway", F.concat_ws(",", "highway"))
    return df.where((F.size("geometry") > 1) & ~((F.size("geometry") == 2) & geo.is_closed(F.col("geometry"))))


def basins(df: DataFrame, least: float = 200, most: float = 500_000) -> DataFrame:
    """Water polygons (rings: outer ring first) of an area within limits, outer ring only."""
    out = df.withColumn("ring", F.get("rings", F.lit(0))).withColumn("area_m2", geo.ring_area(F.col("ring")))
    return out.where(F.col("area_m2").between(least, most)).drop("rings")


def water_bodies(layers: dict[str, DataFrame], least: float) -> DataFrame:
    """Layers in one table with wb_source; those without shape or too small go."""
    out = None
    for source, df in layers.items():
        part = df.where("ring is not null").withColumn("wb_source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.where(geo.ring_area(F.col("ring")) >= least)


def explode_lines(df: DataFrame) -> DataFrame:
    """Multi-part lines (parts: array of lines) as one row per part; empty parts go."""
    return df.select(*[c for c in df.columns if c != "parts"], F.explode("parts").alias("geometry")).where("size(geometry) > 1")


def graph_from_lines(lines: DataFrame, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (geometry, edge_type, ...): ends snapped to digits are nodes, numbered in the order of their keys."""
    from pyspark.sql import Window

    a, b = F.element_at("geometry", 1), F.element_at("geometry", -1)
    e = lines.where(~geo.is_closed(F.col("geometry"))).withColumn("ku", geo.point_key(a["x"], a["y"], digits)).withColumn("kv", geo.point_key(b["x"], b["y"], digits)).where("ku <> kv")
    ends = e.select(F.explode(F.array(F.struct(F.col("ku").alias("k"), a.alias("p")), F.struct(F.col("kv").alias("k"), b.alias("p")))).alias("n")).groupBy("n.k").agg(F.min("n.p").alias("p"))
    # numbers by a range partition's own count and the counts before it: no single task sees all keys
    ranged = ends.repartitionByRange(F.col("k")).withColumn("part", F.spark_partition_id()).withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("k")) - 1)
    from ..operators.iterate import cut

    ranged = cut(ranged)
    sizes = ranged.groupBy("part").count()
    before = sizes.withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    nodes = ranged.join(F.broadcast(before), "part").select((F.col("start") + F.col("i")).alias("node_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "k")
    for end in ("u", "v"):
        e = e.join(nodes.select(F.col("k").alias(f"k{end}"), F.col("node_id").alias(end)), f"k{end}").drop(f"k{end}")
    return nodes.drop("k"), e.withColumn("length", geo.length(F.col("geometry")))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file; edge geometries are WKT lines."""
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    links = "links" if "links" in doc.columns else "edges"
    edges = doc.select(F.explode(links).alias("e")).select("e.*").withColumnsRenamed({"source": "u", "target": "v"})
    return nodes, edges.withColumn("geometry", from_wkt(F.col("geometry"))) if "geometry" in edges.columns else edges


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph written in lines; any number of tasks reads them."""
    edges = spark.read.json(f"{path}/links").withColumnsRenamed({"source": "u", "target": "v"})
    return spark.read.json(f"{path}/nodes"), edges.withColumn("geometry", from_wkt(F.col("geometry"))) if "geometry" in edges.columns else edges


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int], tile: int = 256) -> DataFrame:
    """Cells of the given rows (first, last): of the tile rows they lie in alone."""
    a, b = rows
    return spark.read.parquet(path).where(F.col("tile_row").between(a // tile, b // tile) & F.col("row_").between(a, b)).drop("tile_row")


def clipped(df: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Lines (geometry) that a box touches with their own box."""
    x0, y0, x1, y1 = bbox
    xs, ys = F.transform("geometry", lambda p: p["x"]), F.transform("geometry", lambda p: p["y"])
    return df.where((F.array_max(xs) >= x0) & (F.array_min(xs) <= x1) & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1))


def starting_edges(streets: DataFrame, rivers: DataFrame) -> DataFrame:
    """Streets as pipes and rivers, clipped to the streets' box, in one table; a river keeps its line and nothing else."""
    xs, ys = F.col("p.x"), F.col("p.y")
    box = streets.select(F.explode("geometry").alias("p")).agg(F.min(xs).alias("bx0"), F.min(ys).alias("by0"), F.max(xs).alias("bx1"), F.max(ys).alias("by1"))
    lo = lambda c: F.array_min(F.transform("geometry", lambda p: p[c]))
    hi = lambda c: F.array_max(F.transform("geometry", lambda p: p[c]))
    near = rivers.crossJoin(F.broadcast(box)).where((hi("x") >= F.col("bx0")) & (lo("x") <= F.col("bx1")) & (hi("y") >= F.col("by0")) & (lo("y") <= F.col("by1")))
    return streets.withColumn("edge_type", F.lit("pipe")).unionByName(near.select("id", "geometry").withColumn("edge_type", F.lit("river")), allowMissingColumns=True)


def tiles(spark: SparkSession, bbox: tuple[float, float, float, float], resolution: float, most_pixels: int) -> DataFrame:
    """(tile, x0, y0, x1, y1, key): a box in metres cut into equal tiles of at most so many pixels; key names a tile's file."""
    import math

    a, b, c, d = bbox
    side = max(1, math.isqrt(most_pixels)) * resolution
    nx, ny = max(1, math.ceil((c - a) / side)), max(1, math.ceil((d - b) / side))
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    x, y = lambda k: F.lit(a) + (c - a) * k / nx, lambda k: F.lit(b) + (d - b) * k / ny
    t = spark.range(nx * ny).select(F.col("id").alias("tile"), x(i).alias("x0"), y(j).alias("y0"), x(i + 1).alias("x1"), y(j + 1).alias("y1"))
    return t.withColumn("key", text.box_hash(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(resolution)))


def result_times(spark: SparkSession, start_day: float, step_s: int, periods: int) -> DataFrame:
    """(period, hours, ts) of a result's reports: start is in days since 1899-12-30, the first report a step later."""
    i = F.col("id") + 1
    base = round((start_day - 25_569) * 86_400)
    return spark.range(periods).select(F.col("id").alias("period"), (i * step_s / 3600).alias("hours"), F.timestamp_seconds(F.lit(base) + i * step_s).cast("timestamp_ntz").alias("ts"))


def same_box(a, b):
    """Whether two boxes, as arrays of corners, hold the same coordinates in any order."""
    return F.array_sort(a) == F.array_sort(b)


def from_wkt(wkt):
    """LINESTRING (x y, x y ...) as an array of points; other shapes and null give null."""
    inner = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split_part(F.trim(p), F.lit(" "), F.lit(1)).try_cast("double").alias("x"), F.split_part(F.trim(p), F.lit(" "), F.lit(2)).try_cast("double").alias("y")))
    return F.when(inner != "", points)


def design_rain(spark: SparkSession, path: str, return_period: int, duration: str) -> float:
    """Rain (m/h) of a precipitation-frequency table in mm/h: the row of a duration, the column of a return period; ValueError if either lacks."""
    rows = [[x.strip() for x in r["value"].split(",")] for r in spark.read.text(path).where("value like '%:,%' or lower(value) like '%by duration%'").collect()]
    head = next((r for r in rows if "by duration" in r[0].lower()), None)
    if head is None or str(return_period) not in head:
        raise ValueError(f"no column of {return_period} years")
    row = next((r for r in rows if r[0].rstrip(":") == duration), None)
    if row is None:
        raise ValueError(f"no row of {duration}")
    return float(row[head.index(str(return_period))]) / 1000


def cache_key(*bounds, resolution):
    return text.box_hash(*[F.lit(b) for b in bounds], F.lit(resolution))


# Fixed values of the binary result format: magic number, kinds of elements in their order.
RESULT_MAGIC = 516114522
ELEMENTS = ("subcatchment", "node", "link")


def parse_results(data: bytes) -> Iterator[tuple]:
    """(element, name, attribute number, period, days since 1899-12-30, value) of a binary result file."""
    start_ids, start_props, start_results, periods, error, magic = struct.unpack("<6i", data[-24:])
    if magic != RESULT_MAGIC or struct.unpack_from("<i", data)[0] != RESULT_MAGIC or error:
        raise ValueError("no result file, or one of a failed run")
    _, _, _, n_sub, n_node, n_link, n_poll = struct.unpack_from("<7i", data)
    at, names = start_ids, []
    for count in (n_sub, n_node, n_link, n_poll):
        part = []
        for _ in range(count):
            size = struct.unpack_from("<i", data, at)[0]
            part.append(data[at + 4 : at + 4 + size].decode("latin-1"))
            at += 4 + size
        names.append(part)
    at = start_props
    for count in (n_sub, n_node, n_link):  # input properties are stepped over
        k = struct.unpack_from("<i", data, at)[0]
        at += 4 + 4 * k + 4 * k * count
    widths = []
    for _ in range(3):
        k = struct.unpack_from("<i", data, at)[0]
        widths.append(k)
        at += 4 + 4 * k
    k = struct.unpack_from("<i", data, at)[0]
    size = 8 + 4 * (n_sub * widths[0] + n_node * widths[1] + n_link * widths[2] + k)
    for period in range(periods):
        at = start_results + period * size
        day = struct.unpack_from("<d", data, at)[0]
        at += 8
        for element, part, width in zip(ELEMENTS, names, widths, strict=False):
            for name in part:
                for a, v in enumerate(struct.unpack_from(f"<{width}f", data, at)):
                    yield element, name, a, period, day, v
                at += 4 * width
        for a, v in enumerate(struct.unpack_from(f"<{k}f", data, at)):
            yield "system", "system", a, period, day, v


# Names of the attributes by element, in file order.
ATTRIBUTES = {
    "subcatchment": ("rainfall", "snow_depth", "evap_loss", "infil_loss", "runoff_rate", "gw_outflow_rate", "gw_table_elev", "soil_moisture"),
    "node": ("invert_depth", "hydraulic_head", "ponded_volume", "lateral_inflow", "total_inflow", "flooding_losses"),
    "link": ("flow_rate", "flow_depth", "flow_velocity", "flow_volume", "capacity"),
    "system": ("air_temp", "rainfall", "snow_depth", "evap_infil_loss", "runoff_flow", "dry_weather_inflow", "gw_inflow", "rdii_inflow", "direct_inflow", "total_lateral_inflow", "flood_losses", "outfall_flows", "volume_stored", "evap_rate"),
}


def results(spark: SparkSession, path: str) -> DataFrame:
    """element, name, attr, ts, value of binary result files."""

    def run(batches):
        import pyarrow as pa

        names = ["element", "name", "number", "period", "day", "value"]
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for row in parse_results(data):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names).cast(kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names).cast(kinds)

    import pyarrow as pa

    kinds = pa.schema([("element", pa.string()), ("name", pa.string()), ("number", pa.int32()), ("period", pa.int32()), ("day", pa.float64()), ("value", pa.float64())])
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "element string, name string, number int, period int, day double, value double")
    known = F.create_map(*[x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    ts = F.timestamp_millis(((F.col("day") - 25_569) * 86_400_000).cast("long"))
    return found.select("element", "name", F.coalesce(F.get(known[F.col("element")], F.col("number")), F.concat(F.lit("quality_"), F.col("number").cast("string"))).alias("attr"), ts.alias("ts"), "value")


def register(sources: dict[str, Callable[[], DataFrame]], spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each source read once into the folder; those already there aren't asked again.  A source may return None (nothing there)."""
    out = {}
    for name, read in sources.items():
        path = f"{folder}/{name}"
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            if (df := read()) is None:
                continue
            df.write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out
