"""Raster operators on cell tables (row_, col_, value); y grows with row_, x with col_."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import graph
from .iterate import cut


def neighbours(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Each cell with the cells about it: (row_, col_, value, dr, dc, near); an equi-join on the shifted cell."""
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a or b])).alias("s")
    moved = cells.select("row_", "col_", "value", shift).select("row_", "col_", "value", "s.*", (F.col("row_") + F.col("s.dr")).alias("r2"), (F.col("col_") + F.col("s.dc")).alias("c2"))
    return moved.join(cells.select(F.col("row_").alias("r2"), F.col("col_").alias("c2"), F.col("value").alias("near")), ["r2", "c2"])


def sample(points: DataFrame, cells: DataFrame, size: float, key: str = "node_id") -> DataFrame:
    """(key, value): bilinear between the four cell centres about each point, by the weight of those with data; null without any."""
    x, y = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)]))
    p = points.select(key, x.alias("fx"), y.alias("fy"), corner.alias("s"))
    p = p.select(key, (F.floor("fy") + F.col("s.dr")).cast("long").alias("row_"), (F.floor("fx") + F.col("s.dc")).cast("long").alias("col_"), ((1 - F.abs(F.col("fy") - F.floor("fy") - F.col("s.dr"))) * (1 - F.abs(F.col("fx") - F.floor("fx") - F.col("s.dc")))).alias("w"))
    j = p.join(cells, ["row_", "col_"], "left")
    has = F.col("value").isNotNull()
    return j.groupBy(key).agg((F.sum(F.when(has, F.col("w") * F.col("value"))) / F.nullif(F.sum(F.when(has, F.col("w")).otherwise(0.0)), F.lit(0.0))).alias("value"))


def at_cell(points: DataFrame, cells: DataFrame, size: float, key: str = "node_id") -> DataFrame:
    """(key, value) of the cell each point lies in; without data: no row."""
    p = points.select(key, F.floor(F.col("y") / size).cast("long").alias("row_"), F.floor(F.col("x") / size).cast("long").alias("col_"))
    return p.join(cells.where("value is not null"), ["row_", "col_"]).select(key, "value")


def fill_gaps(cells: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Cells without data get the value of the nearest cell with data (squared distance; ties: row, column).

    Rings grow around the gaps only; a ring of radius k is searched when no
    smaller square held a nearer cell.
    """
    full = cut(cells.where("value is not null").select(F.col("row_").alias("r2"), F.col("col_").alias("c2"), F.col("value").alias("v2")))
    gaps = cut(cells.where("value is null").select("row_", "col_"))
    filled, reach = None, 1
    if not full.take(1):
        return cells
    for _ in range(rounds):
        if not gaps.take(1):
            break
        span = range(-reach, reach + 1)
        offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in span for b in span])) if reach <= 4 else None
        if offsets is not None:
            probe = gaps.select("row_", "col_", offsets.alias("s")).select("row_", "col_", (F.col("row_") + F.col("s.dr")).alias("r2"), (F.col("col_") + F.col("s.dc")).alias("c2"))
            pairs = probe.join(full, ["r2", "c2"])
        else:  # wide gaps: tiles as wide as the radius
            t = lambda c: F.floor(F.col(c) / reach)
            probe = gaps.withColumn("i", F.explode(F.sequence(t("row_") - 1, t("row_") + 1))).withColumn("j", F.explode(F.sequence(t("col_") - 1, t("col_") + 1)))
            pairs = probe.join(full.withColumn("i", t("r2")).withColumn("j", t("c2")), ["i", "j"])
        square = (F.col("r2") - F.col("row_")) * (F.col("r2") - F.col("row_")) + (F.col("c2") - F.col("col_")) * (F.col("c2") - F.col("col_"))
        best = pairs.withColumn("d", square).where(F.col("d") <= reach * reach).groupBy("row_", "col_").agg(F.min(F.struct("d", "r2", "c2", "v2")).alias("m"))
        best = cut(best.select("row_", "col_", F.col("m.v2").alias("value")))
        filled = best if filled is None else filled.unionByName(best)
        gaps = cut(gaps.join(best, ["row_", "col_"], "left_anti"))
        reach *= 2
    done = cells.where("value is not null").select("row_", "col_", "value")
    return done if filled is None else done.unionByName(filled)


def hydroflatten(cells: DataFrame, water: DataFrame) -> DataFrame:
    """Cells of each water body (row_, col_, body) take the least value of the ring one cell about it, else of its inside; later bodies win."""
    near = neighbours(cells).select("r2", "c2", F.col("row_").alias("row_"), F.col("col_").alias("col_"), "near")
    inside = water.join(near, ["row_", "col_"]).select("body", "r2", "c2", "near")
    ring = inside.join(water.select("body", F.col("row_").alias("r2"), F.col("col_").alias("c2")), ["body", "r2", "c2"], "left_anti").groupBy("body").agg(F.min("near").alias("ring"))
    own = water.join(cells, ["row_", "col_"]).groupBy("body").agg(F.min("value").alias("own"))
    level = own.join(ring, "body", "left").select("body", F.coalesce("ring", "own").alias("level"))
    over = water.join(level, "body").groupBy("row_", "col_").agg(F.max_by("level", "body").alias("level"))
    return cells.join(over, ["row_", "col_"], "left").select("row_", "col_", F.coalesce("level", "value").alias("value"))


def slope_pct(cells: DataFrame, size: float) -> DataFrame:
    """Slope in percent by central differences (one-sided at edges and gaps)."""
    n = neighbours(cells.where("value is not null"))
    side = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("near")))
    g = n.groupBy("row_", "col_", "value").agg(side(0, -1).alias("w"), side(0, 1).alias("e"), side(-1, 0).alias("s"), side(1, 0).alias("n"))
    diff = lambda a, b: (F.coalesce(a, "value") - F.coalesce(b, "value")) / (size * (F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")))
    part = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), 0.0).otherwise(diff(a, b))
    return g.select("row_", "col_", (F.hypot(part("e", "w"), part("n", "s")) * 100).alias("slope"))


def burn(cells: DataFrame, streets: DataFrame, depth: float) -> DataFrame:
    """Cells under streets (row_, col_) lowered by a depth."""
    s = streets.select("row_", "col_").distinct().withColumn("on", F.lit(True))
    return cells.join(s, ["row_", "col_"], "left").select("row_", "col_", (F.col("value") - F.when(F.col("on"), F.lit(float(depth))).otherwise(0.0)).alias("value"))


def breach(cells: DataFrame, rounds: int = 100_000) -> DataFrame:
    """Pits and flats get a way out: the cost of a cell is the least digging on a way to the border or a gap, and
    each cell drains to the neighbour on its way.  Returns (row_, col_, to_row, to_col) for all cells but outlets.

    Own specification (no external tool's result is reproduced): flooding from
    the outlets, a cell's level being the larger of its own value and that of
    the neighbour it drains to; ties by distance in cells, then row, column.
    Every round takes each cell's best offer anew until all labels agree; a
    way may be of any length.
    """
    full = cut(cells.where("value is not null"))
    n = cut(neighbours(full))
    inner = n.groupBy("row_", "col_").agg(F.count("*").alias("k"))
    out = F.coalesce("k", F.lit(0)) < 8
    state = cut(full.join(inner, ["row_", "col_"], "left").select("row_", "col_", out.alias("out"), F.when(out, F.struct(F.col("value").alias("level"), F.lit(0).alias("far"), F.lit(-1).cast("long").alias("r"), F.lit(-1).cast("long").alias("c"))).alias("label")))
    for _ in range(rounds):
        offer = n.join(state.select(F.col("row_").alias("r2"), F.col("col_").alias("c2"), F.col("label").alias("l2")).where("l2 is not null"), ["r2", "c2"])
        offer = offer.groupBy("row_", "col_").agg(F.min(F.struct(F.greatest("value", F.col("l2.level")).alias("level"), (F.col("l2.far") + 1).alias("far"), F.col("r2").alias("r"), F.col("c2").alias("c"))).alias("o"))
        nxt = state.join(offer, ["row_", "col_"], "left").select("row_", "col_", "out", F.when(F.col("out"), F.col("label")).otherwise(F.col("o")).alias("label"), (~F.col("out") & ~F.col("o").eqNullSafe(F.col("label"))).alias("moved"))
        nxt = cut(nxt)
        state = nxt.drop("moved")
        if not nxt.where("moved").take(1):
            return state.where("not out").select("row_", "col_", F.col("label.r").alias("to_row"), F.col("label.c").alias("to_col"))
    raise RuntimeError("breaching did not settle")


def d8(cells: DataFrame) -> DataFrame:
    """(row_, col_, to_row, to_col): each cell's steepest lower neighbour (diagonals by their length; ties: row, column); null at pits."""
    drop = (F.col("value") - F.col("near")) / F.when((F.col("dr") != 0) & (F.col("dc") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0)
    down = neighbours(cells.where("value is not null")).withColumn("drop", drop).where("drop > 0")
    best = down.groupBy("row_", "col_").agg(F.min(F.struct((-F.col("drop")).alias("d"), "r2", "c2")).alias("m"))
    return cells.where("value is not null").join(best, ["row_", "col_"], "left").select("row_", "col_", F.col("m.r2").alias("to_row"), F.col("m.c2").alias("to_col"))


def cell_key(row, col):
    return F.col(row).cast("long") * 1_000_000_000 + F.col(col)


def flow_accumulation(pointer: DataFrame) -> DataFrame:
    """(row_, col_, cells): how many cells drain through each, itself included."""
    s = pointer.select(cell_key("row_", "col_").alias("node"), cell_key("to_row", "to_col").alias("next"), F.lit(1).cast("long").alias("amount"))
    t = graph.accumulate(s)
    return t.select(F.floor(F.col("node") / 1_000_000_000).cast("long").alias("row_"), (F.col("node") % 1_000_000_000).alias("col_"), F.col("total").alias("cells"))


def watersheds(pointer: DataFrame, pours: DataFrame) -> DataFrame:
    """(row_, col_, id): the first pour point (row_, col_, id) that each cell drains to, itself included; others lack."""
    p = pours.groupBy("row_", "col_").agg(F.min("id").alias("id"))
    s = pointer.join(p, ["row_", "col_"], "left").select(cell_key("row_", "col_").alias("node"), F.when(F.col("id").isNull(), cell_key("to_row", "to_col")).alias("into"))
    end = graph.resolve(s.where("into is not null"))
    last = s.join(end.select("node", F.col("into").alias("end")), "node", "left").select("node", F.coalesce("end", "node").alias("end"))
    ids = p.select(cell_key("row_", "col_").alias("end"), "id")
    out = last.join(ids, "end")
    return out.select(F.floor(F.col("node") / 1_000_000_000).cast("long").alias("row_"), (F.col("node") % 1_000_000_000).alias("col_"), "id")


def zonal_mean(zones: DataFrame, cells: DataFrame, by: str = "id", low: float | None = 0.0, otherwise: float = 0.5) -> DataFrame:
    """(by, mean) of the finite cells of each zone (row_, col_, by), not below `low`; zones without: the median of the others, else `otherwise`."""
    m = zones.join(cells.where("value is not null and not isnan(value)"), ["row_", "col_"]).groupBy(by).agg(F.avg("value").alias("mean"))
    if low is not None:
        m = m.withColumn("mean", F.greatest("mean", F.lit(float(low))))
    mid = m.agg(F.median("mean").alias("mid"))
    return zones.select(by).distinct().join(m, by, "left").crossJoin(F.broadcast(mid)).select(by, F.coalesce("mean", "mid", F.lit(float(otherwise))).alias("mean"))


def regions(labels: DataFrame, reach: int = 0) -> DataFrame:
    """(row_, col_, id, part): connected parts of equal ids; part is the least cell key of it.

    Cells that share a side are connected; with reach, so are cells at most so
    many rows and columns apart (1: corners count, 2: gaps of one cell too).
    """
    l = labels.select("row_", "col_", "id", cell_key("row_", "col_").alias("node"))
    step = lambda dr, dc: l.select((F.col("row_") + dr).alias("row_"), (F.col("col_") + dc).alias("col_"), F.col("id").alias("id2"), F.col("node").alias("other"))
    steps = [(1, 0), (0, 1)] if reach < 1 else [(r, c) for r in range(reach + 1) for c in range(-reach, reach + 1) if (r, c) > (0, 0)]
    near = step(*steps[0])
    for s in steps[1:]:
        near = near.unionByName(step(*s))
    pairs = l.join(near, ["row_", "col_"]).where("id = id2").select(F.col("node").alias("a"), F.col("other").alias("b"))
    c = graph.components(pairs, l.select("node"))
    return l.join(c, "node").select("row_", "col_", "id", F.col("root").alias("part"))


def borders(labels: DataFrame, by: str = "part") -> DataFrame:
    """(a, b, border): how many cell sides each two different parts share."""
    l = labels.select("row_", "col_", F.col(by).alias("a"))
    step = lambda dr, dc: l.select((F.col("row_") + dr).alias("row_"), (F.col("col_") + dc).alias("col_"), F.col("a").alias("b"))
    sides = l.join(step(1, 0).unionByName(step(0, 1)).unionByName(step(-1, 0)).unionByName(step(0, -1)), ["row_", "col_"]).where("a <> b")
    return sides.groupBy("a", "b").agg(F.count("*").alias("border"))


def rehome(labels: DataFrame, reach: int = 1, rounds: int = 10_000) -> DataFrame:
    """(row_, col_, id): the largest part of each id keeps it (ties: least part); round by round every other part takes the id of
    the settled part with which it shares the longest border (ties: least part); islands take that of the nearest settled cell."""
    r = cut(regions(labels, reach))
    size = r.groupBy("id", "part").agg(F.count("*").alias("n"))
    keep = size.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("m")).select(F.col("m.part").alias("part"), "id")
    settled, rest = cut(keep), cut(size.select("part").join(keep, "part", "left_anti"))
    touching = cut(borders(r))
    for _ in range(rounds):
        near = touching.join(settled.select(F.col("part").alias("b"), "id"), "b").join(rest.select(F.col("part").alias("a")), "a", "left_semi")
        got = cut(near.groupBy(F.col("a").alias("part")).agg(F.min(F.struct((-F.col("border")).alias("n"), "b", "id")).alias("m")).select("part", F.col("m.id").alias("id")))
        if not got.take(1):
            break
        settled, rest = cut(settled.unionByName(got)), cut(rest.join(got, "part", "left_anti"))
    else:
        raise RuntimeError("parts did not settle")
    out = r.drop("id").join(settled, "part", "left").select("row_", "col_", "part", "id")
    if not rest.take(1):
        return out.select("row_", "col_", "id")
    lone = cut(out)
    # the island takes the id that its cell nearest to a settled one finds
    filled = fill_gaps(lone.select("row_", "col_", F.col("id").alias("value")))
    first = lone.where("id is null").join(filled, ["row_", "col_"]).groupBy("part").agg(F.min(F.struct("row_", "col_", "value")).alias("m")).select("part", F.col("m.value").cast(labels.schema["id"].dataType).alias("new"))
    return lone.join(first, "part", "left").select("row_", "col_", F.coalesce("id", "new").alias("id"))


def nested(labels: DataFrame) -> DataFrame:
    """(sub_id, in_id, in_area): ids all of whose cells' neighbours, corners included, belong to one other id; in_area counts its cells.

    An id on the rim of the labelled cells has the outside as a neighbour and isn't nested.
    """
    l = labels.select("row_", "col_", "id")
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("s")
    near = l.select("row_", "col_", "id", shift).select("id", (F.col("row_") + F.col("s.dr")).alias("row_"), (F.col("col_") + F.col("s.dc")).alias("col_"))
    pairs = near.join(l.withColumnRenamed("id", "other"), ["row_", "col_"], "left").where("other is null or other <> id")
    one = pairs.groupBy("id").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.bool_or(F.col("other").isNull()).alias("rim")).where("not rim and lo = hi")
    size = l.groupBy(F.col("id").alias("lo")).agg(F.count("*").alias("in_area"))
    return one.join(size, "lo").select(F.col("id").alias("sub_id"), F.col("lo").alias("in_id"), "in_area")


def outlines(labels: DataFrame, size: float = 1) -> DataFrame:
    """(id, ax, ay, bx, by): the sides of cells between an id and what is not it, the id on their left: its polygons' rings in pieces."""
    l = labels.select("row_", "col_", "id")
    x, y = F.col("col_") * size, F.col("row_") * size
    out = None
    for dr, dc, a, b in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        same = l.select((F.col("row_") - dr).alias("row_"), (F.col("col_") - dc).alias("col_"), "id")
        part = l.join(same, ["row_", "col_", "id"], "left_anti").select("id", (x + a[0] * size).alias("ax"), (y + a[1] * size).alias("ay"), (x + b[0] * size).alias("bx"), (y + b[1] * size).alias("by"))
        out = part if out is None else out.unionByName(part)
    return out


def shapes(labels: DataFrame, size: float = 1) -> DataFrame:
    """(id, area, perimeter, x0, y0, x1, y1) of each id's polygon."""
    e = outlines(labels, size)
    twice = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return e.groupBy("id").agg((F.sum(twice) / 2).alias("area"), (F.count("*") * float(size)).alias("perimeter"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1"))


def split_merged(labels: DataFrame, sites: DataFrame) -> DataFrame:
    """(row_, col_, id): zones (id) that hold more than one site (zone, site, r, c) are dealt to their nearest sites, zones of one
    take its name, zones without keep theirs."""
    some = labels.select("row_", "col_", F.col("id").alias("zone"))
    near = voronoi(some, sites)
    return some.join(near, ["row_", "col_"], "left").select("row_", "col_", F.coalesce("site", "zone").alias("id"))


def snap_pours(pours: DataFrame, accumulation: DataFrame, least: int, reach: int = 1) -> DataFrame:
    """(id, row_, col_): pour points moved to the stream cell (at least so many cells drain through it) within reach that drains most
    (ties: nearer, then row, column); those without one stay."""
    span = range(-reach, reach + 1)
    probe = pours.select("id", F.col("row_").alias("r"), F.col("col_").alias("c"), F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in span for b in span])).alias("s"))
    probe = probe.select("id", "r", "c", (F.col("r") + F.col("s.dr")).alias("row_"), (F.col("c") + F.col("s.dc")).alias("col_"), (F.col("s.dr") * F.col("s.dr") + F.col("s.dc") * F.col("s.dc")).alias("off"))
    best = probe.join(accumulation.where(F.col("cells") >= least), ["row_", "col_"]).groupBy("id").agg(F.min(F.struct((-F.col("cells")).alias("n"), "off", "row_", "col_")).alias("m"))
    return pours.join(best, "id", "left").select("id", F.coalesce("m.row_", "row_").alias("row_"), F.coalesce("m.col_", "col_").alias("col_"))


def fractional_cell(x, y, x0: float, y0: float, size: float, centre: bool = True):
    """(row, column) as fractions of a position in a grid whose first cell begins at (x0, y0); whole numbers are cell centres if asked."""
    half = 0.5 if centre else 0.0
    return (y - y0) / size - half, (x - x0) / size - half


def window(cells: DataFrame, x0: float, y0: float, x1: float, y1: float, size: float, margin: int = 0) -> DataFrame:
    """Cells that a box touches, and a margin of cells about it; a range predicate that a scan can push down."""
    import math

    rows = F.col("row_").between(math.floor(y0 / size) - margin, math.ceil(y1 / size) - 1 + margin)
    return cells.where(rows & F.col("col_").between(math.floor(x0 / size) - margin, math.ceil(x1 / size) - 1 + margin))


def resample(target: DataFrame, cells: DataFrame, size: float, smooth: bool) -> DataFrame:
    """(row_, col_, value) of target cells (row_, col_, x, y: their centre in the source's coordinates): bilinear, or that of the
    source cell they lie in; null where the source has none."""
    named = target.withColumn("key", F.struct("row_", "col_")).select("key", "x", "y")
    got = sample(named, cells, size, "key") if smooth else at_cell(named, cells, size, "key")
    out = target.select(F.struct("row_", "col_").alias("key")).join(got, "key", "left")
    return out.select("key.row_", "key.col_", "value")


def closing(cells: DataFrame, reach: int) -> DataFrame:
    """(row_, col_, id): an id's own cells and those that dilation and then erosion by so many cells add; the first id wins."""
    own = cells.select("row_", "col_", "id")
    return own.unionByName(enclosed(own, None, reach).join(own.select("row_", "col_"), ["row_", "col_"], "left_anti"))


def waters(classes: DataFrame, water: int = 11, least: int = 9, reach: int = 1) -> DataFrame:
    """(row_, col_, body): water bodies of a land-cover grid: connected cells of the class, at least so many, closed by a cell."""
    r = regions(classes.where(F.col("value") == water).select("row_", "col_", F.lit(1).alias("id")))
    big = r.groupBy("part").count().where(F.col("count") >= least).select("part")
    bodies = r.join(big, "part", "left_semi").select("row_", "col_", F.col("part").alias("id"))
    return closing(bodies, reach).withColumnRenamed("id", "body")


def longest_border(labels: DataFrame) -> DataFrame:
    """(id, near, border): for each id the neighbour with the longest shared border (in cell sides; ties: smaller id)."""
    l = labels.select("row_", "col_", "id")
    step = lambda dr, dc: l.select((F.col("row_") + dr).alias("row_"), (F.col("col_") + dc).alias("col_"), F.col("id").alias("near"))
    sides = l.join(step(1, 0).unionByName(step(0, 1)).unionByName(step(-1, 0)).unionByName(step(0, -1)), ["row_", "col_"]).where("id <> near")
    n = sides.groupBy("id", "near").agg(F.count("*").alias("border"))
    return n.groupBy("id").agg(F.min(F.struct((-F.col("border")).alias("b"), "near")).alias("m")).select("id", F.col("m.near").alias("near"), (-F.col("m.b")).alias("border"))


def repair_parts(labels: DataFrame) -> DataFrame:
    """(row_, col_, id): the largest part of each id keeps it (ties: least part); other parts take the id of the longest border to a keeper, else keep theirs."""
    r = cut(regions(labels))
    size = r.groupBy("id", "part").agg(F.count("*").alias("n"))
    keep = size.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("m")).select("id", F.col("m.part").alias("part"))
    marked = r.join(keep.withColumn("kept", F.lit(True)), ["id", "part"], "left").select("row_", "col_", F.col("id").alias("own"), "part", F.coalesce("kept", F.lit(False)).alias("kept"))
    border = longest_border(marked.select("row_", "col_", F.when(F.col("kept"), F.col("own")).otherwise(-F.col("part") - 1).alias("id")))
    move = border.where("id < 0 and near >= 0").select((-F.col("id") - 1).alias("part"), F.col("near").alias("to"))
    return marked.join(move, "part", "left").select("row_", "col_", F.when(F.col("kept"), F.col("own")).otherwise(F.coalesce("to", "own")).alias("id"))


def voronoi(cells: DataFrame, sites: DataFrame, by: str = "zone") -> DataFrame:
    """(row_, col_, site): within each zone the nearest of its sites (zone, site, r, c); ties: smaller site."""
    d = (F.col("row_") - F.col("r")) * (F.col("row_") - F.col("r")) + (F.col("col_") - F.col("c")) * (F.col("col_") - F.col("c"))
    return cells.join(sites, by).groupBy("row_", "col_").agg(F.min(F.struct(d.alias("d"), "site")).alias("m")).select("row_", "col_", F.col("m.site").alias("site"))


def enclosed(labels: DataFrame, ids, reach: int) -> DataFrame:
    """(row_, col_, id): cells that a closing by `reach` cells (dilation, then erosion) adds to an id's own cells; first id wins."""
    square = lambda df: df.withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])))
    own = labels.where(F.col("id").isin(*ids)) if ids is not None else labels
    wide = square(own).select((F.col("row_") + F.col("s.dr")).alias("row_"), (F.col("col_") + F.col("s.dc")).alias("col_"), "id").distinct()
    back = square(wide).select((F.col("row_") + F.col("s.dr")).alias("row_"), (F.col("col_") + F.col("s.dc")).alias("col_"), "id").groupBy("row_", "col_", "id").agg(F.count("*").alias("n")).where(F.col("n") == (2 * reach + 1) ** 2)
    return back.join(own.select("row_", "col_", "id"), ["row_", "col_", "id"], "left_anti").groupBy("row_", "col_").agg(F.min("id").alias("id"))
