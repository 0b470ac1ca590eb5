"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs.

Vectors are dealt to shards by their norm, in bands of 9 %, and within a band
by their hash: among vectors of nearly one length, the largest inner product
is close to the nearest direction, which a graph can follow.  In each shard a
directed graph is grown: a greedy beam search from the entry proposes neighbours for a batch of
new points, and relaxed pruning keeps a candidate only if no kept one is more
than `alpha` times nearer to it, so that edges point in diverse directions;
edges back are pruned the same way when a point has too many.  A query's beam
search visits every shard, and the shards' best are merged.

Inner product becomes a distance by one more coordinate that gives all vectors
of a shard the same norm; a shard is scaled by its greatest component first, so
that values of any size can be compared in single precision.  Final scores are
exact: double-precision inner products of the original vectors.  Shards of no
more points than the beam is wide are seen whole.

Equal vectors are one point with its k + 1 smallest ids, collapsed before the
shuffle, so a vector that a third of the rows share costs a task a few ids.
The number of shards follows the table (shard_rows, shard_bytes), hence a task's
memory is bounded; queries come in blocks as large as a shard, so that graphs
are copied no more often than queries.

Cases: null ids, vectors that are null, empty, zero or hold null or
non-finite components take no part, neither as queries nor as candidates;
vectors of another length are never compared; rows that repeat an id with the
same vector count once; ties go to the smaller id; an empty table gives no
rows; fewer than k candidates are all returned.  Products beyond the range of
doubles are infinite scores, as the measure says, and then tie.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import written


class Graph:
    def __init__(self, vectors: np.ndarray, degree=32, beam=64, alpha=1.2, batch=256, seed=7):
        """vectors: different ones, doubles."""
        self.vectors, self.degree, self.beam, self.alpha = vectors, degree, beam, alpha
        self._scale()
        n = len(vectors)
        self.count = np.zeros(n, np.int32)
        self.near = np.zeros((n, 2 * degree), np.int32)
        self.entry = int((self.points @ self.points.mean(0)).argmax())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        for at in range(1, n, batch):  # batches double up to the full size, so that early points see each other
            if at == 1:
                done = 1
                while done < min(n, batch + 1):
                    self._insert(order[done : min(2 * done, batch + 1)])
                    done = min(2 * done, batch + 1)
            else:
                self._insert(order[at : at + batch])

    def _scale(self) -> None:
        """points: the vectors, scaled, with one more coordinate that gives all the same norm, whose square is top."""
        scaled = self.vectors / np.abs(self.vectors).max()
        norms = (scaled**2).sum(1)
        self.top = float(norms.max())
        self.points = np.concatenate([scaled, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], 1).astype(np.float32)

    def _insert(self, new: np.ndarray) -> None:
        if not len(new):
            return
        found, _ = self.search(self.points[new], self.beam)
        mates = np.broadcast_to(new, (len(new), len(new)))[:, :64]
        found = np.concatenate([found, mates], 1)
        found = np.where(found == new[:, None], -1, found)
        kept = self._prune(new, found)
        for row, p in zip(kept, new, strict=True):
            row = row[row >= 0]
            self.near[p, : len(row)] = row
            self.count[p] = len(row)
        to, origin = kept.ravel(), np.repeat(new, kept.shape[1])
        origin, to = origin[to >= 0], to[to >= 0]
        sort = np.argsort(to, kind="stable")
        origin, to = origin[sort], to[sort]
        cut = np.flatnonzero(np.diff(to)) + 1
        full = []
        for v, add in zip(to[np.concatenate([[0], cut])].tolist() if len(to) else [], np.split(origin, cut), strict=False):
            c = self.count[v]
            add = add[~np.isin(add, self.near[v, :c])]
            if c + len(add) > self.near.shape[1]:
                full.append((v, np.concatenate([self.near[v, :c], add])))
            else:
                self.near[v, c : c + len(add)] = add
                self.count[v] = c + len(add)
        for at in range(0, len(full), 256):
            part = full[at : at + 256]
            wide = max(len(x) for _, x in part)
            table = np.full((len(part), wide), -1)
            for i, (_, x) in enumerate(part):
                table[i, : len(x)] = x
            for row, (v, _) in zip(self._prune(np.array([v for v, _ in part]), table), part, strict=True):
                row = row[row >= 0]
                self.near[v, : len(row)] = row
                self.count[v] = len(row)

    def _prune(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """At most degree diverse neighbours of each point out of its candidates (-1: none), -1 behind them."""
        mine = self.points[at]
        far = 2 * self.top - 2 * np.einsum("bcd,bd->bc", self.points[found], mine)
        far[found < 0] = np.inf
        sort = np.argsort(far, 1)[:, : 3 * self.degree]
        found, far = np.take_along_axis(found, sort, 1), np.take_along_axis(far, sort, 1)
        repeat = (found[:, :, None] == found[:, None, :]) & (np.arange(found.shape[1])[:, None] > np.arange(found.shape[1]))
        alive = np.isfinite(far) & ~repeat.any(2)
        points = self.points[found]
        between = 2 * self.top - 2 * np.matmul(points, points.transpose(0, 2, 1))
        out, row = np.full((len(at), self.degree), -1), np.arange(len(at))
        for k in range(self.degree):
            best = alive.argmax(1)
            some = alive[row, best]
            if not some.any():
                break
            out[some, k] = found[row, best][some]
            alive &= ~(some[:, None] & (self.alpha**2 * between[row, best] <= far))
            alive[row, best] = False
        return out

    def search(self, queries: np.ndarray, beam: int, wide=4) -> tuple[np.ndarray, np.ndarray]:
        """(points, -1 behind them; inner products) of each query's beam, unsorted."""
        b, row = len(queries), np.arange(len(queries))
        seen = np.zeros((b, len(self.points)), bool)
        ids, score = np.full((b, beam), -1), np.full((b, beam), -np.inf, np.float32)
        ids[:, 0], seen[:, self.entry] = self.entry, True
        score[:, 0] = queries @ self.points[self.entry]
        opened = np.ones((b, beam), bool)
        opened[:, 0] = False
        slots = np.arange(self.near.shape[1])
        while True:
            rest = np.where(opened, -np.inf, score)
            pick = np.argpartition(rest, -wide, 1)[:, -wide:] if beam > wide else np.broadcast_to(np.arange(beam), (b, beam))
            live = np.take_along_axis(rest, pick, 1) > -np.inf
            if not live.any():
                return ids, score
            more_ids, more_score = [ids], [score]
            for j in range(pick.shape[1]):
                rows = row[live[:, j]]
                if not len(rows):
                    continue
                opened[rows, pick[rows, j]] = True
                node = ids[rows, pick[rows, j]]
                near = np.where(slots < self.count[node][:, None], self.near[node], self.entry)  # the entry is seen from the start
                fresh = ~seen[rows[:, None], near]
                seen[rows[:, None], near] = True
                value = np.einsum("bcd,bd->bc", self.points[near], queries[rows])
                these, values = np.full((b, len(slots)), -1), np.full((b, len(slots)), -np.inf, np.float32)
                these[rows] = np.where(fresh, near, -1)
                values[rows] = np.where(fresh, value, -np.inf)
                more_ids.append(these)
                more_score.append(values)
            all_ids, all_score = np.concatenate(more_ids, 1), np.concatenate(more_score, 1)
            all_open = np.concatenate([opened, np.zeros((b, all_ids.shape[1] - beam), bool)], 1)
            best = np.argpartition(all_score, -beam, 1)[:, -beam:]
            ids, score, opened = (np.take_along_axis(x, best, 1) for x in (all_ids, all_score, all_open))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, near=self.near, count=self.count, entry=self.entry, how=[self.degree, self.beam], alpha=self.alpha)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        x, g = np.load(io.BytesIO(data)), cls.__new__(cls)
        g.vectors, g.near, g.count, g.entry = x["vectors"], x["near"], x["count"], int(x["entry"])
        g.degree, g.beam, g.alpha = int(x["how"][0]), int(x["how"][1]), float(x["alpha"])
        g._scale()
        return g

    def answers(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Points (-1 behind them) that the beam of each query (original scale) holds at last."""
        if len(self.points) <= beam:
            return np.broadcast_to(np.arange(len(self.points)), (len(queries), len(self.points)))
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        return self.search(np.concatenate([scaled, np.zeros((len(queries), 1))], 1).astype(np.float32), beam)[0]


#: Bands of norms to a power of two.
BANDS = 8


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim, band) of the rows that take part; the band is that of the norm."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    most = F.array_max(F.transform("v", F.abs))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))
    out = out.withColumn("most", most).withColumn("band", F.floor((F.log2("most") + F.log2(squares) / 2) * BANDS).cast("int"))
    return out.select("vec_id", "v", F.size("v").alias("dim"), "band")


def dealt(rows: DataFrame, shard_rows: int, shard_bytes: int, least_shards: int, beam: int) -> list[tuple[int, int, int, int]]:
    """(dim, band, first shard, shards) of every band.  Bands that together have no more rows than the beam is wide share a shard.

    Only a count per dimension and band reaches the driver.
    """
    by: dict[int, list] = {}
    for r in rows.groupBy("dim", "band").count().collect():
        by.setdefault(r["dim"], []).append((r["band"], r["count"]))
    out = []
    for dim, found in by.items():
        most = max(1, min(shard_rows, shard_bytes // (8 * dim), -(-sum(n for _, n in found) // least_shards)))
        first, held = -1, beam + 1
        for band, n in sorted(found):
            if held + n <= beam:
                held += n
                out.append((dim, band, first, 1))
                continue
            first = out[-1][2] + out[-1][3] if out and out[-1][0] == dim else 0
            out.append((dim, band, first, -(-n // most)))
            held = n if n <= beam else beam + 1
    return out


def build(rows: DataFrame, k: int, plan: list[tuple[int, int, int, int]], **kinds) -> DataFrame:
    """(dim, shard, graph binary, ids array<array<bigint>>) of usable rows, dealt by a plan."""
    import pyarrow as pa

    def collapse(batches):
        for batch in batches:
            found: dict[tuple, set] = {}
            for i, v, d, b in zip(batch.column("vec_id").to_pylist(), batch.column("v"), batch.column("dim").to_pylist(), batch.column("band").to_pylist(), strict=True):
                raw = (v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0).tobytes()
                found.setdefault((d, b, raw), set()).add(i)
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([x[0] for x in found], pa.int32()), "band": pa.array([x[1] for x in found], pa.int32()), "raw": pa.array([x[2] for x in found], pa.binary()),
                "ids": pa.array([sorted(x)[: k + 1] for x in found.values()], pa.list_(pa.int64())),
            })

    each = rows.mapInArrow(collapse, "dim int, band int, raw binary, ids array<bigint>")
    each = each.join(F.broadcast(rows.sparkSession.createDataFrame(plan, "dim int, band int, first int, many int")), ["dim", "band"])
    each = each.select("dim", (F.col("first") + F.pmod(F.xxhash64("raw"), F.col("many"))).cast("int").alias("shard"), "raw", "ids")

    def grow(key, group: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, set] = {}
        for raw, ids in zip(group["raw"], group["ids"], strict=True):
            found.setdefault(bytes(raw), set()).update(ids.tolist())
        names = sorted(found)
        graph = Graph(np.frombuffer(b"".join(names), "<f8").reshape(len(names), -1), **kinds)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "graph": [graph.dump()], "ids": [[sorted(found[x])[: k + 1] for x in names]]})

    return each.repartition(_spread(plan), "dim", "shard").groupBy("dim", "shard").applyInPandas(grow, "dim int, shard int, graph binary, ids array<array<bigint>>")


def _spread(plan, blocks: int = 1) -> int:
    """Partitions for groups that each take long: some four to a group, so that few tasks get two."""
    groups = blocks * len({(d, s) for d, _, first, many in plan for s in range(first, first + many)})
    return max(1, min(4 * groups, max(groups, 4000)))


def nearest(df: DataFrame, queries: DataFrame, id_col="vec_id", vector_col="embedding", k=20, beam=96, shard_rows=100_000, shard_bytes=64 << 20, least_shards=12, block: int | None = None, **kinds) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all rows of df but its own.

    queries: rows of df (same columns); a query's own id is no candidate.
    block: queries a task; as many as a shard has bytes for, if None.
    """
    out = "query_id long, vec_id long, score double"
    rows, asked = usable(df, id_col, vector_col), usable(queries, id_col, vector_col).select("vec_id", "v", "dim").distinct()
    plan = dealt(rows, shard_rows, shard_bytes, least_shards, beam)
    if not plan:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graphs = written(build(rows, k, plan, **kinds), "graphs")
    asked = written(asked, "queries")
    block = block or max(1, shard_bytes // (8 * max(d for d, *_ in plan)))
    blocks = max(1, -(-asked.count() // block))
    totals: dict[int, int] = {}
    for d, _, first, many in plan:
        totals[d] = max(totals.get(d, 0), first + many)
    shards = F.broadcast(df.sparkSession.createDataFrame(list(totals.items()), "dim int, shards int"))
    asked = asked.join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(key, found: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(graph):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        g, ids = Graph.load(graph["graph"].iloc[0]), [x.tolist() for x in graph["ids"].iloc[0]]
        answer: list[tuple] = []
        step = max(1, min(512, (64 << 20) // len(g.points), (32 << 20) // (8 * beam * g.points.shape[1])))
        for at in range(0, len(found), step):
            part = found.iloc[at : at + step]
            q = np.stack(part["v"].to_list()).astype(float)
            near = g.answers(q, beam)
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.einsum("bcd,bd->bc", g.vectors[near], q)
            order = np.argsort(np.where(near < 0, np.nan, -score), 1, kind="stable")  # not a number comes last
            for query, row, values, nodes in zip(part["vec_id"].tolist(), order, score, near, strict=True):
                best: list[tuple] = []
                for j in row.tolist():
                    s = float(values[j])
                    if nodes[j] < 0 or (len(best) >= k and s < best[k - 1][0]):
                        continue
                    best += [(s, i) for i in ids[nodes[j]] if i != query]
                    best.sort(key=lambda x: (x[0] != x[0], -x[0], x[1]))
                    best = best[: k + 1]
                answer += [(query, i, s) for s, i in best[:k]]
        return pd.DataFrame(answer, columns=["query_id", "vec_id", "score"])

    on, many = ("dim", "shard", "block"), _spread(plan, blocks)
    per_shard = asked.repartition(many, *on).groupBy(*on).cogroup(graphs.repartition(many, *on).groupBy(*on)).applyInPandas(visit, out)
    # an id with two different vectors counts by its nearer one
    number = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    one = per_shard.groupBy("query_id", "vec_id").agg(F.max_by("score", number).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(number), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
