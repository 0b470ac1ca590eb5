"""Exact removal of long substrings that occur more than once.

The decision is made on suffix arrays: over a block of byte strings a
Burrows-Wheeler transform is built, and starting from the empty string, whose
interval is the whole array, intervals are extended backwards by one byte,
breadth first.  Strings of length l+1 that begin an interval which ends where
no common prefix was known yet fix that common prefix as l; so the values come
in increasing order, and the search stops at the minimum length.  Neighbours
whose value is still unknown share at least that many bytes.

A corpus is cut into blocks by content.  Each start of a min-length string
belongs to the least hash of the k-byte strings inside it; starts in a row
with equal least hash form a context (their bytes together).  Equal strings
have equal least hashes, so all their contexts carry one key; a key that
occurs once, in a context that can't repeat itself, is settled.  Contexts that are byte for byte equal are
collapsed to one with a count before any text moves, so thousands of copies
are one string of weight n in a block.  A key whose different contexts exceed
block_bytes (a very common line in ever new surroundings) isn't gathered in
one task: its starts are spread singly, keyed by the 128-bit hash of their
own min-length bytes, which is exact for them without a suffix array.

Cases: null text counts as empty, texts shorter than the minimum have nothing
to remove; a row that occurs twice repeats itself, so all its long text goes;
ids may be null or equal (rows are told apart by id and text together); an
empty table gives no rows; texts are handled whole, whatever their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import pieces, texts, written

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first depth symbols at least (symbols 0..256)."""
    n, step = len(text), 7
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = padded[:n].copy()
    for j in range(1, step):
        key = key << 9 | padded[j : n + j]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        if step >= depth or rank[order[-1]] == n:
            return order.astype(np.int32)
        key = rank * (n + 1)
        key[: n - step] += rank[step:]
        step *= 2


def known_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """known[i]: rows i-1 and i share fewer than length symbols (separator 0 is never extended over)."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    back = np.empty(n, np.int32)  # the row of the suffix one symbol longer
    back[order] = np.arange(n, dtype=np.int32)
    same = bwt[order[1:]] == bwt[order[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # next and last row with the same symbol
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    before[bwt == 0] = after[bwt == 0] = -2
    before[bwt == 0] = n + 1
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(low):
            break
        width = high - low + 1
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(width.sum())
        lows = np.sort(back[at[before[at] < np.repeat(low, width)]])  # intervals of one level are disjoint: sorted ends match
        highs = np.sort(back[at[after[at] > np.repeat(high, width)]])
        new = ~known[highs + 1]
        low, high = lows[new].astype(np.int64), highs[new].astype(np.int64)
        known[high + 1] = True
    return known


def repeated_starts(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each string, the starts in it whose length bytes occur at least twice in all strings, counted with weights."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begin + size] = 0
    weight = np.zeros(len(text), np.int64)  # of each start that has length bytes
    for b, s, w in zip(begin.tolist(), size.tolist(), weights, strict=True):
        weight[b : max(b, b + s - length + 1)] = w
    order = suffix_order(text, length)
    known = known_prefixes(text[order - 1], length)
    full = weight[order] > 0
    first = known[:-1] | ~full | ~np.concatenate([[False], full[:-1]])
    group = np.cumsum(first) - 1
    twice = (np.bincount(group, weight[order]) >= 2)[group] & full
    hits = np.sort(order[twice])
    cut = np.searchsorted(hits, np.concatenate([begin, [len(text)]]))
    return [hits[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], begin, strict=True)]


def runs(starts: np.ndarray) -> list[dict]:
    """[{lo, hi}] of consecutive numbers, both included."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return [{"lo": a, "hi": b} for a, b in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [-1]])].tolist(), strict=True)]


def contexts(raws: list[bytes], length: int, k: int):
    """(number of the text, first start, starts, key, own) of every context, as arrays, and the joined bytes with each text's place.

    own: the context may repeat a string of its own (two equal strings of one
    context have their least hash at different places).
    """
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    place = np.cumsum(size) - size
    flat = b"".join(raws)
    h, have = _TABLE[np.frombuffer(flat, np.uint8)], 1
    while have < k:
        step = min(have, k - have)
        h = h[:-step] * _ODD + h[step:]
        h ^= h >> np.uint64(29)
        have += step
    wide, have, grams = length - k + 1, 1, h
    while have < wide:
        step = min(have, wide - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    starts = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(raws)), starts)
    at = np.repeat(place - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    key = h[at]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    span = np.diff(np.concatenate([first, [len(at)]]))
    leaves = grams[at] == key  # the string that gave the least hash begins here, yet the next start has that hash again
    leaves[first[1:] - 1] = leaves[-1:] = False
    own = np.logical_or.reduceat(leaves, first) if len(at) else leaves
    return text[first], at[first], span, key[first], own, flat, place


def _batches(batches, names, most=2_000_000, column="raw"):
    """Lists of rows, as many as have about most bytes."""
    held, weight = [], 0
    for batch in pieces(batches):
        for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            held.append(row)
            weight += len(row[names.index(column)] or b"")
            if weight >= most:
                yield held
                held, weight = [], 0
    if held:
        yield held


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, rk, nb, raw): rk and nb name a row by 64 and 32 bits of two hashes of id and text and, in the upper half of nb,
    by its length, so that different rows have different names."""
    rows = texts(df, id_col, text_col).withColumn("raw", F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    name, second = F.col("doc_id").cast("string"), F.lit("second")
    nb = F.shiftleft(F.octet_length("raw").cast("long"), 32).bitwiseOR(F.xxhash64(second, name, "text").bitwiseAND(F.lit((1 << 32) - 1)))
    return rows.select("doc_id", F.xxhash64(name, "text").alias("rk"), nb.alias("nb"), "raw")


def remove_repeats(df: DataFrame, id_col="doc_id", text_col="text", length=200, k=32, block_bytes=4_000_000, with_text=False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with with_text, text (what is left; cut characters dropped)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    docs = _keyed(df, id_col, text_col)
    long = docs.where(F.octet_length("raw") >= length)

    def cut(batches):
        for rows in _batches(batches, ["rk", "nb", "raw"]):
            text, at, span, key, _, flat, place = contexts([r[2] for r in rows], length, k)
            digest = xxhash.xxh64_intdigest
            c = np.array([digest(flat[a : a + n]) for a, n in zip(at.tolist(), (span + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
            rk, nb = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict({"a": key.view(np.int64), "c": c, "rk": rk[text], "nb": nb[text], "s0": (at - place[text]).astype(np.int32), "span": span.astype(np.int32)})

    def keys(batches):
        """Keys with how often they occur, summed over a few MB of text before they are shuffled."""
        for rows in _batches(batches, ["raw"]):
            _, _, _, key, own, _, _ = contexts([r[0] for r in rows], length, k)
            key, back = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"a": key.view(np.int64), "m": np.bincount(back, own + 1).astype(np.int32)})

    counts = long.select("raw").mapInArrow(keys, "a long, m int")
    every = long.select("rk", "nb", "raw").mapInArrow(cut, "a long, c long, rk long, nb long, s0 int, span int")
    shared = counts.groupBy("a").agg(F.sum("m").alias("m")).where("m > 1").select("a")
    shared = written(every.join(shared, "a"), "contexts")

    different = shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("rk", "nb", "s0", "span")).alias("rep"))
    weight = shared.select("a", "c", "span").distinct().groupBy("a").agg(F.sum(F.col("span") + (length - 1)).alias("bytes"))
    heavy = written(weight.where(F.col("bytes") > block_bytes).select("a", F.lit(True).alias("heavy")), "heavy")
    has_heavy = heavy.count()  # few keys as a rule, none most often; the broadcast's size is checked
    if has_heavy:
        different = different.join(F.broadcast(heavy) if has_heavy <= 100_000 else heavy, "a", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    else:
        different = different.withColumn("heavy", F.lit(False))
    wanted = different.groupBy("rep.rk", "rep.nb").agg(F.collect_list(F.struct("a", "c", "n", F.col("rep.s0").alias("s0"), F.col("rep.span").alias("span"), "heavy")).alias("cuts"))

    block = StructType.fromDDL("a long, c long, n long, start int, w1 long, w2 long, raw binary")
    block_kinds = to_arrow_schema(block)

    def fetch(batches):
        out = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), block_kinds, strict=True)], schema=block_kinds)
            out.clear()
            return batch

        last = None
        for batch in pieces(batches):
            for *name, raw, cuts in zip(batch.column("rk").to_pylist(), batch.column("nb").to_pylist(), batch.column("raw"), batch.column("cuts"), strict=True):
                if name == last:  # the same row again: its strings were taken, with counts that know of all copies
                    continue
                last, raw = name, raw.as_py()
                for x in cuts.as_py():
                    a, c, n, s, e = x["a"], x["c"], x["n"], x["s0"], x["s0"] + x["span"]
                    if not x["heavy"]:
                        out.append((a, c, n, None, None, None, raw[s : e + length - 1]))
                    else:
                        for i in range(s, e):
                            h = xxhash.xxh3_128_intdigest(raw[i : i + length])
                            out.append((a, c, n, i - s, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), None))
                            if len(out) >= 20_000:
                                yield flush()
                    if len(out) >= 20_000:
                        yield flush()
        if out:
            yield flush()

    blocks = long.select("rk", "nb", "raw").join(wanted, ["rk", "nb"]).select("rk", "nb", "raw", "cuts").mapInArrow(fetch, block)
    if has_heavy:
        blocks = written(blocks, "blocks")

    flag_kinds = to_arrow_schema(StructType.fromDDL("a long, c long, runs array<struct<lo:int,hi:int>>"))

    def search(batches):
        def solve(rows):
            found = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
            rows = [(r[0], r[1], runs(x)) for r, x in zip(rows, found, strict=True) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), flag_kinds, strict=True)], schema=flag_kinds) if rows else None

        held, weight = [], 0
        for batch in pieces(batches):  # sorted by key; a block takes whole keys
            for row in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "n", "raw")), strict=True):
                if weight >= 1_000_000 and row[0] != held[-1][0]:
                    if got := solve(held):
                        yield got
                    held, weight = [], 0
                held.append(row)
                weight += len(row[3])
        if held and (got := solve(held)):
            yield got

    light = blocks.where("raw is not null").select("a", "c", "n", "raw").repartition("a").sortWithinPartitions("a")
    flags = light.mapInArrow(search, "a long, c long, runs array<struct<lo:int,hi:int>>")
    if has_heavy:
        alone = blocks.where("raw is null").select("a", "c", "n", "start", "w1", "w2")
        twice = alone.groupBy("w1", "w2").agg(F.sum("n").alias("m")).where("m > 1").select("w1", "w2")
        alone = alone.join(twice, ["w1", "w2"]).groupBy("a", "c").agg(F.collect_list("start").alias("starts"))
        flags = flags.unionByName(alone.select("a", "c", F.transform("starts", lambda s: F.struct(s.alias("lo"), s.alias("hi"))).alias("runs")))

    hits = shared.join(flags, ["a", "c"]).groupBy("rk", "nb").agg(F.collect_set(F.struct("s0", "runs")).alias("hits"))  # a set: rows that repeat have the same hits
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)])
    kinds = to_arrow_schema(out)

    def strike(batches):
        for batch in pieces(batches):
            rows = []
            for raw, found in zip(batch.column("raw"), batch.column("hits"), strict=True):
                raw, found = raw.as_py(), found.as_py()
                kept, removed, spans = raw, 0, 0
                if found:
                    cover = sorted((h["s0"] + r["lo"], h["s0"] + r["hi"] + length) for h in found for r in h["runs"])
                    parts, end, covered = [], 0, 0
                    for a, b in cover:
                        if a > covered or not spans:
                            parts.append(raw[end:a])
                            spans += 1
                            removed += b - a
                            covered = b
                        elif b > covered:
                            removed += b - covered
                            covered = b
                        end = covered
                    kept = b"".join(parts) + raw[end:]
                row = (len(raw), removed, spans, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(kinds[0].type)] + [pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), list(kinds)[1:], strict=True)], schema=kinds) if rows else pa.RecordBatch.from_pylist([], schema=kinds)

    return docs.join(hits, ["rk", "nb"], "left").select("doc_id", "raw", "hits").mapInArrow(strike, out)
