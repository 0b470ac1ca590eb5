"""SimHash near-duplicates through an inverted index of positional bytes.

A 64-bit fingerprint is eight bytes at eight positions.  Fingerprints that
differ in at most three bits agree in at least five positions; among any two
halves of four positions one then has three that agree.  So the index has a
posting list for each value of each three positions of a half (eight lists a
fingerprint, 24 bits of key), and every pair to find meets in one of them.  In
a list, the bytes that a pair shares are tallied, pairs that reach the
guaranteed five are retained, and their differing bits are counted.

Only different fingerprints enter the index (copies are one row with a
count).  A list yields a spanning forest of its links and not all its pairs,
so a group of thousands of near copies costs as many edges as it has members.
Lists longer than `longest` are spread over the lists of five positions
(ten for each long one, 40 bits of key); a pair to find agrees in five.  Lists
that are still long are searched by trying the 2,324 ways to change up to
three of the 24 bits left, so work stays linear in the list.

Cases: null and empty texts have fingerprint 0 and are linked like others;
repeated rows share a component; a null doc_id takes part, and the component's
id is the smallest non-null one; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, written
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
TRIPLES = [(*c,) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
FIVES = [(*c,) for c in combinations(range(8), 5)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of the word shingles of a text."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    begin = end + 1 - size
    n = max(1, len(words) - width + 1)
    spans = zip(begin[:n].tolist(), end[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    times = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        times += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * times > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col="doc_id", text_col="text", width=3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def start():
        return lambda found: [((x ^ (1 << 63)) - (1 << 63),) for x in (fingerprint(t, width) for t in found)]

    return map_texts(df, id_col, text_col, start, "fp long")


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i with j in root (least member of each set), in place."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def linked(fps: np.ndarray, free: int, bits: int = 3, dense: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links within one posting list.

    free: mask of the bits in which members may differ.
    """
    fps = np.unique(fps)
    n = len(fps)
    root = np.arange(n)
    if n > dense and free.bit_count() <= 24:
        places = [1 << b for b in range(64) if free >> b & 1]
        for k in range(1, bits + 1):
            for change in combinations(places, k):
                other = fps ^ np.uint64(sum(change))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                i = np.flatnonzero((fps[at] == other) & (other > fps))
                _roots(root, i, at[i])
    else:
        for at in range(0, n, step := max(1, (1 << 20) // n)):
            apart = fps[at : at + step, None] ^ fps[None, :]
            tally = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(-1)  # bytes shared
            i, j = np.nonzero((tally >= 8 - bits) & np.triu(np.ones(apart.shape, bool), at + 1))
            keep = np.bitwise_count(apart[i, j]) <= bits
            _roots(root, i[keep] + at, j[keep])
    moved = np.flatnonzero(root != np.arange(n))
    signed = fps.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[root[moved]].tolist(), strict=True))


def _links(posted: DataFrame, groups: list[tuple[int, ...]], shift: int, bits: int, longest: int) -> DataFrame:
    """Links (a, b) within posting lists; posted: (key, fp), key >> shift the number of its group of positions."""
    import pyarrow as pa

    masks = [((1 << 64) - 1) ^ sum(255 << 8 * p for p in g) for g in groups]
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def solve(key, fp):
            found = []
            cut = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                if b - a > 1:
                    found += linked(fp[a:b].view(np.uint64), masks[int(key[a]) >> shift], bits, longest)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=kinds)

        for batch in batches:  # sorted by key: all lists but the last of a batch are complete
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield solve(key[:whole], fp[:whole])
            held_key, held_fp = key[whole:].copy(), fp[whole:].copy()
        if len(held_key):
            yield solve(held_key, held_fp)

    return posted.sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _key(number: int, positions: tuple[int, ...]):
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8) + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    return key if len(positions) == 5 else F.shiftleft(F.lit(number).cast("long"), 56) + F.pmod(key, F.lit(1 << 24))


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", width=3, bits=3, longest=4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    docs = written(fingerprints(df, id_col, text_col, width), "simhash")
    each = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    posted = each.select("fp", F.explode(F.array(*[_key(i, t) for i, t in enumerate(TRIPLES)])).alias("key"))
    size = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = written(posted.join(size, "key"), "simhash-index")
    short = posted.where(F.col("n") <= longest).select("key", "fp")
    links = _links(short.repartition("key"), TRIPLES, 56, bits, longest)
    long = posted.where(F.col("n") > longest)
    number = {g: i for i, g in enumerate(FIVES)}
    fives = F.array(*[F.array(*[_key(number[g], g) for g in FIVES if set(t) <= set(g)]) for t in TRIPLES])
    finer = long.select("fp", F.explode(fives[F.shiftrightunsigned("key", 56).cast("int")]).alias("key")).distinct()
    links = links.unionByName(_links(finer.select("key", "fp").repartition("key"), FIVES, 40, bits, longest))
    roots = components(links)
    each = each.join(roots, each.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = each.groupBy("root").agg(F.min("first").alias("component_id"))
    named = each.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
