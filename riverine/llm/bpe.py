"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the tokenizer's pattern; a piece's ids don't depend on its
neighbours, so each different piece of a task is encoded once.  Pieces not yet
known are put into buckets of similar byte length, one padded int matrix each.
In every round each row merges its leftmost pair of minimum rank: pair ranks
come from an open-addressing hash table, only the two pairs beside a merge are
looked up again, the row is compacted by one place, and finished rows leave.
Pieces beyond LONG bytes (a run of thousands of letters) would make wide, slow
matrices; they follow the same merge order with a heap and a linked list.

Cases: null and empty texts have no ids (digests of the empty string);
repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

LONG = 256
#: Most pieces a task remembers; then it starts afresh, so memory is bounded.
KNOWN = 400_000

#: For texts of these characters only, where re and regex classes agree.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7eÀ-ɏ]*")
#: The GPT-2 splitting pattern, with re's classes for letters and digits.
_QUICK = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def splitter(pattern: str):
    """text -> list of pieces, by the pattern; plain Latin texts by re."""
    exact = regex.compile(pattern).findall
    quick = _QUICK.findall if pattern.count(r"\p{L}") == 2 and pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d|") else None

    def split(text: str) -> list[str]:
        return quick(text) if quick and _PLAIN.fullmatch(text) else exact(text)

    return split


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> rank of their concatenation, hashed with linear probing."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.width = np.int64(max(ranks.values(), default=0) + 1)
        found = np.array(pairs, np.int64).reshape(-1, 3)
        keys = found[:, 0] * self.width + found[:, 1]
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each round one of the keys that meet at a free slot stays
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            stays = self.keys[at] == keys[left]
            self.ranks[at[stays]] = found[left[stays], 2]
            left, at = left[~stays], (at[~stays] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a, b):
        """Ranks of the pairs; NONE where either id is negative or no token is made."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a * self.width + b)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], self.NONE)
        more = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0) & (keys >= 0))
        slot = at[more]
        while len(more):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot]
            hit = here == keys[more]
            out[more[hit]] = self.ranks[slot[hit]]
            on = ~hit & (here >= 0)
            more, slot = more[on], slot[on]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.token = {r: x for x, r in ranks.items()}

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            if len(x) > LONG:
                out[i] = self._long(x)
            else:
                buckets.setdefault(max(4, (len(x) + 3) // 4 * 4), []).append(i)
        for width, rows in sorted(buckets.items()):
            for start in range(0, len(rows), step := max(1, 2_000_000 // width)):
                part = rows[start : start + step]
                for i, ids in zip(part, self._bucket([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _bucket(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list = [None] * len(pieces)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.of_byte[flat], -1)
        near = np.full(ids.shape, PairTable.NONE)  # near[:, j]: the rank of the pair (j, j + 1)
        near[:, :-1] = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        who = np.arange(len(pieces))
        while len(who):
            at = near.argmin(axis=1)  # the first of equals is the leftmost
            row = np.arange(len(who))
            rank = near[row, at]
            over = rank == PairTable.NONE
            for k in np.flatnonzero(over):
                done[who[k]] = ids[k, : size[k]].copy()
            if over.any():
                ids, near, size, who, at, rank = (x[~over] for x in (ids, near, size, who, at, rank))
                if not len(who):
                    break
                row = np.arange(len(who))
            ids[row, at] = rank
            source = column + (column > at[:, None])  # compaction: all beyond the merge move one place left
            last = source == width
            source[last] = width - 1
            ids = np.take_along_axis(ids, source, 1)
            near = np.take_along_axis(near, source, 1)
            ids[last], near[last] = -1, PairTable.NONE
            size = size - 1
            nxt = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            near[row, at] = self.pairs.look(rank, nxt)
            before = at > 0
            near[row[before], at[before] - 1] = self.pairs.look(ids[row[before], at[before] - 1], rank[before])
        return done

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pairs.look(ids[:-1], ids[1:])
        heap = [(int(first[i]), i) for i in np.flatnonzero(first < PairTable.NONE)]
        heapq.heapify(heap)
        ids, right, left = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = first.tolist() + [int(PairTable.NONE)]
        one = lambda a, b: int(self.pairs.look(np.array([a]), np.array([b]))[0])
        known: dict = {}

        def set_rank(i: int) -> None:
            j = right[i]
            rank = int(PairTable.NONE)
            if j < n:
                pair = (ids[i], ids[j])
                if (rank := known.get(pair)) is None:
                    rank = known[pair] = one(*pair)
            rank_at[i] = rank
            if rank < PairTable.NONE:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at[i] != rank:
                continue
            j = right[i]
            ids[i], rank_at[j], ids[j] = rank, -1, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            set_rank(i)
            if left[i] >= 0:
                set_rank(left[i])
        return np.array([x for x in ids if x >= 0], np.int64)


def bpe_roundtrip(df: DataFrame, ranks_path: str, pattern: str, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the
    decoded bytes are the text's) and, with with_ids, ids array<int>.  The
    vocabulary is read from ranks_path by each task.
    """

    def start():
        ranks = load_ranks(ranks_path)
        encoder, split = Encoder(ranks), splitter(pattern)
        known: dict[str, tuple[int, bytes, bytes]] = {}

        def judge(found):
            rows = []
            for begin in range(0, len(found), 2000):
                part = [split(x) if x else [] for x in found[begin : begin + 2000]]
                if len(known) > KNOWN:
                    known.clear()
                new = list({x for pieces in part for x in pieces if x not in known})
                for piece, ids in zip(new, encoder.encode([x.encode("utf-8", "replace") for x in new]), strict=True):
                    ids = ids.tolist()
                    known[piece] = (len(ids), (" %d" * len(ids) % tuple(ids)).encode(), b"".join(map(encoder.token.__getitem__, ids)))
                for text, pieces in zip(found[begin : begin + 2000], part, strict=True):
                    got = [known[x] for x in pieces]
                    ids = b"".join([x[1] for x in got])[1:]
                    decoded = b"".join([x[2] for x in got])
                    row = (sum([x[0] for x in got]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == (text or "").encode("utf-8", "replace"))
                    rows.append((*row, list(map(int, ids.split()))) if with_ids else row)
            return rows

        return judge

    return map_texts(df, id_col, text_col, start, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
