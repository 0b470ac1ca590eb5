"""Packing token sequences: bounded-space online best fit.

Each task keeps a fixed number of open windows.  A document's tokens are first
cut into full windows; what remains goes to the open window it fits best.  If
none fits, the fullest is topped up with the document's first tokens when its
gap is at least min_cut, emitted, and the rest goes on in a new window.  When a
task ends, its emptiest open windows are poured into the others; the one that
is left of each task is merged with those of up to `merge` tasks, best fit.

Every input token lands in exactly one piece; offsets in a sequence are
gapless from 0.  Only ids of pieces move, never token arrays.  Cases: null
and empty texts are documents of the end id alone; repeated rows and equal ids
are packed each for itself; a null doc_id stays null; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .bpe import KNOWN, splitter
from .common import pieces as slices, texts, written

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Open windows of (room left, pieces); add() yields what is finished."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.open: list[tuple[int, list]] = []

    def add(self, piece, n: int, cut):
        """piece goes in; cut(piece, k) splits it after k tokens (None: it may not be cut)."""
        best = min((i for i, (room, _) in enumerate(self.open) if room >= n), key=lambda i: self.open[i][0], default=None)
        if best is None and len(self.open) >= self.most:
            at = min(range(len(self.open)), key=lambda i: self.open[i][0])
            room, held = self.open.pop(at)
            if cut and room >= self.min_cut:
                head, piece = cut(piece, room)
                held.append(head)
                n -= room
            yield held
        if best is None:
            room, held = self.size, []
        else:
            room, held = self.open.pop(best)
        held.append(piece)
        if room == n:
            yield held
        else:
            self.open.append((room - n, held))


    def rest(self, cut):
        """(room, pieces) of the windows still open: the emptiest is poured into the gaps of the fullest, so one at most
        has a gap of min_cut or more."""
        left, self.open = sorted(self.open, key=lambda x: x[0]), []
        while left:
            room, held = left.pop(0)
            while room >= self.min_cut and left:
                _, given = left[-1]
                piece = given.pop()
                n = len(piece[2]) if hasattr(piece[2], "__len__") else piece[2]
                if n > room:
                    piece, tail = cut(piece, room)
                    given.append(tail)
                    n = room
                held.append(piece)
                room -= n
                if given:
                    left[-1] = (left[-1][0] + n, given)
                else:
                    left.pop()
            yield (0 if room < self.min_cut else room), held


class _Numbers(dict):
    """piece -> its number; pieces not seen before get the next one and wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Ids:
    """Texts -> arrays of ids, by a byte-level model of the tokenizers library.

    The text is split at the vocabulary's added tokens, which the library
    always takes for themselves, and between them by the pattern; the
    library's model encodes each different piece once.  What is known stays
    with the Python worker for its next tasks, up to KNOWN pieces.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.letters = Tokenizer.from_file(path), splitter(pattern), _byte_letters()
        self.model = self.tokenizer.model
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: added tokens that depend on their surroundings")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.flat, self.begin, self.count = _Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        if not self.at_added or not any(x in text for x in self.added):
            return self.split(text)
        return [p for i, part in enumerate(self.at_added(text)) for p in ([part] if i % 2 else self.split(part))]

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        tokens, letters, added = self.model.tokenize, self.letters, self.added
        ids = [[added[x]] if x in added else [t.id for t in tokens(x.encode("utf-8", "replace").decode("latin-1").translate(letters))] for x in new]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))])

    def encode(self, found: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > KNOWN:
            self._clear()
        at = [np.fromiter(map(self.numbers.__getitem__, self._pieces(x)), np.int64) if x else np.zeros(0, np.int64) for x in found]
        self._learn()
        out = []
        for pieces in at:
            count = self.count[pieces]
            end = np.cumsum(count)
            out.append(self.flat[np.repeat(self.begin[pieces] - end + count, count) + np.arange(end[-1] if len(end) else 0)])
        return out


_KEPT: dict[tuple[str, str], Ids] = {}


def tokenizer(path: str, pattern: str) -> Ids:
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = Ids(path, pattern)
    return _KEPT[path, pattern]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(df: DataFrame, tokenizer_path: str, pattern: str, id_col="doc_id", text_col="text", size=1024, end_id=0, windows=16, min_cut=16, merge=64) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    One pass over the texts; the pieces of windows left open at the end of a
    task (at most `windows` a task) are shuffled once, by groups of tasks.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = texts(df, id_col, text_col)
    out = StructType([rows.schema["doc_id"], *StructType.fromDDL(COLUMNS + ", part int, room int")])
    kinds = to_arrow_schema(out)

    def emit(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds) if done else pa.RecordBatch.from_pylist([], schema=kinds)

    def fill(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, encode, number = Packer(size, windows, min_cut), tokenizer(tokenizer_path, pattern).encode, part << 32

        def close(held, room):
            nonlocal number
            offset = 0
            for doc, begin, ids, total in held:
                yield doc, begin, len(ids), _crc(ids), total, number, offset, part, room
                offset += len(ids)
            number += 1

        def cut(piece, k):
            doc, begin, ids, total = piece
            return (doc, begin, ids[:k], total), (doc, begin + k, ids[k:], total)

        for batch in slices(batches, 500):
            done = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                total, at = len(ids), 0
                while total - at >= size:
                    done += close([(doc, at, ids[at : at + size], total)], 0)
                    at += size
                if at < total:
                    for held in packer.add((doc, at, ids[at:].copy(), total), total - at, cut):
                        done += close(held, 0)
            yield emit(done)
        done = []
        for room, held in packer.rest(cut):
            done += close(held, room)
        yield emit(done)

    def join(key, group: pa.Table) -> pa.Table:
        """Merges open windows of a group of tasks, largest first."""
        found: dict[int, list] = {}
        for r in group.to_pylist():
            found.setdefault(r["sequence_id"], []).append(r)
        packer, done = Packer(size, 1 << 30, size), []
        for held in sorted(found.values(), key=lambda x: (x[0]["room"], x[0]["sequence_id"])):
            held.sort(key=lambda r: r["offset"])
            done += packer.add(held, size - held[0]["room"], None)
        done += [held for _, held in packer.open]
        merged = []
        for sequence in done:
            offset, first = 0, sequence[0][0]["sequence_id"]
            for r in (r for held in sequence for r in held):
                merged.append(r | {"sequence_id": first, "offset": offset, "room": 0})
                offset += r["length"]
        return pa.Table.from_pylist(merged, schema=kinds)

    pieces = written(rows.mapInArrow(fill, out), "pack")
    late = pieces.where("room > 0").withColumn("near", (F.col("part") / merge).cast("int"))
    late = late.groupBy("near").applyInArrow(lambda key, t: join(key, t.drop_columns(["near"])), out)
    return pieces.where("room = 0").unionByName(late).drop("part", "room")
