"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of lower-cased words, each word set
between spaces.  A model is a pair of sorted hash arrays: n-grams with their
discounted share, contexts with the weight of the next lower order.  A text
gets the language of the lowest cross-entropy per character (ties: the first
language by name).  Rejection is calibrated: rows of the training part kept
out of the counts give each language's usual cross-entropy, and a text of n
characters is rejected beyond its language's greatest usual value plus a
margin plus slack / sqrt(n), for the mean of a few characters says less.

Cases: null texts and texts without a letter get "und", score 0 and are
rejected; rows with null language aren't learned from, nor texts beyond
`longest` characters (they are still judged, whole); with nothing to learn
from, everything is "und"; repeated rows repeat; equal cross-entropies go to
the first language by name.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, map_texts, smallest


_ALNUM = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters (general category L); re's classes also take fractions and Roman numerals, so such runs are split there."""
    found = _ALNUM(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


#: Most words a task remembers.
KNOWN = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(df: DataFrame, id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _windows(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the order characters that end at each letter or closing space, one row each; rows of each word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    pad = " " * (order - 1)
    flat = np.frombuffer("".join([pad + w + " " for w in words]).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(size + order - 1)[:-1]])
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return flat[at[:, None] + np.arange(order)], size


def _hashes(windows: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last 1, 2 ... characters of each row."""
    h, out = np.full(len(windows), 7, np.uint64), []
    for j in range(windows.shape[1] - 1, -1, -1):
        h = (h ^ (windows[:, j].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _context_hashes(windows: np.ndarray) -> list[np.ndarray]:
    """Of the same rows without their last character: no characters, one, two ..."""
    return [np.full(len(windows), 3, np.uint64), *_hashes(windows[:, :-1])]


class Model:
    """Interpolated Kneser-Ney over hashed n-grams."""

    def __init__(self, words: list[str], order: int, letters: int):
        windows, _ = _windows(words, order)
        grams, contexts = _hashes(windows), _context_hashes(windows)
        self.order, self.floor = order, 1.0 / letters
        self.grams, self.contexts = [], []
        for n in range(1, order + 1):
            key, at, count = np.unique(grams[n - 1], return_index=True, return_counts=True)
            if n < order:  # lower orders count the different characters before
                _, one = np.unique(grams[n], return_index=True)
                count = np.unique(grams[n - 1][one], return_counts=True)[1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            cut = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, group = np.unique(contexts[n - 1][at], return_inverse=True)
            total = np.bincount(group, count)
            self.grams.append((key, ((count - cut) / total[group]).astype(np.float32)))
            self.contexts.append((context, (cut * np.bincount(group) / total).astype(np.float32)))

    @staticmethod
    def _look(table, keys, missing):
        sorted_keys, values = table
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, values[at], np.float32(missing))

    def nats(self, grams, contexts) -> np.ndarray:
        p = np.full(len(grams[0]), self.floor, np.float64)
        for n in range(self.order):
            p = self._look(self.grams[n], grams[n], 0) + self._look(self.contexts[n], contexts[n], 1) * p
        return -np.log(p)


class Known(dict):
    """word -> row of nats (one column per language); words not seen before get the next row and wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new, self.nats = [], np.zeros(0)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def clear(self) -> None:
        super().clear()
        self.__init__()


class Identifier:
    """Models of all languages with the calibrated limits."""

    def __init__(self, order: int = 5, margin: float = 0.75, slack: float = 6.0, sharpness: float = 8.0):
        self.order, self.margin, self.slack, self.sharpness = order, margin, slack, sharpness
        self.names: list[str] = []
        self.models: list[Model] = []
        self.limits: list[float] = []

    def fit(self, rows: dict[str, list[str]]) -> Identifier:
        """rows: language -> texts; every fifth text calibrates."""
        words = {k: [[w.lower() for w in words_of(x or "")] for x in v] for k, v in sorted(rows.items())}
        words = {k: [x for x in v if x] for k, v in words.items()}
        words = {k: v for k, v in words.items() if v}
        learn = {k: [w for i, x in enumerate(v) if i % 5 or len(v) < 5 for w in x] for k, v in words.items()}
        letters = len({c for v in learn.values() for w in v for c in w}) + 2
        self.names = list(learn)
        self.models = [Model(v, self.order, letters) for v in learn.values()]
        for k, name in enumerate(self.names):
            check = [x for i, x in enumerate(words[name]) if not i % 5 or len(words[name]) < 5]
            found = [v.sum(0)[k] / n for x in check for v, n in [self.words_nats(x)]]
            self.limits.append(max(found) + self.margin)
        return self

    def words_nats(self, words: list[str]):
        """(nats of each word in each language, characters of all)."""
        out = np.zeros((len(words), len(self.models)))
        for begin in range(0, len(words), 50_000):
            part = words[begin : begin + 50_000]
            windows, size = _windows(part, self.order)
            grams, contexts = _hashes(windows), _context_hashes(windows)
            _, one, back = np.unique(grams[-1], return_index=True, return_inverse=True)
            grams, contexts = [x[one] for x in grams], [x[one] for x in contexts]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            for k, m in enumerate(self.models):
                out[begin : begin + len(part), k] = np.add.reduceat(m.nats(grams, contexts)[back], start)
        return out, sum(map(len, words)) + len(words)

    def judge(self, found: list[str | None], known: Known) -> list[tuple]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.names:
            return [("und", 0.0, None, True)] * len(found)
        if len(known) > KNOWN:
            known.clear()
        parts = [words_of(x.lower()) if x else [] for x in found]
        rows = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in parts]
        if known.new:
            known.nats = np.concatenate([known.nats.reshape(-1, len(self.names)), self.words_nats(known.new)[0]])
            known.new = []
        out = []
        for words, at in zip(parts, rows, strict=True):
            if not words:
                out.append(("und", 0.0, None, True))
                continue
            n = sum(map(len, words)) + len(words)
            total = known.nats[at].sum(0) / n
            best = int(total.argmin())
            score = 1 / np.exp(self.sharpness * (total[best] - total)).sum()
            out.append((self.names[best], float(score), float(total[best]), bool(total[best] > self.limits[best] + self.slack / n**0.5)))
        return out


def fit_languages(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", texts_per_language=400, longest=200_000, order=5, **kinds) -> Identifier:
    """Fit on at most texts_per_language texts of each language, those of the smallest id hash, none beyond longest characters."""
    known = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    known = known.where(F.length("text") <= longest).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 63) - 1)))
    pick = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    some = smallest(known, "lang", texts_per_language).withColumn("k", F.row_number().over(pick)).where(F.col("k") <= texts_per_language)
    by: dict[str, list] = {}
    for r in sorted(some.select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        by.setdefault(r["lang"], []).append(r["text"])
    model = Identifier(order, **kinds).fit(by)
    del by
    give_back()  # the driver goes on for long after
    return model


def identify_languages(df: DataFrame, model: Identifier, id_col="doc_id", text_col="text", keep_text=False) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected; one pass, no shuffle.

    The model (a few MB per language) is a broadcast variable: its size is
    bound by texts_per_language, not by the corpus.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        known = Known()
        return lambda found: sent.value.judge(found, known)

    return map_texts(df, id_col, text_col, start, "lang_pred string, score double, cross_entropy double, rejected boolean", keep_text)
