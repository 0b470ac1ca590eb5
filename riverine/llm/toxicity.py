"""Toxicity by multiple-instance learning.

A document is a bag of sentences; sentence i is toxic with probability p_i, a
logistic function of its different words and their first letters, and the
document with 1 - prod(1 - p_i) (noisy-or).  Only document labels are used for training, yet the sentence
probabilities tell where the offence is.

Training takes a bounded sample (max_docs labelled rows, half of each label as
far as there are, those of the smallest id hash and of at most `longest`
characters; equal texts count once, those with both labels not at all); its
vocabulary is the features of at least min_share of these texts, and shrinking
(soft thresholds) leaves a small dict of weights.

Cases: null and empty texts have no sentence: score 0, no offending sentence;
rows with a null label aren't learned from, nor are ids with both labels;
without both labels (an empty table too) all scores are 0; repeated rows
repeat; every text is scored whole, whatever its length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, map_texts, smallest, written

SENTENCES = re.compile(r"[.!?\n]+").split
WORDS = re.compile(r"\w+").findall
_LOW = 1e-12
#: Most words whose weight a task remembers.
KNOWN = 400_000


def features(word: str) -> tuple[str, ...]:
    """A word counts as itself and by its first four and five letters (inflections, compounds)."""
    return (word, word[:4] + "*", word[:5] + "*")


def bags(text: str | None) -> list[tuple[int, list[str]]]:
    """(number of the sentence, its words) of each sentence that has any."""
    return [(i, w) for i, x in enumerate(SENTENCES((text or "").lower())) if (w := WORDS(x))]


#: Log odds of the score from which a document counts as toxic.
_LOG_ODDS = float(np.log(0.7 / 0.3))


def _log_odds(log_none):
    """Log odds of 1 - exp(log_none)."""
    return np.log(np.maximum(np.expm1(np.clip(-log_none, 1e-12, 500)), 1e-12))


def _parting(odds, y, share) -> float:
    """The middle of the widest gap among the best thresholds by weighted errors."""
    order = np.argsort(odds)
    odds, y, share = odds[order], y[order], share[order]
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, share, 0))]) + np.concatenate([np.cumsum(np.where(y == 0, share, 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[odds[0] - 1], odds, [odds[-1] + 1]])
    width = np.where(wrong <= wrong.min() + 1e-12, np.diff(edges), -1)
    k = int(width.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


class NoisyOr:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias = -30.0
        #: Added to a document's log odds, so that 0.7 is where the training documents part best.
        self.shift = 0.0

    def fit(self, found: list[str], labels: list[int], min_share=0.004, rounds=120, step=0.3, shrink=3e-3, clean_weight=0.9) -> NoisyOr:
        if len(set(labels)) < 2:
            return self
        ids: dict[str, int] = {}
        words, size, n_sent, y = [], [], [], []
        by_text: dict[str, set] = {}
        for text, label in zip(found, labels, strict=True):
            by_text.setdefault(text, set()).add(label)
        for text, (label, *both) in by_text.items():
            if both:
                continue
            if sentences := [set(x) for _, x in bags(text)]:
                words.append(np.fromiter((ids.setdefault(w, len(ids)) for x in sentences for w in sorted(x)), np.int32))
                size += map(len, sentences)
                n_sent.append(len(sentences))
                y.append(label)
        if len(set(y)) < 2:
            return self
        number: dict[str, int] = {}
        parts = np.array([[number.setdefault(f, len(number)) for f in features(w)] for w in ids], np.int32)
        del ids
        times = np.zeros(len(number), np.int64)
        for d in words:
            times[np.unique(parts[np.unique(d)])] += 1
        keep = times >= max(3, min_share * len(words))
        names, parts = np.array(list(number))[keep], np.where(keep[parts], (np.cumsum(keep) - 1)[parts], -1).astype(np.int32)
        del number
        y, n_sent, n = np.array(y, float), np.array(n_sent), len(size)
        start, doc = np.concatenate([[0], np.cumsum(n_sent)[:-1]]), np.repeat(np.arange(len(y)), n_sent)
        found, cells, at = [], [], 0
        for d, m in zip(words, n_sent, strict=True):  # a document at a time: few words have a feature that stays
            word = parts[d]
            cells.append(np.repeat(np.arange(at, at + m, dtype=np.int32), size[at : at + m])[np.nonzero(word >= 0)[0]])
            found.append(word[word >= 0])
            at += m
        word, sentence = np.concatenate(found), np.concatenate(cells)
        del words, found, cells, parts
        share = np.where(y == 1, (1 - clean_weight) / max(1, y.sum()), clean_weight / max(1, (1 - y).sum()))
        w, b = np.zeros(len(names)), -4.0
        first, second, first_b, second_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, rounds + 1):  # Adam on the label likelihood, then shrinking towards 0
            z = b + np.bincount(sentence, w[word], n)
            log_not = -np.logaddexp(0, z)
            p = 1 - np.exp(log_not)
            none = np.exp(np.add.reduceat(log_not, start))
            push = np.where(y == 1, none / np.maximum(1 - none, _LOW), -1.0) * share
            g = push[doc] * p
            gw, gb = np.bincount(word, g[sentence], len(names)), g.sum()
            first, second = 0.9 * first + 0.1 * gw, 0.99 * second + 0.01 * gw * gw
            first_b, second_b = 0.9 * first_b + 0.1 * gb, 0.99 * second_b + 0.01 * gb * gb
            a = step / (1 + t / 40)
            w = w + a * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-5)
            b += a * (first_b / (1 - 0.9**t)) / (np.sqrt(second_b / (1 - 0.99**t)) + 1e-5)
            w = np.sign(w) * np.maximum(np.abs(w) - shrink * t**0.5, 0)
        self.shift = float(np.clip(_LOG_ODDS - _parting(_log_odds(np.add.reduceat(-np.logaddexp(0, b + np.bincount(sentence, w[word], n)), start)), y, share), -4, 1))
        self.weights, self.bias = {str(names[i]): float(w[i]) for i in np.flatnonzero(w)}, float(b)
        return self

    def judge(self, text: str | None, known: dict[str, float]) -> tuple:
        """(score, number of the most toxic sentence, its probability, numbers of sentences of at least 0.5)."""
        if not self.weights:
            return 0.0, None, None, []
        if len(known) > KNOWN:
            known.clear()
        get, none, best, best_p, bad = self.weights.get, 0.0, None, -1.0, []
        found = bags(text)
        for w in {w for _, words in found for w in words}:
            if w not in known:
                known[w] = sum([get(f, 0.0) for f in features(w)])
        for i, words in found:
            z = self.bias + sum([known[w] for w in set(words)])
            none -= float(np.logaddexp(0, z)) if z > -30 else 0.0
            p = 1 / (1 + np.exp(-z)) if z > -700 else 0.0
            if p > best_p:
                best, best_p = i, float(p)
            if p >= 0.5:
                bad.append(i)
        score = 0.0 if best is None else 1 / (1 + np.exp(-(_log_odds(none) + self.shift)))
        return float(score), best, None if best is None else best_p, bad


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_docs=4000, longest=200_000, **kinds) -> NoisyOr:
    """Fit on at most max_docs of docs (the rows that may be learned from) that labels has a label for.

    The sample is drawn on ids alone, so no text is shuffled; its ids (at most
    max_docs rows) are then broadcast to the scan that fetches the texts.
    """
    ids = docs.where(F.length(text_col) <= longest).select(F.col(id_col).alias("id")).distinct()
    one_label = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"), F.max(F.col(label_col).cast("int")).alias("other")).where("y = other").drop("other")
    rows = ids.join(one_label, "id").withColumn("h", F.xxhash64(F.col("id").cast("string")).bitwiseAND(F.lit((1 << 63) - 1)))
    rows = written(rows, "labelled")  # counted and drawn from: three numbers a labelled document
    pick = Window.partitionBy("y").orderBy("h", "id")
    sample = smallest(rows, "y", max_docs // 2).withColumn("k", F.row_number().over(pick)).where(F.col("k") <= max_docs // 2).select("id", "y", "h")
    fetched = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").where(F.length("text") <= longest).limit(2 * max_docs)
    found = sorted((r["h"], str(r["id"]), r["text"], r["y"]) for r in fetched.collect())
    model = NoisyOr().fit([x[2] for x in found], [x[3] for x in found], **kinds)
    del found
    give_back()  # the driver goes on for long after
    return model


def score_toxicity(df: DataFrame, model: NoisyOr, id_col="doc_id", text_col="text", threshold=0.7) -> DataFrame:
    """doc_id, score, predicted, worst_sentence, worst_p, offending (sentence numbers); one pass, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m, known = sent.value, {}

        def judge(found):
            return [(x[0], int(x[0] >= threshold), *x[1:]) for x in (m.judge(text, known) for text in found)]

        return judge

    return map_texts(df, id_col, text_col, start, "score double, predicted int, worst_sentence int, worst_p double, offending array<int>")
