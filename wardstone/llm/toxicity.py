"""Toxicity: cumulative-link ordinal regression on sparse words.

P(grade <= j) = sigmoid(t_j - w.x) for ordered thresholds t_0 < t_1 < t_2, one w for all. The labels only say
toxic or not, so the toxic rows of the sample get their grade from their own words: words much more
frequent in toxic rows than in others are marked, and the rows fall into LEVELS grades, 1 upwards, at
the quantiles of the share of marked words. Rows that are not toxic have grade 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import texts
from wardstone.llm._labelled import sample
from wardstone.llm._store import without
from wardstone.llm.sparse_text import BARE, BUCKETS, Buckets

#: Labelled rows learnt from at the most.
SAMPLE = 12_000
LEVELS = 3
#: A word weighs if the number of toxic rows that hold it is this many standard deviations from what is to be
#: expected of a word so frequent; with a positive deviation it also counts as marked.
SURE, LEAST = 4.0, 4
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 1e-6
#: Beside words, their first bytes weigh, for languages that compound or inflect.
STEMS = (4, 5, 6, 7, 8, 10)
#: The least score of a toxic row is chosen among these by the scores that FOLDS folds of the learning rows
#: get from models of the others.
CUTS, FOLDS = np.arange(0.04, 0.97, 0.02), 3
#: Words whose buckets a worker keeps.
WORDS = 1 << 17


class Stemmed(dict):
    """Buckets of a word and its stems; emptied when full."""

    def __init__(self):
        super().__init__()
        self.buckets = Buckets()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = (self.buckets[word], *[self.buckets[b"%d-%b" % (k, word[:k])] for k in STEMS if len(word) >= k])
        return found


def presence(text: bytes, cache: Stemmed) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and stems and 1 + log of how often each occurs."""
    found = Counter(text.translate(BARE).lower().split())
    own = [cache[w] for w in found]
    ids = np.fromiter(chain.from_iterable(own), np.int32)
    ids, back = np.unique(ids, return_inverse=True)
    n = np.repeat(np.fromiter(found.values(), np.float64, len(found)), [len(x) for x in own])
    return ids, 1 + np.log(np.bincount(back, n, len(ids)))


def deviations(ids: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each bucket, as SURE has it; 0 for those in few rows."""
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    bad, all_ = np.bincount(ids, toxic[row] > 0, BUCKETS), np.bincount(ids, minlength=BUCKETS)
    share = min(max((toxic > 0).mean() if len(toxic) else 0.5, 1e-3), 1 - 1e-3)
    return np.where(all_ >= LEAST, (bad - all_ * share) / np.sqrt(np.maximum(all_, 1) * share * (1 - share)), 0)


def grades(ids: np.ndarray, x: np.ndarray, first: np.ndarray, toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    n = np.exp(x - 1)
    dense = np.bincount(row, n * marked[ids], len(toxic)) / np.maximum(1, np.bincount(row, n, len(toxic)))
    own = dense[toxic > 0]
    cuts = np.quantile(own, np.arange(1, LEVELS) / LEVELS) if len(own) else np.zeros(LEVELS - 1)
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, dense, "left"), 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(ids: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, weighs: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by AdaGrad on the likelihood; thresholds are a first one and logs of gaps."""
    rng = np.random.default_rng(seed)
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    a, ga = np.array([2.0, *[0.0] * (LEVELS - 1)]), np.full(LEVELS, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            size = first[rows + 1] - first[rows]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.repeat(first[rows] - starts, size) + np.arange(size.sum())
            doc = np.repeat(np.arange(len(rows)), size)
            live = weighs[ids[at]]
            own, value, doc = ids[at][live], x[at][live].astype(float), doc[live]
            margin = np.bincount(doc, w[own] * value, len(rows))
            t = np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))
            edges = np.concatenate([[-np.inf], t, [np.inf]])
            z_hi, z_lo = edges[y[rows] + 1] - margin, edges[y[rows]] - margin
            hi, lo = _sigmoid(z_hi), np.where(np.isinf(z_lo), 0.0, _sigmoid(z_lo))
            hi = np.where(np.isinf(z_hi), 1.0, hi)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p / len(rows), lo * (1 - lo) / p / len(rows)
            slope = d_hi - d_lo  # of -log p by the margin
            touched, back = np.unique(own, return_inverse=True)
            g = np.bincount(back, slope[doc] * value) + DECAY * w[touched] if len(own) else np.zeros(0)
            dt = np.bincount(y[rows], -d_hi, LEVELS + 1)[:LEVELS] + np.bincount(y[rows], d_lo, LEVELS + 1)[1:]
            da = np.cumsum(dt[::-1])[::-1] * np.concatenate([[1.0], np.exp(a[1:])])
            gw[touched] += g**2
            w[touched] -= RATE * g / np.sqrt(gw[touched])
            ga += da**2
            a -= RATE * da / np.sqrt(ga)
    return w, np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))


def some_rows(ids: np.ndarray, x: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of some rows."""
    size = first[rows + 1] - first[rows]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(first[rows] - ends[:-1], size) + np.arange(ends[-1])
    return ids[at], x[at], ends


def learn(ids: np.ndarray, x: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from rows that are toxic or not."""
    sure = deviations(ids, first, toxic)
    return fit(ids, x, first, grades(ids, x, first, toxic, sure > SURE), np.abs(sure) > SURE)


def choose_cut(ids: np.ndarray, x: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1 of the scores that each fold gets from the others; of equals the middle one.
    Without both kinds of rows one half."""
    if len(np.unique(toxic > 0)) < 2:
        return 0.5
    fold, score = np.random.default_rng(11).permutation(len(toxic)) % FOLDS, np.zeros(len(toxic))
    for k in range(FOLDS):
        rows, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, t = learn(*some_rows(ids, x, first, rows), toxic[rows])
        i, v, ends = some_rows(ids, x, first, own)
        margin = np.bincount(np.repeat(np.arange(len(own)), np.diff(ends)), w[i] * v, len(own))
        score[own] = 1 - _sigmoid(t[0] - margin)
    flagged = score[None, :] >= CUTS[:, None]
    hits, all_ = (flagged & (toxic > 0)).sum(1), flagged.sum(1) + (toxic > 0).sum()
    best = np.flatnonzero(hits / all_ >= (hits / all_).max() - 1e-9)
    return float(CUTS[best[len(best) // 2]])


def toxicity(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """``df`` with expected_severity (double), severity (its likeliest grade, int), score (probability of
    any grade above 0) and toxic (score of a cut or more that is chosen by folds of the learning rows).

    Null and empty texts have no words and get the thresholds' own probabilities. Rows are scored one
    by one; an empty table gives an empty one; columns with an added name are replaced, others pass.
    """
    out = ["expected_severity", "severity", "score", "toxic"]
    base = without(df, *out)
    learnt = sample(df, labels, label, usable, rows, presence, id_col, text_col, Stemmed)
    w, t = learn(*learnt)
    model = df.sparkSession.sparkContext.broadcast((w.astype(np.float32), t, choose_cut(*learnt)))
    schema = base.select("*", F.lit(0.0).alias(out[0]), F.lit(0).alias(out[1]), F.lit(0.0).alias(out[2]), F.lit(True).alias(out[3])).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Stemmed()
        w, t, cut = model.value
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                margin = np.array([float(w[i] @ v) if len(i) else 0.0 for i, v in (presence(x, cache) for x in texts(batch, text_col))])
                below = _sigmoid(t[None, :] - margin[:, None])
                each = np.diff(np.concatenate([np.zeros((len(margin), 1)), below, np.ones((len(margin), 1))], axis=1))
                score = 1 - below[:, 0]
                new = [pa.array(each @ np.arange(LEVELS + 1.0)), pa.array(each.argmax(1).astype(np.int32)), pa.array(score), pa.array(score >= cut)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *out])

    return base.mapInArrow(score, schema)
