"""Quality classifier: a factorisation machine on hashed words, structure statistics and length.

score = sigmoid(w.x + 1/2 sum over f of ((sum of v_if x_i)^2 - sum of v_if^2 x_i^2)): all pairs of
features weigh in, in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import texts
from wardstone.llm._labelled import sample
from wardstone.llm._store import without
from wardstone.llm.sparse_text import WIDTH, Buckets, joint_features

#: Labelled rows learnt from at the most.
SAMPLE = 12_000
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 6, 128, 0.1, 1e-5


def _margin(w: np.ndarray, v: np.ndarray, ids: np.ndarray, x: np.ndarray, first: np.ndarray):
    """Margins of rows that have one feature or more each, and their factor sums."""
    xv = v[ids] * x[:, None]
    sums = np.add.reduceat(xv, first, axis=0)
    squares = np.add.reduceat((xv**2).sum(1), first)
    return np.add.reduceat(w[ids] * x, first) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(ids: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and factors by AdaGrad on the logistic loss; all zero without rows."""
    if not len(y):
        return np.zeros(WIDTH), np.zeros((WIDTH, FACTORS))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, FACTORS))
    gw, gv = np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            rows = order[s : s + BATCH]
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            own, value = ids[at], x[at].astype(float)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            margin, sums = _margin(w, v, own, value, starts)
            slope = np.repeat((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows), size)
            touched, back = np.unique(own, return_inverse=True)
            g = np.bincount(back, slope * value) + DECAY * w[touched]
            each = (slope * value)[:, None] * (np.repeat(sums, size, axis=0) - v[own] * value[:, None])
            h = np.stack([np.bincount(back, each[:, f]) for f in range(FACTORS)], 1) + DECAY * v[touched]
            gw[touched] += g**2
            gv[touched] += h**2
            w[touched] -= RATE * g / np.sqrt(gw[touched])
            v[touched] -= RATE * h / np.sqrt(gv[touched])
    return w, v


def quality_scores(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """``df`` with score (0 to 1), learning from at most ``rows`` labelled rows that are ``usable``.

    The id only joins labels to texts and deals out the sample. Null and empty texts are scored by
    their statistics alone; rows are scored one by one; without any label every score is one half. An empty
    table gives an empty one; a column named score is replaced, others pass.
    """
    base = without(df, "score")
    ids, x, first, y = sample(df, labels, label, usable, rows, joint_features, id_col, text_col)
    w, v = fit(ids, x, first, y)
    model = df.sparkSession.sparkContext.broadcast((w.astype(np.float32), v.astype(np.float32)))
    schema = base.select("*", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for s in range(0, whole.num_rows, 128):
                batch = whole.slice(s, 128)
                found = [joint_features(t, buckets) for t in texts(batch, text_col)]
                starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])[:-1]])
                margin, _ = _margin(*model.value, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
                p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], names=[*batch.schema.names, "score"])

    return base.mapInArrow(score, schema)
