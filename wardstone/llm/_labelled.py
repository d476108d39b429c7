"""A bounded sample of labelled rows as features on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import texts
from wardstone.llm.sparse_text import Buckets


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, features, id_col: str = "doc_id", text_col: str = "text", cache=Buckets):
    """(ids, values, first entry of each row, labels): features of at most ``rows`` rows that have a label
    and are ``usable``, those of the least hash of their id. ``features`` takes (text, cache).
    Of several rows with one id the one of the least hash of its text is taken, so ``rows`` bounds the rows too."""
    chosen = labels.where(usable & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows)
    texts_ = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    own = texts_.join(F.broadcast(chosen), F.col("id_") == F.col(id_col)).select("id_", "y", "text_")
    own = own.groupBy("id_").agg(F.min(F.struct(F.xxhash64("text_"), "y", "text_")).alias("one_")).select("id_", "one_.y", "one_.text_")

    def extract(batches):
        held = cache()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t, held) for t in texts(part, "text_")]
                columns = [part.column("id_").cast(pa.string()), part.column("y"), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "at", "x"])

    got = own.mapInArrow(extract, "id string, y int, at binary, x binary").toArrow().sort_by("id")
    ids = [np.frombuffer(b, np.int32) for b in got.column("at").to_pylist()]
    values = [np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *ids]), np.concatenate([none.astype(np.float32), *values]), first, np.array(got.column("y").to_pylist(), np.int64)
