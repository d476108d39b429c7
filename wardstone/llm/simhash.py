"""SimHash near-dedup: fingerprints of word shingles, linked through pivot distance tables.

A pivot table holds each fingerprint's Hamming distances to many reference fingerprints. By the
triangle inequality two fingerprints within ``reach`` bits differ by at most ``reach`` in every
coordinate, so a larger difference in any of them discards the pair; what is left is compared exactly.

Distances over all 64 bits lie close together, so they discard pairs well but cannot deal rows out to
tasks. For that the table also has the distances over blocks of the bits, as they are before they are
summed. Two fingerprints within ``reach`` bits agree wholly in all but ``reach`` blocks, so there all
their block coordinates are equal, and rows meet by those: an equality join instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import slices
from wardstone.llm._skew import HOT, spread_join
from wardstone.llm._store import cut, fresh
from wardstone.llm.components import components

REACH = 3
PIVOTS = 24
#: Up to so many different fingerprints four blocks do, of which one agrees; beyond, six, of which three agree.
FEW = 1 << 24
#: Most rows of a bucket that meet in one task; a larger bucket is cut into tiles, and pairs of tiles meet.
TILE = 4096
#: Buckets up to this size are compared in bulk, by position.
SMALL = 32


def _splitmix(n: int, seed: int = 7) -> list[int]:
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


REFERENCES = _splitmix(PIVOTS)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    own = text.lower().split()
    if len(own) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(own), 42)] if own else []
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(own) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; no words: zero."""
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if None) and the fingerprint as a signed 64-bit integer."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(out)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col):
                raw, at = data.tobytes(), offsets.tolist()
                prints = np.fromiter((fingerprint(raw[a:b], size) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(prints.view(np.int64))], names=[*keep, out])

    return source.mapInArrow(add, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, count: int) -> Column:
    """A row for each way to choose the blocks that agree: a hash of which they are and of all
    their coordinates."""
    blocks, agree = (4, 1) if count <= FEW else (6, 3)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    rows = [F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(m)))) for p in REFERENCES]) for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), *[rows[i] for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), agree))])


def _distances(prints: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each reference."""
    return np.stack([np.bitwise_count(prints ^ np.uint64(p)) for p in REFERENCES]).astype(np.int8)


def _close(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, reach: int) -> np.ndarray:
    """Which pairs a[i], b[i] are within reach."""
    left = np.arange(len(a))
    for x, y in zip(table_a, table_b, strict=True):
        left = left[np.abs(x[left] - y[left]) <= reach]
        if len(left) < 64:
            break
    return left[np.bitwise_count(a[left] ^ b[left]) <= reach]


def _forest(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within one bucket, found breadth first: rows leave the
    rest as they are reached, so no list of pairs is made."""
    table = _distances(prints)
    rest = np.arange(len(prints))
    heads, tails = [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found, by = np.zeros(len(rest), bool), np.zeros(len(rest), np.int64)
            for x in front.tolist():
                open_ = np.flatnonzero(~found)
                for row in table:
                    open_ = open_[np.abs(row[rest[open_]] - row[x]) <= reach]
                open_ = open_[np.bitwise_count(prints[rest[open_]] ^ prints[x]) <= reach]
                found[open_], by[open_] = True, x
                if found.all():
                    break
            heads.append(by[found])
            tails.append(rest[found])
            front, rest = rest[found], rest[~found]
    none = np.zeros(0, np.int64)
    return prints[np.concatenate([none, *heads])], prints[np.concatenate([none, *tails])]


def _linker(reach: int):
    """Links within each run of equal (key, a, b); the rows come sorted by them."""

    def bulk(key: np.ndarray, prints: np.ndarray, ends: np.ndarray):
        sizes = np.diff(np.concatenate([[0], ends]))
        small = np.repeat(sizes <= SMALL, sizes)
        k, p = np.repeat(np.arange(len(sizes)), sizes)[small], prints[small]
        table = _distances(p)
        for lag in range(1, min(SMALL, int(sizes.max(initial=0)))):
            pair = np.flatnonzero(k[:-lag] == k[lag:])
            if not len(pair):
                break
            hit = pair[_close(p[pair], p[pair + lag], table[:, pair], table[:, pair + lag], reach)]
            yield p[hit], p[hit + lag]
        for end, size in zip(ends[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            yield _forest(prints[end - size : end], reach)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        done = False
        source = iter(batches)
        while not done:
            batch = next(source, None)
            done = batch is None
            if not done:
                held = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])], axis=1)
                if held.shape[1] < 4 * TILE:
                    continue
            if not held.shape[1]:
                continue
            change = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(0)) + 1
            stop = held.shape[1] if done else int(change[-1]) if len(change) else 0
            ends = np.concatenate([change[change < stop], [stop]]) if stop else change[:0]
            for u, v in bulk(held[0, :stop], held[3, :stop].view(np.uint64), ends) if stop else ():
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
            held = held[:, stop:].copy()

    return link


def links(prints: DataFrame, fp: str, reach: int = REACH, tile: int = TILE) -> DataFrame:
    """Links (u, v) between different values of ``fp`` (distinct there), enough to connect all that are within
    ``reach`` bits: every link of small buckets, a spanning forest of large ones."""
    count = prints.count()
    rows = prints.select(F.col(fp).alias("fp"), F.explode(_keys(F.col(fp), count)).alias("key"))
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    met = rows.join(size, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    met = met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return met.mapInArrow(_linker(reach), "u bigint, v bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = REACH, hot: int = HOT) -> DataFrame:
    """``df``'s ids with fingerprint (16 hex digits) and component_id, the smallest id reachable over
    fingerprints within ``reach`` bits, the row's own id included.

    Texts with equal fingerprints are linked without being paired: only different fingerprints meet. The rows
    of a fingerprint with more than ``hot`` of them get their component in several tasks.
    Null and empty texts have fingerprint zero and are linked like any other; repeated rows give
    repeated rows; a null id is never a component's id unless the component has no other; an empty
    table gives an empty one.
    """
    hashed = cut(with_fingerprint(df, text_col, "fp_", size, keep=[id_col]), "fingerprints")
    prints = hashed.groupBy("fp_").agg(F.min(id_col).alias("first_"), F.count("*").alias("n_"))
    stars = components(links(prints.select("fp_"), "fp_", reach))
    labelled = prints.join(stars, prints["fp_"] == stars["node"], "left").select("fp_", "first_", F.coalesce("root", "fp_").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("first_").alias("component_id"))
    final = labelled.join(roots, "root").select("fp_", "component_id")
    return spread_join(hashed, final, ["fp_"], prints, "n_", id_col, hot=hot).select(id_col, F.lower(F.lpad(F.hex("fp_"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = REACH) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest id (rows with a null id
    stay only where their group has no other id; of rows with equal ids in a group one stays).

    Where ids are null or repeated, rows are numbered in a table written first and told by that."""
    key, row, best = fresh(df, "keep_id", "row_number", "best_row")
    all_, unlike = df.agg(F.count("*"), F.count_distinct(id_col)).first()
    if all_ == unlike:
        found = near_duplicates(df.select(id_col, text_col), id_col, text_col, size, reach)
        keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(key))
        return df.join(keep, F.col(id_col) == F.col(key), "left_semi")
    rows = cut(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(row, text_col), row, text_col, size, reach).select(row, "component_id")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row).alias(best))
    keep = found.join(rows.select(row, id_col), row).groupBy("component_id").agg(F.min(order)[best].alias(key))
    return rows.join(keep, F.col(row) == F.col(key), "left_semi").drop(row)
