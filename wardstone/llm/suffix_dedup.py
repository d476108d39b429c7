"""Suffix-array dedup: bytes covered by a string of ``span`` bytes that starts twice or more.

Every place where such a string could start is a window of ``span`` bytes. Windows are first grouped by
their least hash of GRAM bytes: equal windows have the same one, and neighbouring windows mostly share
it, so a text falls into segments, runs of windows with one key. Only segments whose key occurs in
more than one segment, or more than once in its own, can hold a repeat; a filter of bounded size says which.
Their texts meet by key, equal texts once with their number, and each shard's texts, end to end, get a
suffix array by induced sorting and from it the permuted common prefixes, which decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import slices
from wardstone.llm._store import cut, fresh, without
from wardstone.llm.induced_sort import common_prefixes, suffix_array

SPAN = 200
GRAM = 48
#: Most windows in a segment; a longer run, as in periodic text, is cut with no window lost.
RUN = 2048
#: A key with more segments than this is split by the least hash of REFINED bytes of each window.
HOT, REFINED = 20_000, 150
#: Bits of the filter that tells which keys occur twice: eight to sixteen a key, up to this many in all.
FILTER_BITS = 1 << 29
#: Text bytes of a shard that meet in one suffix array.
SHARD = 1 << 20

_MULTIPLIER = 0xD6E8FEB86659FD93


def _hash_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64)


_TABLES = {GRAM: _hash_table(11), REFINED: _hash_table(12)}


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n and their inverses mod 2^64, kept from call to call."""
    if len(_POWERS.get("up", ())) <= n:
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            power = np.full(max(n + 1, 1 << 20), base, np.uint64)
            power[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(power)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes, by prefix sums of a polynomial mod 2^64."""
    n = len(data)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[gram][data] * up[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows end to end: key, row, first and last window (by place in ``data``) of each segment, and
    the hashes of all GRAM bytes. No segment has windows of two rows, or a window that crosses rows."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, GRAM)
    least = sliding_least(hashes, span - GRAM + 1)
    starts, valid = row[: len(least)], row[: len(least)] == row[span - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    edges = np.append(np.flatnonzero(new | ~valid), len(least))
    last = edges[np.searchsorted(edges, first, "right")] - 1
    if len(first) and (last - first).max() >= RUN:
        parts = [(s, min(s + RUN - 1, b)) for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1, RUN)]
        first, last = np.array(parts, np.int64).T
    return least[first], row[first].astype(np.int64), first, last, hashes


def again(hashes: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> np.ndarray:
    """Whether each segment's key occurs more than once in its own text."""
    size = last - first + span - GRAM + 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
    same = hashes[at] == np.repeat(key, size)
    return np.add.reduceat(same.astype(np.int32), ends - size) > 1 if len(ends) else np.zeros(0, bool)


def _key_counter(text: str, span: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, text):
                found, n = np.unique(segments(data, offsets, span)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return count


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of each key."""
    with np.errstate(over="ignore"):
        other = keys * np.uint64(0xC2B2AE3D27D4EB4F)
    return keys & np.uint64(bits - 1), (other >> np.uint64(20)) & np.uint64(bits - 1)


def _key_filter(keys: DataFrame, count: int) -> tuple[int, list[tuple[int, bytes]]]:
    """A bit filter of the keys, made in parts on the executors: (bits, [(first byte, bytes)])."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 8 * count):
        bits *= 2
    part = min(bits, 1 << 23)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(both))], names=["bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("bit").to_numpy()
            for p in np.unique(at // part).tolist():
                own = maps.setdefault(p, np.zeros(part // 8, np.uint8))
                inside = at[at // part == p] - p * part
                np.bitwise_or.at(own, inside // 8, np.uint8(1) << (inside % 8).astype(np.uint8))
        for p, own in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([p * part // 8], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["at", "map"])

    placed = keys.mapInArrow(place, "bit bigint").withColumn("part", F.floor(F.col("bit") / part))
    rows = placed.repartition(max(1, bits // part), "part").select("bit").mapInArrow(fill, "at bigint, map binary").collect()
    return bits, [(r[0], bytes(r[1])) for r in rows]


def _picker(sent, hot, id_col: str, text: str, span: int):
    """Texts of the segments that may hold repeats, with where they stand."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts = sent.value
        mask = np.zeros(bits // 8, np.uint8)
        for at, own in parts:
            mask[at : at + len(own)] |= np.frombuffer(own, np.uint8)
        frequent = np.array(sorted(hot.value), np.uint64)

        def likely(keys: np.ndarray) -> np.ndarray:
            out = np.ones(len(keys), bool)
            for at in _places(keys, bits):
                at = at.astype(np.int64)
                out &= (mask[at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0
            return out

        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                key, row, first, last, hashes = segments(data, offsets, span)
                may = likely(key)
                rest = np.flatnonzero(~may)
                may[rest] = again(hashes, key[rest], first[rest], last[rest], span)
                at = np.flatnonzero(may)
                key, row, first, last = key[at], row[at], first[at], last[at]
                raw, begin = data.tobytes(), offsets[row]
                key_, row_, at_, text_ = [], [], [], []
                burning = np.isin(key, frequent)
                for k, r, o, s, e in zip(*[x[~burning].tolist() for x in (key, row, begin, first, last)], strict=True):
                    key_.append(k)
                    row_.append(r)
                    at_.append(s - o)
                    text_.append(raw[s : e + span])
                for k, r, o, a, z in zip(*[x[burning].tolist() for x in (key, row, begin, first, last)], strict=True):
                    fine = sliding_least(gram_hashes(data[a : z + span], REFINED), span - REFINED + 1)
                    edge = np.flatnonzero(np.concatenate([[True], fine[1:] != fine[:-1]])).tolist()
                    for s, e in zip(edge, [*edge[1:], len(fine)], strict=True):
                        key_.append(k ^ int(fine[s]))
                        row_.append(r)
                        at_.append(a + s - o)
                        text_.append(raw[a + s : a + e - 1 + span])
                if key_:
                    ids = rows.column(id_col).take(pa.array(row_))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(key_, np.uint64).view(np.int64)), ids, pa.array(at_, pa.int64()), pa.array(text_, pa.binary())], names=["key", "doc", "at", "part"])

    return pick


def repeats(texts: list[bytes], many: list[bool], span: int) -> list[list[tuple[int, int]]]:
    """For each text, the runs [a, b) of its bytes covered by strings of ``span`` bytes that start twice or
    more in all the texts; texts marked many occur more than once."""
    whole, starts, at = [], [], 0
    for text in texts:
        starts.append(at)
        whole.append(text)
        at += len(text) + 1
    # An 0xFF, which UTF-8 never has, ends each text; common prefixes are clipped at the text's end.
    flat = np.full(at, 0xFF, np.int64)
    ends = np.zeros(at, np.int64)
    for start, text in zip(starts, whole, strict=True):
        flat[start : start + len(text)] = np.frombuffer(text, np.uint8).astype(np.int64)
        ends[start : start + len(text) + 1] = start + len(text)
    order = suffix_array(flat)
    left = common_prefixes(flat, order)  # with the suffix before, by place in the text
    place = np.arange(at)
    room = ends - place
    right = np.zeros(at, np.int64)
    right[order[:-1]] = left[order[1:]]
    # A prefix of span bytes without an end in it is shared if a neighbour shares it; prefixes of rank
    # neighbours may run over a text's end only where both do, so the room of this suffix decides.
    double = (np.maximum(left, right) >= span) & (room >= span)
    for start, text, more in zip(starts, whole, many, strict=True):
        if more and len(text) >= span:
            double[start : start + len(text) - span + 1] = True
    out = []
    for start, text in zip(starts, whole, strict=True):
        hit = np.flatnonzero(double[start : start + len(text)])
        if not len(hit):
            out.append([])
            continue
        gap = np.flatnonzero(np.diff(hit) > span)
        firsts, lasts = hit[np.concatenate([[0], gap + 1])], hit[np.concatenate([gap, [len(hit) - 1]])]
        out.append(list(zip(firsts.tolist(), (lasts + span).tolist(), strict=True)))
    return out


def _sharder(span: int, doc_type: pa.DataType):
    """Runs covered by repeats in the rows of a partition, which come sorted by key."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        docs, firsts, ends = [], [], []
        by_key: dict[int, dict[bytes, list]] = {}
        for key, doc, at, part in rows:
            by_key.setdefault(key, {}).setdefault(part, []).append((doc, at))
        shard, size = [], 0

        def flush():
            runs = repeats([t for t, _ in shard], [len(p) > 1 for _, p in shard], span)
            for (_, places), own in zip(shard, runs, strict=True):
                for doc, at in places if own else ():
                    for a, b in own:
                        docs.append(doc)
                        firsts.append(at + a)
                        ends.append(at + b)

        for texts in by_key.values():
            if len(texts) == 1:  # nothing to sort but one text: its repeats are its copies, or within it
                (text, places), = texts.items()
                if len(places) == 1 and len(text) <= 2 * span - GRAM and not _self_similar(text, span):
                    continue
                if len(places) > 1:
                    for doc, at in places:
                        docs.append(doc)
                        firsts.append(at)
                        ends.append(at + len(text))
                    continue
            for item in texts.items():
                shard.append(item)
                size += len(item[0])
            if size >= SHARD:
                flush()
                shard, size = [], 0
        if shard:
            flush()
        return pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64())], names=["doc", "a", "b"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= 4 * SHARD and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return share


def _self_similar(text: bytes, span: int) -> bool:
    """Whether some string of GRAM bytes starts twice in the text, as any repeat inside it needs."""
    h = gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    return len(np.unique(h)) < len(h)


def covered_runs(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(doc, a, b): runs of bytes covered by repeats, for some documents several that overlap."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text_")).where(F.octet_length("text_") >= span)
    keys = source.mapInArrow(_key_counter("text_", span), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    keys = cut(keys, "segment-keys")
    count, most = keys.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(_key_filter(keys.select("key"), count))
    hot: list[int] = []
    if most > HOT:  # as each has HOT segments, such keys are few against the input; they too are bounded
        hot = [r[0] & ((1 << 64) - 1) for r in keys.where(F.col("n") > HOT).orderBy(F.desc("n")).limit(1 << 20).select("key").collect()]
    parts = source.mapInArrow(_picker(sent, spark.sparkContext.broadcast(hot), "doc", "text_", span), source.select(F.lit(0).cast("long").alias("key"), "doc", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("part")).schema)
    dealt = parts.repartition("key").sortWithinPartitions("key")
    doc_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[dict(source.dtypes)["doc"]]
    return dealt.mapInArrow(_sharder(span, doc_type), source.select("doc", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).schema)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``df`` with kept (binary: the bytes that stay), n_bytes, n_removed and n_spans (long).

    A byte goes if a string of ``span`` bytes that covers it starts anywhere else as well, in the same
    row or another; all are judged on the input. Cutting may split a character, so kept is binary.

    Null and empty texts, and texts shorter than ``span``, lose nothing. Repeated rows of one text are
    all removed, being copies. Ids (string, int or bigint) that differ from row to row tell rows apart;
    otherwise (null, repeated) rows are numbered in a table written first. Columns with an added name are
    replaced, others pass.
    """
    base = without(df, "kept", "n_bytes", "n_removed", "n_spans")
    doc, runs_of = fresh(base, "doc", "runs")
    keyed, key = base, id_col
    all_, unlike = base.agg(F.count("*"), F.count_distinct(id_col)).first()
    if all_ != unlike:
        (key,) = fresh(base, "row_number")
        keyed = cut(base.withColumn(key, F.monotonically_increasing_id()), "numbered")
    runs = covered_runs(keyed, key, text_col, span).groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct("a", "b")).alias(runs_of))
    joined = keyed.join(runs, F.col(key) == F.col(doc), "left").drop(doc)
    schema = base.select("*", F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")]).schema

    names = base.columns

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows, data, offsets in slices(whole, text_col):
                kept, n, removed, spans = [], [], [], []
                for runs, a, b in zip(rows.column(runs_of).to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                    text, out, at = data[a:b].tobytes(), [], 0
                    parts = 0
                    for r in sorted((r["a"], r["b"]) for r in runs or ()):
                        if r[1] > len(text):
                            continue
                        if r[0] > at or not parts:
                            parts += 1
                            out.append(text[at : r[0]])
                        at = max(at, r[1])
                    out.append(text[at:])
                    left = b"".join(out)
                    kept.append(left)
                    n.append(len(text))
                    removed.append(len(text) - len(left))
                    spans.append(parts)
                new = [pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (n, removed, spans)]]
                yield pa.RecordBatch.from_arrays([*[rows.column(f) for f in names], *new], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(remove, schema)
