"""Language-model scoring with a Katz backoff bigram model.

Tokens are words and one end. Every word of the training part has bigrams of its own, however rare it is:

    P(word | h) = discounted count(h, word) / count(h)   where that pair was seen,
                  backoff weight(h) * P1(word)           where it was not, or P1(word) after an unseen h.

Counts up to K are discounted by Good and Turing's estimate from the counts of counts, and backoff
weights are computed from the exact sums over what each history was seen with, so that each
distribution adds up to one. P1 is the add-one unigram model, in which all unseen words are one.

Words are told by 63 bits of their hash. Texts are read once, into chunks of numbered tokens; a chunk
sends its different words, and then its different pairs, once each to the parts of the count tables, and
gets back the counts over all chunks, and of each history what its weight is made of. Words are dealt by
hash and pairs by history. Only histories too common for one part are dealt by pair instead and have their
sums sent to all tasks; there are at most HOT_WORDS such, and the model is the same for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import slices
from wardstone.llm._store import cut

#: Counts up to this are discounted.
K = 5
#: Text bytes whose words and pairs are put together before they are sent.
CHUNK = 8 << 20
#: Tokens for each part of the count tables.
PART_TOKENS = 2_000_000
#: Words seen more often than this, and than one time in HOT_WORDS, have their pairs dealt over all parts.
HOT, HOT_WORDS = 250_000, 1 << 12
END, START = b"\n", b"\n\n"  # no word holds white space


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42) >> 1


def _packed(values: np.ndarray) -> bytes:
    """Integers of 64 bits, byte by byte of each, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _sorted_packed(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=0))


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the hashes, so that sorted hashes are in order of their parts."""
    return (keys >> 32) * parts >> 31


class _Ids(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_CHUNK = "chunk bigint, n_tokens bigint, train_tokens bigint, train_docs bigint, words binary, n binary, ids binary, rows binary, lens binary, train binary"


def _reader(row: str, text: str, train: str, limit: int):
    def flush(chunk: int, ids: _Ids, held: list[np.ndarray], rows: list[int], train: list[bool]) -> pa.RecordBatch:
        # By falling frequency, for compression.
        own, lens, learns = np.concatenate(held), np.array([len(x) for x in held]), np.array(train, bool)
        by = np.argsort(-np.bincount(own, minlength=len(ids)), kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by] = np.arange(len(ids))
        own, hashes = rank[own], np.fromiter(map(_hash, ids), np.int64, len(ids))[by]
        n = np.bincount(own[np.repeat(learns, lens)], minlength=len(ids))
        values = [chunk, len(own), int(n.sum()), int(learns.sum()), hashes.tobytes(), *map(_packed, (n, own, np.array(rows, np.int64), lens, learns))]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=[c.split()[0] for c in _CHUNK.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size, ids, held, rows, learns = TaskContext.get().partitionId() << 32, 0, _Ids({START: 0}), [], [], []
        for batch in batches:
            for own, data, offsets in slices(batch, text):
                raw, at = data.tobytes(), offsets.tolist()
                for a, b in zip(at, at[1:], strict=False):
                    found = tokens(raw[a:b])
                    held.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                rows += own.column(row).to_pylist()
                learns += own.column(train).to_pylist()
                size += len(raw) + 64 * len(at)
                if size > limit:
                    yield flush(chunk, ids, held, rows, learns)
                    chunk, size, ids, held, rows, learns = chunk + 1, 0, _Ids({START: 0}), [], [], []
        if held:
            yield flush(chunk, ids, held, rows, learns)

    return read


def _by_part(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of each run of equal parts."""
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((int(part[s]), s, e) for s, e in zip(edges, edges[1:], strict=False) if s < e)


def _word_sender(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, n in zip(*[batch.column(c).to_pylist() for c in ("chunk", "words", "n")], strict=True):
                hashes, n = np.frombuffer(words, np.int64), _unpacked(n)
                by = np.argsort(hashes)
                hashes, n = hashes[by], n[by]
                rows = [(p, _sorted_packed(hashes[s:e]), _packed(n[s:e])) for p, s, e in _by_part(_parts_of(hashes, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], names=["chunk", "part", "words", "n"])

    return send


#: What a part answers to each chunk. Rows of chunk -1 are for the model as a whole.
_ANSWER = "chunk bigint, part int, of string, n binary, more binary, seen bigint"


def _answers(of: str, part: int, rows: list[tuple]) -> pa.Table:
    chunk, n, more, seen = zip(*rows, strict=True)
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array([part] * len(rows), pa.int32()), "of": pa.array([of] * len(rows), pa.string()), "n": pa.array(n, pa.binary()), "more": pa.array(more, pa.binary()), "seen": pa.array(seen, pa.int64())})


def _word_counter(often: int):
    """Counts of one part's words over all chunks, and their numbers in the part, in order of their hashes."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        own = [np.cumsum(_unpacked(x)) for x in table.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpacked(x) for x in table.column("n").to_pylist()])).astype(np.int64)
        split = np.split(at, np.cumsum([len(x) for x in own])[:-1])
        hot = n > often
        rows = [(c, _packed(n[x]), _sorted_packed(x), 0) for c, x in zip(table.column("chunk").to_pylist(), split, strict=True)]
        return _answers("words", key[0].as_py(), [*rows, (-1, _packed(n[hot]), _packed(words[hot]), int((n > 0).sum()))])

    return count


class _Pairs:
    """A chunk's different pairs, in the order in which they are sent to the parts."""

    def __init__(self, chunk: dict, answers: Iterator[tuple[int, bytes, bytes]], ends: int, hot: np.ndarray, parts: int):
        hashes = np.frombuffer(chunk["words"], np.int64)
        by = np.argsort(hashes)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.words, self.own, self.lens = hashes[by], rank.astype(np.int32)[_unpacked(chunk["ids"])], _unpacked(chunk["lens"])
        # Counts of the words over the training part, as words and as histories; their parts and numbers there.
        edges = np.searchsorted(_parts_of(self.words, parts), np.arange(parts + 1))
        self.c, self.ids = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        for part, n, number in answers:
            self.c[edges[part] : edges[part + 1]] = _unpacked(n)
            self.ids[edges[part] : edges[part + 1]] = (part << 40) + np.cumsum(_unpacked(number))
        start = int(np.searchsorted(self.words, _hash(START)))
        self.history = self.c.copy()
        self.history[start] = ends
        keys = np.concatenate([[start], self.own[:-1]])
        keys[np.cumsum(self.lens)[:-1]] = start
        keys *= len(by)
        keys += self.own
        order = np.argsort(keys)
        keys = keys[order]
        first = _runs(keys)
        self.at = np.empty(len(keys), np.int32)
        self.at[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(keys)))
        del order
        self.h, self.w = np.divmod(keys[first], len(by))
        del keys
        #: Places of the pairs that are sent: all whose history was seen.
        sent = np.flatnonzero(self.history[self.h] > 0)
        h = self.words[self.h[sent]]
        is_hot = np.isin(h, hot)
        mixed = ((h ^ self.words[self.w[sent]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
        part = _parts_of(np.where(is_hot, mixed, h), parts)
        by = np.argsort(part, kind="stable")
        self.sent, self.part = sent[by], part[by]


def _chunk_of(left: pa.Table) -> dict:
    return {c: left.column(c)[0].as_py() for c in left.column_names}


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


_PAIRS = "chunk bigint, part int, h binary, k binary, w binary, n binary, c binary"


def _pair_sender(ends: int, hot: np.ndarray, parts: int):
    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk_of(left)
        pairs = _Pairs(chunk, zip(*[right.column(c).to_pylist() for c in ("part", "n", "more")], strict=True), ends, hot, parts)
        learns = np.repeat(_unpacked(chunk["train"]), pairs.lens)
        n = np.bincount(pairs.at, learns, len(pairs.h)).astype(np.int64)[pairs.sent]
        h, w = pairs.h[pairs.sent], pairs.w[pairs.sent]
        rows = []
        for p, s, e in _by_part(pairs.part):
            first = _runs(h[s:e])
            rows.append((p, _sorted_packed(pairs.words[h[s:e][first]]), _packed(np.diff(first, append=e - s)), _packed(pairs.ids[w[s:e]]), _packed(n[s:e]), _packed(pairs.c[w[s:e]])))
        return pa.table({"chunk": pa.array([chunk["chunk"]] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int32())} | {c: pa.array([r[k + 1] for r in rows], pa.binary()) for k, c in enumerate("hkwnc")})

    return send


def _pair_counter(hot: np.ndarray):
    """Counts of one part's pairs over all chunks; and of each history how many pairs have the counts 1
    to K + 1, and the sum of count + 1 over the words it was seen with."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        heads = [np.cumsum(_unpacked(x)) for x in table.column("h").to_pylist()]
        h = np.concatenate([np.repeat(x, _unpacked(k)) for x, k in zip(heads, table.column("k").to_pylist(), strict=True)])
        own = [_unpacked(x) for x in table.column("w").to_pylist()]
        w = np.concatenate(own)
        n, c = (np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()]) for name in "nc")
        by = np.lexsort((w, h))
        new = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])])
        pair = np.empty(len(by), np.int64)
        pair[by] = np.cumsum(new) - 1
        total = np.bincount(pair, n).astype(np.int64)
        first = by[new]
        words, of = np.unique(h[first], return_inverse=True)
        sums = np.stack([*[np.bincount(of, total == k, len(words)) for k in range(1, K + 2)], np.bincount(of, (total > 0) * (c[first] + 1.0), len(words))]).astype(np.int64)
        rows = [(i, _packed(x), _packed(sums[:, np.searchsorted(words, y)].ravel()), 0) for i, x, y in zip(chunks, np.split(total[pair], np.cumsum([len(x) for x in own])[:-1]), heads, strict=True)]
        # The history -1 stands for all: its sums are the counts of counts.
        is_hot = np.isin(words, hot)
        common = np.concatenate([sums.sum(1)[:, None], sums[:, is_hot]], 1)
        return _answers("pairs", key[0].as_py(), [*rows, (-1, _packed(common.ravel()), _packed(np.concatenate([[-1], words[is_hot]])), 0)])

    return count


_SUMS = [f"n{k}" for k in range(1, K + 2)] + ["c"]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, words in zip(batch.column("n").to_pylist(), batch.column("more").to_pylist(), strict=True):
            words = _unpacked(words)
            yield pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, _unpacked(n).reshape(-1, len(words)))], names=["h", *_SUMS])


def discounts(seen: dict[int, int]) -> list[float]:
    """Factors for counts 1 to K from the counts of counts: Good and Turing's, as Katz scales them.
    Where the data give no such factor between 0 and 1 in falling order of need, (c - 1/2) / c."""
    n = [0, *[seen.get(c, 0) for c in range(1, K + 2)]]
    out = []
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for c in range(1, K + 1):
        d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (c - 0.5) / c)
    return out


def _discounted(n: np.ndarray, factors: list[float]) -> np.ndarray:
    return n * np.array([0.0, *factors, 1.0])[np.minimum(n, K + 1)]


def backoff(history: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each history with a count: the weight of what it was not seen with, and a factor for what it
    was seen with. That is 1, unless no count of the history is discounted, when one in its count and one
    more goes to the unseen, or it was seen with everything, when the seen alone must add up to one."""
    share = kept / np.maximum(history, 1)
    rest = 1 - covered
    full = rest < 1e-9
    goal = np.where(full, 1.0, np.minimum(share, history / (history + 1)))
    return np.where(full, 0.0, (1 - goal) / np.where(full, 1, rest)), np.where(share > 0, goal / np.where(share > 0, share, 1), 1.0)


def _scorer(ends: int, hot: np.ndarray, hot_sums: np.ndarray, factors: list[float], whole: int, parts: int):
    """Scores of one chunk's texts; ``whole`` is what add-one counts add up to."""

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, answers = _chunk_of(left), right.select(["of", "part", "n", "more"]).to_pylist()
        pairs = _Pairs(chunk, ((a["part"], a["n"], a["more"]) for a in answers if a["of"] == "words"), ends, hot, parts)
        n, sums = np.zeros(len(pairs.h), np.int64), np.zeros((K + 2, len(pairs.words)), np.int64)
        edges = np.searchsorted(pairs.part, np.arange(parts + 1))
        for a in answers:
            if a["of"] == "pairs":
                at = pairs.sent[edges[a["part"]] : edges[a["part"] + 1]]
                n[at] = _unpacked(a["n"])
                heads = pairs.h[at][_runs(pairs.h[at])]
                sums[:, heads] = _unpacked(a["more"]).reshape(K + 2, -1)
        if len(hot):
            at = np.minimum(np.searchsorted(pairs.words, hot), len(pairs.words) - 1)
            here = pairs.words[at] == hot
            sums[:, at[here]] = hot_sums[:, here]
        lost = sum((1 - d) * k * sums[k - 1] for k, d in enumerate(factors, 1))
        weight, scale = backoff(pairs.history, pairs.history - lost, sums[-1] / whole)
        plain = np.log10(pairs.c + 1.0)
        h, history = pairs.h, np.maximum(pairs.history, 1)
        with np.errstate(divide="ignore"):
            unseen = plain[pairs.w] - np.log10(whole) + np.where(pairs.history[h] > 0, np.log10(weight[h]), 0.0)
            log_p = np.where(n > 0, np.log10(_discounted(n, factors) * scale[h] / history[h]), unseen)
        doc, docs = np.repeat(np.arange(len(pairs.lens), dtype=np.int32), pairs.lens), len(pairs.lens)
        return pa.table({
            "row": pa.array(_unpacked(chunk["rows"])), "n_tokens": pa.array(pairs.lens), "n_known": pa.array(np.bincount(doc, pairs.c[pairs.own] > 0, docs).astype(np.int64)),
            "base_score": pa.array(np.bincount(doc, plain[pairs.own], docs) - pairs.lens * np.log10(whole)), "score": pa.array(np.bincount(doc, log_p[pairs.at], docs)),
        })

    return score


def _scores(docs: DataFrame, chunk: int = CHUNK, part_tokens: int = PART_TOKENS, hot_over: int = HOT) -> tuple[DataFrame, int]:
    """(row, n_tokens, n_known, base_score, score) for texts told apart by the bigint ``row``, learning
    from those with ``train``, and the number of tokens learned from."""
    chunks = cut(docs.select("row", "text", "train").mapInArrow(_reader("row", "text", "train", chunk), _CHUNK), "chunks")
    all_, n, ends = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "train_tokens", "train_docs")]).first()
    parts, often = max(1, -(-all_ // part_tokens)), max(hot_over, n // HOT_WORDS)
    sent = chunks.select("chunk", "words", "n").mapInArrow(_word_sender(parts), "chunk bigint, part int, words binary, n binary")
    words = cut(sent.groupBy("part").applyInArrow(_word_counter(often), _ANSWER), "words")
    common = words.where("chunk = -1")
    whole = n + common.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0] + 1
    hot = [x for r in common.where(F.length("more") > 0).select("more").toArrow().column(0).to_pylist() for x in _unpacked(r).tolist()]
    hot = np.array(sorted(hot + [_hash(START)] * (ends > often)), np.int64)
    body = chunks.select("chunk", "words", "ids", "rows", "lens", "train")
    sent = body.groupBy("chunk").cogroup(words.where("chunk >= 0").groupBy("chunk")).applyInArrow(_pair_sender(ends, hot, parts), _PAIRS)
    pairs = cut(sent.groupBy("part").applyInArrow(_pair_counter(hot), _ANSWER), "pairs")
    common = pairs.where("chunk = -1").select("n", "more").mapInArrow(_common, "h bigint, " + ", ".join(f"{c} bigint" for c in _SUMS))
    sums = {r[0]: r[1:] for r in common.groupBy("h").agg(*[F.sum(c) for c in _SUMS]).collect()}
    factors = discounts(dict(enumerate(sums.get(-1, ())[: K + 1], 1)))
    hot_sums = np.array([sums.get(x, (0,) * (K + 2)) for x in hot.tolist()], np.int64).reshape(-1, K + 2).T
    answers = words.union(pairs).where("chunk >= 0")
    scorer = _scorer(ends, hot, hot_sums, factors, whole, parts)
    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scorer, "row bigint, n_tokens bigint, n_known bigint, base_score double, score double"), n


def katz_scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, **sizes: int) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens (long), base_score, score) for every row, learning from the rows
    where ``training`` is true; n_known counts tokens seen there, base_score is the add-one unigram
    model's log10 probability of the text and score this model's. ``sizes`` are those of ``_scores``;
    ``vocabulary``, once a limit on the words with bigrams of their own, is taken and has no effect.

    Null and empty texts are one end. An empty training part gives every word its share of nothing seen;
    an empty table gives an empty one. Bigint ids that differ from row to row are used as they are;
    otherwise (null, repeated, of another type) rows are numbered in a table written first.
    """
    all_, unlike, kind = *df.agg(F.count("*"), F.count_distinct(id_col)).first(), dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    if all_ == unlike and kind == "bigint":
        docs = docs.withColumn("row", F.col("id"))
    else:
        docs = cut(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found, n = _scores(docs, **sizes)
    named = found if all_ == unlike and kind == "bigint" else found.join(docs.select("row", "id"), "row")
    return named.select(F.col("row" if named is found else "id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
