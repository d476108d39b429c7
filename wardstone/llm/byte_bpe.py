"""Byte-level BPE by Spark higher-order functions.

The rank map is a constant in the plan: a sparse table from the ids of two neighbouring pieces to the rank of
what they make, which is also its id. It enters by scalar subqueries over a local row, not spelled out as a literal:
Spark keeps several texts of each plan that ran on the driver, and a literal of two million characters would be
in all of them, run after run. A word is an array with one number for each piece, made of the rank of the pair
that begins there, the piece's place, and its id. The least number is thus the leftmost pair of lowest rank;
each step of the fold merges it and looks up the two pairs that are new.

Every distinct word whose count reaches a threshold is folded once, and its ids are sent to the tasks;
the threshold is the lowest at which these words number at most FREQUENT and take at most FREQUENT_BYTES,
so what is sent is bounded whatever the corpus. Tasks look words up batch by batch (Arrow's hash index, no
dictionary of Python objects); all other words are folded in the row of their document. A fold copies the
word's pieces at each step, so words over LONG bytes are merged beside the look-up with a heap instead.
No text and no token is shuffled, only counts of words. Decoding concatenates the pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._columns import bound
from wardstone.llm._store import cut, drop_cut, fresh, without

#: Most words whose ids are sent to the tasks, and most bytes that they take.
FREQUENT, FREQUENT_BYTES = 3 << 18, 12 << 20
#: Longest word, in bytes, that is folded.
LONG = 255
#: Words looked up at once in a task.
AT_ONCE = 1 << 21
#: Bits for a place and for an id. All ones: no rank.
BITS = 20
NONE = (1 << BITS) - 1


class Ranks(dict):
    """Ranks of tokens, with their codec made once."""

    @cached_property
    def codec(self) -> Codec:
        return Codec(self)


@lru_cache(maxsize=2)
def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def java_pattern(pattern: str) -> str:
    """The pattern for Java: there, classes such as \\s cover all of Unicode only by this flag."""
    return "(?U)" + pattern


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _rows(pairs: dict[tuple[int, int], int], size: int) -> tuple[list[int], list[int]]:
    """A sparse table in one array: the pair (a, b) stands at place offset of a, plus b, as a + 1 and the rank in
    one number; free places hold 0. Rows are laid over each other, the fullest
    first, wherever their entries fall on free places; the array grows while a row finds none."""
    rows: dict[int, list[int]] = {}
    for a, b in pairs:
        rows.setdefault(a, []).append(b)
    rng, offsets, room = np.random.default_rng(0), [0] * size, 4 * len(pairs) + 64
    taken = np.zeros(room + size, bool)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        own, free, rounds = np.array(row), (), 0
        while not len(free):
            if (rounds := rounds + 1) % 20_000 == 0:
                taken = np.concatenate([taken, np.zeros(room // 4, bool)])
                room += room // 4
            tries = rng.integers(0, room, 1 + 512 // len(own))
            free = np.flatnonzero(~taken[tries[:, None] + own].any(1))
        offsets[a] = int(tries[free[0]])
        taken[offsets[a] + own] = True
    table = [0] * len(taken)
    for (a, b), rank in pairs.items():
        table[offsets[a] + b] = a + 1 << BITS | rank
    return offsets, table


class Codec:
    """Encoder and decoder of one rank table in which every byte has a rank and ranks count from 0."""

    def __init__(self, ranks: dict[bytes, int]):
        assert sorted(ranks.values()) == list(range(len(ranks))) and len(ranks) < NONE - 2
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        #: Stands before and after a word; pairs with it have no rank.
        self.edge = len(ranks)
        offsets, table = _rows(pairs, len(ranks) + 1)
        row = {"table": np.array(table, np.int64), "offsets": np.array(offsets, np.int32), "first": np.array([ranks[bytes([b])] for b in range(256)], np.int32)}
        #: One row with the arrays that a fold reads.
        self.row = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in row.items()})

    def encode_all(self, df: DataFrame, words: Column, out: str) -> DataFrame:
        """``df`` with ``out``: ids of each of an array of words, by merging alone.

        Subqueries can't stand in a lambda or beside one, so a column of its own takes them in; as it is used once, Spark
        puts them back where it is used, and no row carries the arrays."""
        row, (arrays,) = df.sparkSession.createDataFrame(self.row), fresh(df, "_arrays")
        keep = [F.col(f"`{c}`") for c in df.columns]
        folded = bound(F.col(arrays), lambda r: bound(r["table"], lambda table: bound(r["offsets"], lambda offsets: bound(r["first"], lambda first: F.transform(words, lambda w: self._fold(table, offsets, first, w))))))
        return df.select(*keep, F.struct(*[row.select(k).scalar().alias(k) for k in row.columns]).alias(arrays)).select(*keep, folded.alias(out))

    def _fold(self, table: Column, offsets: Column, first: Column, word: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """Of two ids; an entry of another row differs in its upper bits, so it comes out as NONE or more."""
            return F.least(F.get(table, F.get(offsets, a) + b).bitwiseXOR(F.shiftleft(a.cast("long") + 1, BITS)), F.lit(NONE))

        def entry(rank: Column, place: Column, piece: Column) -> Column:
            return F.shiftleft(F.shiftleft(rank, BITS).bitwiseOR(place), BITS).bitwiseOR(piece)

        def piece(x: Column) -> Column:
            return x.bitwiseAND(F.lit(NONE)).cast("int")

        def place(x: Column) -> Column:
            return F.shiftright(x, BITS).bitwiseAND(F.lit(NONE))

        def merged(state: Column, low: Column, made: Column, at: Column) -> Column:
            """at: place of the pair in the array, from 1; edges stand before the first and after the last piece."""
            before = F.get(state, at - 2)
            own = entry(rank(made, piece(F.get(state, at + 1))), place(low), made)
            pair = bound(piece(before), lambda p: entry(rank(p, made), place(before), p))
            return F.concat(F.slice(state, F.lit(1), at - 2), F.array(pair, own), F.slice(state, at + 2, F.lit(1 << BITS)))

        def step(state: Column, _: Column) -> Column:
            def some(low: Column) -> Column:
                made = F.shiftright(low, 2 * BITS).cast("int")
                return bound(F.array_position(state, low).cast("int"), lambda at: bound(made, lambda m: merged(state, low, m, at)))

            return bound(F.array_min(state), lambda low: F.when(low < NONE << 2 * BITS, some(low)).otherwise(state))

        def fold(pieces: Column) -> Column:
            start = F.transform(pieces, lambda p, i: entry(rank(p, F.get(pieces, i + 1)), i, p))
            return F.aggregate(F.slice(pieces, 4, LONG), start, step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), piece))

        edge = F.array(F.lit(self.edge))
        return bound(F.concat(edge, F.transform(F.split(as_bytes(word), ""), lambda c: F.get(first, F.ascii(c))), edge), fold)

    def decode(self, ids: Column) -> Column:
        """The pieces of an array of ids end to end."""
        return self._spelled(ids, [t.decode("latin-1") for t in self.tokens])

    def pack(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return self._spelled(ids, [i.to_bytes(4, "little").decode("latin-1") for i in range(len(self.tokens))])

    @staticmethod
    def _spelled(ids: Column, pieces: list[str]) -> Column:
        joined = bound(_literal(pieces, "string"), lambda all_: F.array_join(F.transform(ids, lambda i: F.get(all_, i)), ""))
        return F.encode(joined, "ISO-8859-1")


def as_bytes(text: Column) -> Column:
    """One character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_bpe(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``df`` with ids (array of int), packed (binary: ids as little-endian unsigned 32-bit integers) and
    decoded (binary: the ids' pieces end to end, the text's own bytes).

    Each match of ``pattern`` is encoded by itself, without special tokens. Null and empty texts give
    no ids and no bytes. Rows are encoded one by one, so repeated rows give repeated rows; an empty
    table gives an empty one. Words of any length give the same ids either way. Columns named ids, packed
    or decoded are replaced, all others pass.
    """
    base = without(df, "ids", "packed", "decoded")
    keep = [F.col(f"`{c}`") for c in base.columns]
    found, segments, rare, folded = fresh(base, "_found", "_segments", "_rare", "_folded")
    codec = ranks.codec if isinstance(ranks, Ranks) else Codec(ranks)
    split = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    sent = df.sparkSession.sparkContext.broadcast({"tokens": codec.tokens, "parts": _frequent_words(base.select(F.explode(split).alias("word")), codec, frequent)})
    look_up = F.arrow_udf(_look_up(sent), "segments array<array<int>>, rare array<string>")
    step = base.select(*keep, look_up(split).alias(found))
    step = step.select(*keep, F.col(found)["segments"].alias(segments), F.col(found)["rare"].alias(rare))
    step = codec.encode_all(step, F.col(rare), folded)
    none = F.array().cast("array<int>")
    ids = bound(F.col(folded), lambda own: F.flatten(F.transform(F.col(segments), lambda s, i: F.concat(s, F.coalesce(F.get(own, i), none)))))
    step = step.select(*keep, ids.alias("ids"))
    return step.select(*keep, "ids", codec.pack(F.col("ids")).alias("packed"), codec.decode(F.col("ids")).alias("decoded"))


def _frequent_words(words: DataFrame, codec: Codec, most: int) -> list[tuple]:
    """The most frequent words that occur twice or more, with their ids, as buffers."""
    size = F.octet_length("word")
    counts = cut(words.where(size <= LONG).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    least = number = total = 0
    for n, k, b in counts.groupBy(F.least(F.col("n"), F.lit(1 << 16)).alias("n")).agg(F.count("*"), F.sum(size)).orderBy(F.desc("n")).collect():
        if number + k > most or total + b > FREQUENT_BYTES:
            break
        least, number, total = n, number + k, total + b
    out = []
    if number:
        known = counts.where(F.col("n") >= least).select("word").repartition(32)
        known = codec.encode_all(known, F.array("word"), "ids").select("word", F.get("ids", 0).alias("ids"))
        out = [tuple(r) for r in known.mapInArrow(_pack, "words binary, sizes binary, ids binary, id_sizes binary").collect()]
    drop_cut(counts)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and ids of a batch as buffers; a word has at most LONG bytes and so as many ids."""
    for batch in batches:
        words, ids = batch.column("word").cast(pa.binary()), batch.column("ids")
        sizes = [np.asarray(pc.fill_null(n, 0)).astype(np.uint8).tobytes() for n in (pc.binary_length(words), pc.list_value_length(ids))]
        parts = (b"".join(words.to_pylist()), sizes[0], np.asarray(ids.flatten()).astype(np.int32).tobytes(), sizes[1])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["words", "sizes", "ids", "id_sizes"])


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length: neighbouring pieces stand in a list, pairs wait in a heap."""
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if pieces[i] is None or j >= len(word) or len(pieces[i]) + len(pieces[j]) != size:
            continue  # one of the two has been merged since
        pieces[i], pieces[j], after[i] = pieces[i] + pieces[j], None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (r := ranks.get(pair := pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, len(pair)))
    return [ranks[p] for p in pieces if p is not None]


class _Known:
    """What was sent, laid out for looking up: tokens first, as a word that is a token is that token."""

    def __init__(self, value: dict):
        tokens, parts = value["tokens"], value["parts"]
        data = b"".join([*tokens, *[p[0] for p in parts]])
        sizes = np.concatenate([[len(t) for t in tokens], *[np.frombuffer(p[1], np.uint8) for p in parts]])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        self.ids = np.concatenate([np.arange(len(tokens), dtype=np.int32), *[np.frombuffer(p[2], np.int32) for p in parts]])
        self.sizes = np.concatenate([np.ones(len(tokens), np.uint8), *[np.frombuffer(p[3], np.uint8) for p in parts]]).astype(np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.ranks: dict[bytes, int] = {}

    def long(self, words: list[bytes], tokens: list[bytes]) -> list[list[int]]:
        self.ranks = self.ranks or {t: i for i, t in enumerate(tokens)}
        return [merge(w, self.ranks) for w in words]


def _look_up(sent) -> Callable[[pa.Array], pa.Array]:
    """For each row the ids between its words that were not sent, and these words."""

    def some(known: _Known, words: pa.Array, ends: np.ndarray) -> pa.Array:
        """words: of all rows end to end; ends: where each row ends."""
        at = pc.index_in(words, value_set=known.words).fill_null(-1).to_numpy(zero_copy_only=False)
        ids, starts, sizes = known.ids, known.starts, known.sizes
        missing = np.flatnonzero(at < 0)
        long = missing[pc.binary_length(words.take(missing)).to_numpy(zero_copy_only=False) > LONG]
        if len(long):
            made = known.long(words.take(long).to_pylist(), sent.value["tokens"])
            own = np.array([len(m) for m in made])
            at = at.copy()
            at[long] = len(sizes) + np.arange(len(long))
            starts, sizes = np.concatenate([starts, len(ids) + np.cumsum(own) - own]), np.concatenate([sizes, own])
            ids = np.concatenate([ids, np.array([i for m in made for i in m], np.int32)])
        gaps = np.flatnonzero(at < 0)
        size = np.where(at < 0, 0, sizes[at])
        end = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(end[-1]) - np.repeat(end[:-1] - starts[at], size)]
        before = np.searchsorted(gaps, ends)  # missing words up to each row's end
        cuts = np.zeros(len(gaps) + len(ends) + 1, np.int32)
        cuts[1 + before + np.arange(len(ends))] = end[ends]
        cuts[1 + np.arange(len(gaps)) + np.searchsorted(ends, gaps, "right")] = end[gaps]
        inner = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
        outer = np.concatenate([[0], before + np.arange(1, len(ends) + 1)]).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], before]).astype(np.int32)), words.take(gaps).cast(pa.string()))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(outer), inner), rare], names=["segments", "rare"])

    def look_up(rows: pa.Array) -> pa.Array:
        if "known" not in sent.value:  # workers, and what was sent to them, outlive tasks
            sent.value["known"] = _Known(sent.value)
            sent.value["parts"] = None
        words = rows.flatten().cast(pa.binary())
        ends = np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64))
        out, row, word = [], 0, 0
        while row < len(rows):
            last = max(row + 1, int(np.searchsorted(ends, word + AT_ONCE, "right")))
            out.append(some(sent.value["known"], words.slice(word, ends[last - 1] - word), ends[row:last] - word))
            row, word = last, int(ends[last - 1])
        return pa.concat_arrays(out)

    look_up.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return look_up
