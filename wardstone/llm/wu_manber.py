"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts become runs of words, each with a blank before it, so that a window is the plain byte string
" w1 w2 ... wn " and its occurrences on word bounds are its occurrences as a string. A shift table on
hashed blocks of bytes tells how far the search may jump; a block that ends some pattern opens the
bucket of that block, and the strings in it are compared directly. The search runs over many stretches
of text side by side, one array operation for a step of all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm._arrow import slices
from wardstone.llm._store import cut, fresh, without

BLANK, BREAK = 0x20, 0x00
#: Benchmark bytes searched for at once; a larger benchmark is searched for in several blocks of about this size.
BLOCK_BYTES = 8 << 20
#: Bytes of text that one lane of the search walks.
LANE = 1024


def _byte_table() -> np.ndarray:
    """A-Z to a-z; digits, letters and every byte of a non-ASCII character stay; all else is a blank."""
    table = np.full(256, BLANK, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


TABLE = _byte_table().tobytes()


def item_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def spaced(raw: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' words, a blank before each and behind the last, and a break after each row; and the
    number of words of each row."""
    parts, counts = [], []
    for a, b in zip(offsets, offsets[1:], strict=False):
        own = item_words(raw[a:b])
        counts.append(len(own))
        parts.append(b" " + b" ".join(own) + b" \x00" if own else b" \x00")
    return np.frombuffer(b"".join(parts), np.uint8), np.array(counts, np.int64)


class Matcher:
    """Shift tables and buckets for a set of byte strings, one set of tables for lengths from each of
    1, 8, 16 and 32 bytes on, as the shortest string bounds every jump."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.sizes = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.tables = []
        bounds = [1, 8, 16, 32, 1 << 62]
        for low, high in zip(bounds, bounds[1:], strict=False):
            own = [i for i, p in enumerate(patterns) if low <= len(p) < high]
            if own:
                self.tables.append(self._tables(own))

    def _tables(self, own: list[int]):
        short = min(len(self.patterns[i]) for i in own)
        block = min(8, max(1, short // 2))
        bits = int(min(22, max(12, np.ceil(np.log2(len(own) * (short - block + 1) * 8)))))
        shift = np.full(1 << bits, short - block + 1, np.int32)
        heads = sorted({self.patterns[i][:short] for i in own})
        joined = np.frombuffer(b"".join(heads) + bytes(8), np.uint8)
        starts = np.arange(len(heads)) * short
        for j in range(short - block, -1, -1):  # the block's start in the head; the last has shift 0
            np.minimum.at(shift, self._hash(joined, starts + j, block, bits), short - block - j)
        bucket: dict[bytes, list[int]] = {}
        for i in own:
            bucket.setdefault(self.patterns[i][:short], []).append(i)
        return short, block, bits, shift, bucket

    @staticmethod
    def _hash(data: np.ndarray, at: np.ndarray, block: int, bits: int) -> np.ndarray:
        """data has eight bytes or more behind each place in at."""
        word = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))[at] << np.uint64(8 * (8 - block))
        return (word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, pattern) of every occurrence."""
        padded = np.concatenate([data, np.full(8, BREAK, np.uint8)])
        raw = data.tobytes()
        for short, block, bits, shift, bucket in self.tables:
            at = np.arange(0, max(0, len(data) - short + 1), LANE)
            stop = np.minimum(at + LANE, len(data) - short + 1)
            while len(at):
                jump = shift[self._hash(padded, at + (short - block), block, bits)]
                for place in at[jump == 0].tolist():
                    for i in bucket.get(raw[place : place + short], ()):
                        if raw.startswith(self.patterns[i], place):
                            yield place, i
                at = at + np.maximum(jump, 1)
                open_ = at < stop
                at, stop = at[open_], stop[open_]


def window_holders(items: Iterable[tuple[object, bytes]], size: int) -> dict[bytes, list[str]]:
    """The windows of some benchmark items, and which items hold each."""
    holders: dict[bytes, set[str]] = {}
    for item, text in items:
        own = item_words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            holders.setdefault(b" " + b" ".join(own[i : i + size]) + b" ", set()).add("" if item is None else str(item))
    return {k: sorted(v) for k, v in sorted(holders.items())}


def _hits(matcher: Matcher, holders: list[list[str]], raw: bytes, offsets: list[int]):
    """For each row: number of words, a flag for each word that is hit (None: no hit), items."""
    out, counts = spaced(raw, offsets)
    found: dict[int, set[str]] = {}
    matches = list(matcher.search(out))
    if matches:
        blanks = np.flatnonzero(out == BLANK)
        first = np.concatenate([[0], np.cumsum(counts + 1)])  # each row has one blank more than words
        at = np.searchsorted(blanks, [place for place, _ in matches])
        which = np.array([i for _, i in matches])
        edge = np.bincount(at, minlength=len(blanks) + 1) - np.bincount(at + matcher.sizes[which], minlength=len(blanks) + 1)
        hit = np.cumsum(edge) > 0
        for row, i in set(zip((np.searchsorted(first, at, "right") - 1).tolist(), which.tolist(), strict=True)):
            found.setdefault(row, set()).update(holders[i])
    for row, count in enumerate(counts.tolist()):
        yield count, (hit[first[row] : first[row] + count] if row in found else None), found.get(row, ())


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with n_words, n_hit, n_items (long), items (sorted array of strings) and contaminated.

    ``benchmark`` has item_id and text. Its size is summed first; up to ``block_bytes`` it is sent to
    the executors whole, a larger one in blocks of about that size, each in a pass of its own over the
    texts. No document is shuffled. Matches never cross rows.

    Null and empty texts have no words and are clean. Items without words (or null) have no windows;
    items with equal ids count once, and all items with a null id as one, named by an empty string. Rows are judged one by one, so repeated rows give repeated rows;
    empty tables give empty or clean results. Columns with an added name are replaced, others pass.
    """
    out = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    base = without(df, *out)
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-max(1, total) // block_bytes)
    n, marks, items = fresh(base, "n", "marks", "items_found")
    step = base.select("*", F.lit(0).cast("long").alias(n), F.lit(None).cast("binary").alias(marks), F.array().cast("array<string>").alias(items))
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        windows = step.sparkSession.sparkContext.broadcast(window_holders([(r[0], (r[1] or "").encode()) for r in part.select("item_id", "text").collect()], window))
        step = step.mapInArrow(_marker(windows, text_col, n, marks, items), step.schema)
        if block % 4 == 3 and block + 1 < blocks:
            step = cut(step, "decontaminate")
    n_hit = F.coalesce(F.length(F.translate(marks_text(marks), "0", "")), F.lit(0)).cast("long")
    return step.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.col(n).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sort_array(items).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col(n))).alias("contaminated"),
    )


def marks_text(marks: str):
    return F.decode(F.col(marks), "US-ASCII")


def _marker(windows, text: str, n: str, marks: str, items: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, holders = Matcher(list(windows.value)), list(windows.value.values())
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                counts, flags, lists = [], [], []
                old = zip(rows.column(marks).to_pylist(), rows.column(items).to_pylist(), strict=True)
                for (count, hit, found), (was, had) in zip(_hits(matcher, holders, data.tobytes(), offsets.tolist()), old, strict=True):
                    counts.append(count)
                    if hit is None:
                        flags.append(was)
                    else:
                        hit = hit if was is None else hit | (np.frombuffer(was, np.uint8) == 0x31)
                        flags.append((hit + np.uint8(0x30)).astype(np.uint8).tobytes())
                    lists.append(sorted({*had, *found}))
                new = {n: pa.array(counts, pa.int64()), marks: pa.array(flags, pa.binary()), items: pa.array(lists, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(f.name, rows.column(f.name)) for f in rows.schema], names=rows.schema.names)

    return mark


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = 13) -> tuple[int, int, list[str]]:
    """The same result for one text by comparing every window with every place, for tests."""
    own = item_words((text or "").encode())
    hit, found = set(), set()
    for item, words in items:
        w = item_words((words or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for k in range(len(own) - len(part) + 1):
                if own[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)
