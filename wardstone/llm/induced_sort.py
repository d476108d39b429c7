"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Below this mean bucket size the passes run element by element, else a bucket at a time.
DENSE = 24


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers above 0) in order; an end counts as less than all."""
    values, ranked = np.unique(text, return_inverse=True)
    return _sort(np.concatenate([ranked.astype(np.int64) + 1, [0]]), len(values) + 1)[1:]


def _sort(text: np.ndarray, size: int) -> np.ndarray:
    """text ends with its only 0."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    smaller = _smaller(text)
    leftmost = np.flatnonzero(np.concatenate([[False], smaller[1:] & ~smaller[:-1]]))
    ends = np.cumsum(np.bincount(text, minlength=size))
    induce = _by_bucket if n >= DENSE * size and size < 1 << 16 else _by_element
    # Leftmost-smaller suffixes by first letter give their substrings' order; equal ones get one name.
    order = induce(text, smaller, ends, leftmost)
    ranked = order[np.isin(order, leftmost, assume_unique=True)] if n < 64 else order[_flags(n, leftmost)[order]]
    names, different = _names(text, smaller, leftmost, ranked)
    if different < len(leftmost):
        inner = _sort(names, different)
        ranked = leftmost[inner]
    return induce(text, smaller, ends, ranked)


def _flags(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are less than the next: by the first later letter that differs."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    out = np.ones(n, bool)
    out[:-1] = text[nxt] < text[nxt + 1]
    return out


def _names(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in the order of the text, and their number."""
    count = len(leftmost)
    end = np.empty(len(text), np.int64)
    end[leftmost] = np.concatenate([leftmost[1:], [len(text) - 1]])
    length = end[ranked] - ranked + 1
    same = length[1:] == length[:-1]
    a, b = ranked[:-1], ranked[1:]
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        equal = text[np.minimum(a[live] + step, len(text) - 1)] == text[np.minimum(b[live] + step, len(text) - 1)]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
        live = live[length[live] > step]
    # The last, the end itself, is like no other.
    if count > 1:
        same[0] = False
    name = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.empty(len(text), np.int64)
    by_place[ranked] = name
    return by_place[leftmost], int(name[-1]) + 1


def _by_bucket(text: np.ndarray, smaller: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Induce all suffixes from leftmost-smaller ones in ``seeds`` order. A bucket's entries are induced
    together; those that fall into the bucket itself make the next round, as in runs of one letter."""
    size = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    letters = text[seeds]
    grouped = seeds[np.argsort(letters.astype(np.uint16), kind="stable")]
    seed_ends = np.cumsum(np.bincount(letters, minlength=size))
    seed_starts = np.concatenate([[0], seed_ends[:-1]])
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]

    def spread(own: np.ndarray, into: list[list[np.ndarray]], want_smaller: bool, c: int) -> np.ndarray:
        before = own[own > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return before
        own_letters = text[before]
        again = before[own_letters == c]
        rest, rest_letters = before[own_letters != c], own_letters[own_letters != c]
        if len(rest):
            by = np.argsort(rest_letters.astype(np.uint16), kind="stable")  # letters are few here
            rest, rest_letters = rest[by], rest_letters[by]
            edges = np.flatnonzero(np.concatenate([[True], rest_letters[1:] != rest_letters[:-1]]))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(rest)], strict=True):
                into[int(rest_letters[s])].append(rest[s:e])
        return again

    for c in range(size):
        todo = larger[c]
        k = 0
        while k < len(todo):
            again = spread(todo[k], larger, False, c)
            if len(again):
                todo.append(again)
            k += 1
        if seed_ends[c] > seed_starts[c]:
            spread(grouped[seed_starts[c] : seed_ends[c]], larger, False, c)
    out = np.empty(len(text), np.int64)
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        todo = small[c]
        k = 0
        while k < len(todo):  # each chunk is in descending order
            again = spread(todo[k], small, True, c)
            if len(again):
                todo.append(again)
            k += 1
        if c == 0:
            todo = [np.array([len(text) - 1])]
        mine = np.concatenate(todo)[::-1] if todo else seeds[:0]
        out[ends[c] - len(mine) : ends[c]] = mine
        large = np.concatenate(larger[c]) if larger[c] else seeds[:0]
        out[starts[c] : starts[c] + len(large)] = large
        if len(large):
            spread(large[::-1], small, True, c)
    return out


def _by_element(text: np.ndarray, smaller: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same passes, one suffix at a time."""
    n = len(text)
    letters, small = text.tolist(), smaller.tolist()
    out = [-1] * n
    tail = ends.tolist()
    for i in reversed(seeds.tolist()):
        c = letters[i]
        tail[c] -= 1
        out[tail[c]] = i
    head = [0, *ends[:-1].tolist()]
    for k in range(n):
        i = out[k] - 1
        if i >= 0 and not small[i]:
            c = letters[i]
            out[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = out[k] - 1
        if i >= 0 and small[i]:
            c = letters[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place of the text, the length that its suffix shares with the
    suffix before it in ``order``. ``text`` is of bytes, integers below 256.

    Where the letters before both suffixes are equal, the length is that of the place before, less one. It is
    worked out letter by letter, eight at a time, only at the other places."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    own = (before <= 0) | (place == 0)
    own[~own] = text[place[~own] - 1] != text[before[~own] - 1]
    flat = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(flat[:8].view(np.uint64), (n + 9,), (1,))
    heads = np.flatnonzero(own)
    live = heads[before[heads] >= 0]
    length = np.zeros(n, np.int64)
    while len(live):
        a, b = live + length[live], before[live] + length[live]
        room = n - np.maximum(a, b)
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        more = np.minimum(same, room)
        length[live] += more
        live = live[more == 8]
    if not n:
        return length
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(length[last] - (place - last), 0)
