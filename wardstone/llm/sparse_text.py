"""Sparse features of texts: hashed words, statistics of structure, length."""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np

BUCKETS = 1 << 16
#: Entries of a worker's cache of word buckets.
CACHE = 1 << 19
STATISTICS = ("bias", "log_words", "word_length", "capitals", "symbols", "bars", "exclamations", "digits", "distinct", "doubled", "log_lines", "line_words", "stops", "log_bytes")
WIDTH = BUCKETS + len(STATISTICS)


_MARKS = bytes(x for x in range(128) if not chr(x).isalnum())
#: A blank for every ASCII character that is no letter or digit.
BARE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


class Buckets(dict):
    """Bucket of a word, by crc32; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % BUCKETS
        return bucket


def word_features(text: bytes, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's words (ASCII lower case) and how often each occurs."""
    found = Counter(map(buckets.__getitem__, text.lower().split()))
    ids = np.fromiter(found.keys(), np.int32, len(found))
    return ids, np.fromiter(found.values(), np.float64, len(found))


def statistics(text: bytes) -> np.ndarray:
    """Values of STATISTICS, each of the order of one."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    own = text.split()
    size, words, lines = max(1, len(text)), max(1, len(own)), text.count(b"\n") + 1
    letters = max(1, int(n[65:91].sum() + n[97:123].sum()))
    return np.array(
        [
            1.0,
            np.log1p(len(own)) / 8,
            min(3.0, (size - int(n[32])) / words / 8),
            int(n[65:91].sum()) / letters,
            10 * min(0.3, int(n[[35, 42, 36, 37, 38, 60, 62]].sum()) / size),
            10 * min(0.3, int(n[124]) / size),
            10 * min(0.3, int(n[33]) / size),
            int(n[48:58].sum()) / size,
            len(set(own)) / words,
            sum(map(eq, own, own[1:])) / words,
            np.log1p(lines) / 5,
            min(3.0, words / lines / 30),
            min(1.0, 10 * int(n[46]) / words),
            np.log1p(len(text)) / 10,
        ]
    )


def joint_features(text: bytes, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Words with values of norm one, and the statistics."""
    ids, n = word_features(text, buckets)
    x = np.sqrt(n / n.sum()) if len(n) else n
    return np.concatenate([ids, np.arange(BUCKETS, WIDTH, dtype=np.int32)]), np.concatenate([x, statistics(text)])
