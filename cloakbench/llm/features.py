"""Hashed document features, sparse rows in numpy, and Adam: shared by the trained classifiers.

A sparse batch is (index, value, starts): entries of row r lie from starts[r] to starts[r + 1].
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = 20
_SYMBOL = re.compile(rb"[^\sA-Za-z0-9\x80-\xff.,;:'\"()-]")


def crc(id_col: str) -> Column:
    """crc32 of the identifier as text; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def sampled(rows: DataFrame, id_col: str, most: int, salt: str) -> DataFrame:
    """About `most` rows, or all if there are no more, chosen by a hash of the identifier: reruns agree."""
    n = rows.count()
    if n <= most:
        return rows
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30))
    return rows.where(h < int(most / n * (1 << 30)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def hashed_words(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their share of the row's length in the Euclidean norm."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
    index, n = np.unique(h, return_counts=True)
    x = np.sqrt(n, dtype=np.float32)
    return index.astype(np.int32), x / np.sqrt(np.float32(n.sum()))


def structure(text: str | None, words: list[bytes]) -> np.ndarray:
    """Shares and lengths that tell prose from tables, shouting, symbol noise and repetition; zeros for an empty text."""
    out = np.zeros(STATS, np.float32)
    raw = (text or "").encode()
    if not words:
        return out
    byte, n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(raw)
    counts, lines = Counter(words), [x for x in raw.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    upper, lower, digits = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
    same = sum(a == b for a, b in zip(words, words[1:]))
    top = counts.most_common(10)
    values = [
        np.log1p(n), np.log1p(len(words)), n / len(words), upper / (upper + lower + 1), digits / n,
        byte[128:].sum() / n, byte[33:48].sum() / n, (byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()) / n,
        byte[124] / len(words), byte[33] / len(words), byte[[35, 36, 37, 38, 42]].sum() / len(words), (byte[44] + byte[46]) / len(words),
        len(counts) / len(words), len(counts) / len(words) ** 0.75, same / len(words), top[0][1] / len(words), sum(c for _, c in top) / len(words),
        1 - len(line_counts) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), len(_SYMBOL.findall(raw)) / len(words),
    ]
    out[:] = values
    return out


def batch_rows(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of those rows in turn, their own starts)."""
    n = starts[rows + 1] - starts[rows]
    own = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(starts[rows] - own[:-1], n) + np.arange(own[-1]), own


def row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's entries (1 or 2 dimensions); empty rows give 0."""
    total = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, shapes: list[tuple[int, ...]], rate: float, kind: type = np.float64):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros(s, kind) for s in shapes], [np.zeros(s, kind) for s in shapes]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
