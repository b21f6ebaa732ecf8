"""Vectorised words, word hashes and word shingles over Arrow string batches.

A word is a run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
A-Z is lower-cased: digits, a-z and everything beyond ASCII.  In UTF-8 that class
can be decided byte by byte, so a whole batch of texts is cut into words with a
few numpy passes and no Python string is built.

Null texts count as empty: no words, no shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^n and B^-0..B^-n modulo 2^64, kept for the life of the worker."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n, CHUNK_BYTES) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps); ``seed`` gives other functions."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: byte ranges in ``data``, hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by single spaces."""
        raw = self.data.tobytes() if j - i > 64 else None
        cut = (lambda a, b: raw[a:b]) if raw is not None else (lambda a, b: self.data[a:b].tobytes())
        return b" ".join(cut(a, b) for a, b in zip(self.start[i:j], self.end[i:j])).decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each (or one longer text)."""
    if len(column) == 0:
        return
    _, ends = buffers(column)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j
        i = j


def words_of(column: pa.Array) -> Words:
    """All words of a (chunk of a) string column."""
    raw, ends = buffers(column)
    base = int(ends[0])
    data = _LOWER[raw[base : int(ends[-1])]]
    ends = ends - base
    inside = _IS_WORD[data]
    edge = np.empty(len(data), dtype=bool)  # a word starts here: previous byte is no word byte, or a text starts
    if len(data):
        edge[0] = True
        np.logical_not(inside[:-1], out=edge[1:])
        edge[ends[:-1][ends[:-1] < len(data)]] = True
    start = np.flatnonzero(edge & inside)
    stop = np.empty(len(data), dtype=bool)
    if len(data):
        stop[-1] = True
        np.logical_not(inside[1:], out=stop[:-1])
        last = ends[1:] - 1
        stop[last[last >= 0]] = True
    end = np.flatnonzero(stop & inside) + 1
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * up[: len(data)], dtype=np.uint64, out=total[1:])
    value = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return Words(data, start, end, mix(value), np.searchsorted(start, ends))


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs by first word (garbage where a run leaves its text), and which are whole."""
    n = len(words.hash)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        factor = np.uint64(2 * pow(0x2545F4914F6CDD1D, j + 1, 1 << 63) + 1)
        total[: n - j if n > j else 0] += words.hash[j:] * factor
    whole = np.zeros(n, dtype=bool)
    if n:
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        whole = np.arange(n) + k <= words.first[1:][text]
    return mix(total, seed=k), whole


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text.  A text of 1 to k-1 words has
    one shingle, all its words; a text without words has none."""
    for i, j in chunks(column):
        w = words_of(column.slice(i, j - i))
        grams, whole = gram_hashes(w, k)
        short = {m: gram_hashes(w, m)[0] for m in range(1, k) if (w.count() == m).any()}
        for row in range(j - i):
            a, b = w.first[row], w.first[row + 1]
            if b - a >= k:
                yield i + row, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield i + row, short[int(b - a)][a : a + 1]
            else:
                yield i + row, grams[:0]
