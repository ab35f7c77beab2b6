"""Vectorised tokenising and hashing of UTF-8 text held in Arrow buffers.

A word's 64-bit hash takes its length and its bytes eight at a time, each step a keyed bijection of all
64 bits; words of more than 64 bytes go through BLAKE2b. Nothing here makes a Python object per ordinary word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_KEY = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 64
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight

#: A byte table: 1 for bytes of words, 0 for the white space 0x20 and 0x09 to 0x0D.
SPACE_SPLIT = np.ones(256, np.uint8)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = 0
#: As SPACE_SPLIT, with punctuation as a class of its own (2) beside letters, digits and non-ASCII (1).
WORD_OR_MARK = np.full(256, 2, np.uint8)
WORD_OR_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
WORD_OR_MARK[[*range(0x00, 0x21)]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin at `at`, of so many bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    hashed = mix(sizes.astype(np.uint64) * _KEY + np.uint64(1))
    who = np.arange(len(at))
    for k in range(0, _LONG_WORD, 8):
        if k:
            who = who[sizes[who] > k]
            if not len(who):
                break
        part = eight[at[who] + k] & _HEADS[np.minimum(sizes[who] - k, 8)]
        hashed[who] = mix((hashed[who] ^ part) + _KEY)
    for i in np.flatnonzero(sizes > _LONG_WORD):
        word = data[at[i] : at[i] + sizes[i]].tobytes()
        hashed[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashed


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes (or one longer row): first row, end row, bytes, offsets. Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACE_SPLIT, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token (a run of one class), its class and, for each row, the index of its first token (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], n)
    keep = kind[at] != 0
    at, ends = at[keep], ends[keep]
    hashed = word_hashes(LOWER[data] if lower else data, at, ends - at)
    return hashed, kind[at], np.searchsorted(at, offsets).astype(np.int64)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each row and, for each, its row. A row of fewer words, but not none, gives one of all its words."""
    n, rows = len(words), len(first) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            part = np.zeros(n, np.uint64)
            part[: n - k] = words[k:] if k else words
            # past the row's end a place holds nothing
            inside = np.arange(n) + k < first[row + 1]
            total = mix(total * np.uint64(0x9FB21C651E98DF25) + np.where(inside, part + np.uint64(k + 1), np.uint64(0)))
    place = np.arange(n) - first[row]
    keep = (place + width <= counts[row]) | ((place == 0) & (counts[row] < width))
    return total[keep], row[keep]
