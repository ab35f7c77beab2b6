"""Quality rules on repetition, from a suffix array over the words of whole texts.

The words of a block of documents make one array; prefix doubling sorts the suffixes of every
document at once and only refines groups that are still tied. Longest common prefixes of
neighbours give, for each place, the longest substring that occurs elsewhere in its document: an
LCP interval's right end. The union of those spans is what maximal repeated substrings cover.

Null and empty texts have no words; they fail the base rule on length. Rows are judged one by one,
so repeated rows and tables without rows need no rule. A clashing input column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotwise.llm.arrow import add_columns, column
from slotwise.llm.text import SPACE_SPLIT, blocks, tokens

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_LETTERS = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64) * SPACE_SPLIT
_BLANK = " \t\n\x0b\x0c\r"


def suffix_order(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all rows (rows in order, suffixes sorted within each) and the ranks after each doubling."""
    n = len(words)
    ends = np.repeat(first[1:], np.diff(first))
    _, symbol = np.unique(words, return_inverse=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((symbol, row))
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (symbol[order][1:] != symbol[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels, step = [rank.astype(np.int32)], 1
    size = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        after = tied + step
        inside = after < ends[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[tied]
        by = np.lexsort((second, old))
        old, second, who = old[by], second[by], tied[by]
        change_old = np.empty(len(who), bool)
        change_old[0] = True
        change_old[1:] = old[1:] != old[:-1]
        change = change_old.copy()
        change[1:] |= second[1:] != second[:-1]
        place = np.arange(len(who))
        group = np.maximum.accumulate(np.where(change_old, place, 0))
        start = np.maximum.accumulate(np.where(change, place, 0))
        rank = rank.copy()
        rank[who] = old + (start - group)
        levels.append(rank.astype(np.int32))
        run = np.diff(np.append(np.flatnonzero(change), len(who)))
        tied = np.sort(who[np.repeat(run, run) > 1])
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def longest_repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that starts there and occurs twice or more in its row."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    order, levels = suffix_order(words, first)
    ends = np.repeat(first[1:], np.diff(first))
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    open_ = np.flatnonzero((ends[a] == ends[b]) & (levels[0][a] == levels[0][b]))
    common[open_] = 0
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[open_] + common[open_], b[open_] + common[open_]
        inside = (x < ends[a[open_]]) & (y < ends[b[open_]])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common[open_[same]] += 1 << k
    most = np.zeros(n, np.int64)
    most[a] = common
    most[b] = np.maximum(most[b], common)
    return most


def covered(most: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Words of each row inside the union of its repeated substrings of at least `least` words."""
    n = len(most)
    at = np.flatnonzero(most >= least)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + most[at], minlength=n + 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change)[:n] > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def duplicate_lines(text: str | None) -> int:
    seen: set[str] = set()
    n = 0
    for line in (text or "").split("\n"):
        if line.strip(_BLANK):
            n += line in seen
            seen.add(line)
    return n


def repetition_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 20, window: int = 8, max_window_percent: int = 30, repeat_words: int = 5, max_covered_percent: int = 40, max_longest: int = 200) -> DataFrame:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed and kept."""

    def judge(batch: pa.RecordBatch) -> list:
        texts = column(batch, text)
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for _lo, _hi, data, offsets in blocks(texts):
            words, _kinds, first = tokens(data, offsets)
            most = longest_repeats(words, first)
            longest = np.zeros(len(first) - 1, np.int64)
            full = np.diff(first) > 0
            if full.any():
                longest[full] = np.maximum.reduceat(most, first[:-1][full])
            for out, x in zip(parts, (np.diff(first), row_sums(_LETTERS[data], offsets), row_sums(_SYMBOLS[data], offsets), covered(most, first, window), covered(most, first, repeat_words), longest), strict=True):
                out.append(x)
        n, chars, symbols, repeats, cover, longest = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        lines = np.array([duplicate_lines(t) for t in texts.to_pylist()], np.int64)
        failed = (n < min_words) | (100 * repeats > max_window_percent * n)
        kept = ~failed & (100 * cover <= max_covered_percent * n) & (longest <= max_longest)
        return [n, chars, symbols, lines, repeats, cover, longest, failed, kept]

    long = T.LongType()
    fields = [T.StructField(c, long) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")]
    fields += [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return add_columns(df, judge, fields, keep, [text])
