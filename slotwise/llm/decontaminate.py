"""Benchmark decontamination: one Aho-Corasick automaton over the normalised words of benchmark items.

Items become sequences of word numbers. A window of `width` words holds one of the item's aligned runs of
(width + 1) / 2 words, those that begin at multiples of that, so these runs are the automaton's patterns:
about one node for each word of an item, instead of one for each letter of each window. Each text is read
once; where a run is found, the words beside it are compared with the item's, and all windows that lie
inside the part that agrees are hits. Items shorter than the window are patterns as a whole. Hits are
mapped to word numbers and to code points of the original. Items travel by broadcast in blocks of bounded
size; more blocks mean more passes over the rows, which keep the hits found so far, and no shuffle.

Null and empty texts have no words and are clean; items without words match nothing; repeated items
each count; an empty benchmark leaves everything clean. A clashing input column is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import add_columns, column

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[str, Windows] = {}


def normal_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """The windows of `width` words of numbered items, found through an automaton over aligned runs of their words."""

    def __init__(self, texts: list[str], width: int):
        import ahocorasick

        self.width, self.step = width, (width + 1) // 2
        self.number: dict[bytes, int] = {}
        # a run of words (or a whole short item) -> words before it, words after it (as many as a window can reach) -> items
        around: dict[tuple[int, ...], dict[tuple[tuple[int, ...], tuple[int, ...], bool], set[int]]] = {}
        for i, text in enumerate(texts):
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in normal_words(text))
            if 0 < len(ids) < width:
                around.setdefault(ids, {}).setdefault(((), (), True), set()).add(i)
                continue
            reach = width - self.step
            for a in range(0, len(ids) - self.step + 1, self.step):
                b = a + self.step
                around.setdefault(ids[a:b], {}).setdefault((ids[max(0, a - reach) : a][::-1], ids[b : b + reach], False), set()).add(i)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, places in around.items():
            self.machine.add_word(run, (len(run), [(*k, tuple(sorted(items))) for k, items in places.items()]))
        self.empty = not around
        if around:
            self.machine.make_automaton()

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first word, end, items) of runs in which every window is one of the items'."""
        if self.empty or not words:
            return
        number = self.number
        ids = tuple([number.get(w, 0) for w in words])
        n = len(ids)
        for last, (size, places) in self.machine.iter(ids):
            end = last + 1
            begin = end - size
            for before, after, whole, items in places:
                lo, hi = begin, end
                for x in before:
                    if not lo or ids[lo - 1] != x:
                        break
                    lo -= 1
                for x in after:
                    if hi == n or ids[hi] != x:
                        break
                    hi += 1
                if whole or hi - lo >= self.width:
                    yield lo, hi, items


def _windows(key: str, items: list[tuple[str, str]], width: int) -> Windows:
    """Built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows([text for _, text in items], width)
    return _built[key]


_LONG = T.LongType()
_HITS = [T.StructField("_hits", T.StructType([T.StructField("words", T.ArrayType(_LONG)), T.StructField("items", T.ArrayType(T.StringType()))]))]
_SPAN = T.StructType([T.StructField("start", _LONG), T.StructField("end", _LONG)])
_REPORT = [T.StructField("n_words", _LONG), T.StructField("n_hit", _LONG), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("contaminated", T.BooleanType())]


def _spans(text: str, hits: list[int]) -> list[dict]:
    """Code points of the original that runs of hit words take, the gaps inside a run included."""
    places = [m.span() for m in _WORD.finditer(text)] if hits else []
    out: list[dict] = []
    last = -2
    for w in hits:
        if w == last + 1:
            out[-1]["end"] = places[w][1]
        else:
            out.append({"start": places[w][0], "end": places[w][1]})
        last = w
    return out


def _scan_block(df: DataFrame, items: list[tuple[str, str]], text: str, width: int, final: bool, keep: list[str], least_percent: int) -> DataFrame:
    key = hashlib.sha256(repr((width, items)).encode("utf-8", "surrogatepass")).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(items)
    again = "_hits" in df.columns

    def scan(batch: pa.RecordBatch) -> list:
        listed = sent.value
        machine = _windows(key, listed, width)
        columns: list[list] = [[] for _ in (_REPORT if final else _HITS)]
        before = column(batch, "_hits").to_pylist() if again else [None] * batch.num_rows
        for t, was in zip(column(batch, text).to_pylist(), before, strict=True):
            words = normal_words(t)
            found: set[int] = set(was["words"]) if was else set()
            names: set[str] = set(was["items"]) if was else set()
            for lo, hi, own in machine.spans(words):
                found.update(range(lo, hi))
                names.update(listed[i][0] for i in own)
            hits, own_items, n = sorted(found), sorted(names), len(found)
            made = (len(words), n, own_items, _spans(t, hits), n > 0 and 100 * n >= least_percent * len(words)) if final else ({"words": hits, "items": own_items},)
            for c, x in zip(columns, made, strict=True):
                c.append(x)
        return columns

    return add_columns(df, scan, _REPORT if final else _HITS, keep, [text, *["_hits"] * again])


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, width: int = 13, least_percent: int = 5, block_chars: int = 8 << 20) -> DataFrame:
    """Columns n_words, n_hit, items (sorted ids as strings), spans (code points of the original) and contaminated.

    block_chars is the item text that one broadcast is meant to hold; a single longer item makes a block of its own.
    """
    listed = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t"))
    total = listed.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = -(-int(total) * 5 // (block_chars * 4)) if total > block_chars else 1
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "_hits"])
    kept = [c for c in out.columns if keep is None or c in keep]
    for k in range(n):
        block = listed if n == 1 else listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        items = sorted((r["i"], r["t"]) for r in block.collect())
        carried = kept if k == n - 1 else [c for c in out.columns if c != "_hits"]
        out = _scan_block(out, items, text, width, k == n - 1, carried, least_percent)
    return out
