"""Best-fit packing of token sequences, solved on the histogram of piece lengths.

Lengths are at most `capacity`, so the histogram has at most `capacity` rows however many documents
there are: it goes to the driver, is packed there by bin completion, and comes back as a table of
slots per length. Each piece finds its slot by its rank among pieces of its length; ranks come from
counts per (length, bucket), so no task holds a whole group of equal lengths.

Bin completion, branch-and-bound: the incumbent is the better of best fit decreasing and of taking the
least-waste filling around the largest length left, as often as its lengths allow. If it needs more sequences than the lower bound, the search goes
over fillings, bin by bin with backtracking: around the largest piece left all undominated fillings are
enumerated, least waste first; a branch is cut when its waste or the lower bound of what is left cannot
beat the incumbent, or when its pieces left were met before with no more sequences. Up to `tail` sequences
are searched as a whole; of more, those of most waste and some others in turn are packed anew, as long as
that saves one. `nodes` bounds each of these searches, `budget` all of them; `fewest` tells whether the number of sequences is proved least.

Null text is empty and gives the end id alone. Equal rows get sequences of their own places.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import column
from slotwise.session import ship_package, written

_loaded: dict[str, Tokens] = {}
_LONG_RUN = re.compile(r"\s{20000}")


class Tokens:
    """Ids of a byte-level BPE as little-endian 32-bit words, by the faster of two encoders with one vocabulary.

    Texts that hold a special token's string, or a run of white space that the faster one may not survive, go
    through the tokenizer of the file itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._path, self._file = path, None
        with open(path, encoding="utf-8") as f:
            self._special = [t["content"] for t in json.load(f)["added_tokens"]]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self._special) or _LONG_RUN.search(text):
            if self._file is None:
                from tokenizers import Tokenizer

                self._file = Tokenizer.from_file(self._path)
            return np.array(self._file.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._fast.encode_ordinary(text), "<u4").tobytes()


def token_pieces(df: DataFrame, tokenizer: str, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: a document longer than capacity is cut into full pieces after a shorter first."""
    ship_package(df.sparkSession)
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    last = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Tokens(tokenizer, ranks, pattern)
        encode = _loaded[tokenizer]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            row_of: list[int] = []
            for i, t in enumerate(column(batch, "t").to_pylist()):
                ids = encode(t) + last
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row_of.append(i)
                    for c, x in zip(rows[1:], (k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(x)
            ids_column = column(batch, "doc_id").take(pa.array(row_of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_column, pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]], names=schema.names)

    return source.mapInArrow(cut, schema)


def best_filling(counts: dict[int, int], sizes: list[int], largest: int, room: int, nodes: int = 4000) -> tuple[int, ...]:
    """Lengths that fill `room` beside `largest` with least waste, larger lengths first (which dominate sets of smaller ones).

    Branches are cut once the room they could still fill cannot beat the incumbent's waste; `nodes`
    bounds the search, after which the best filling found so far stands. The first one found is best fit.
    """
    best: tuple[int, ...] = ()
    least = room
    left = nodes
    available = [counts[s] - (s == largest) for s in sizes]
    below = list(itertools.accumulate((s * n for s, n in zip(sizes, available, strict=True)), initial=0))
    chosen: list[list[int]] = []  # place of a length in sizes and its pieces, a step each however many pieces
    free, k = room, len(sizes) - 1
    while True:
        k = min(k, bisect.bisect_right(sizes, free) - 1)
        # below: all that lengths up to this one can still fill, as none of their pieces is taken
        if k >= 0 and left > 0 and free - min(free, below[k + 1]) < least:
            left -= 1
            if take := min(available[k], free // sizes[k]):
                chosen.append([k, take])
                free -= take * sizes[k]
                if free < least:
                    best, least = tuple(sizes[i] for i, n in chosen for _ in range(n)), free
            k -= 1
            continue
        if not chosen or not least or left <= 0:
            return best
        left -= 1
        last = chosen[-1]
        k = last[0] - 1
        free += sizes[last[0]]
        last[1] -= 1
        if not last[1]:
            chosen.pop()


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: pieces of over half a bin share none, and those of at least k can only use what room they leave."""
    sizes = np.array(sorted(counts), np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    number, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    for i in range(half + 1):  # k is the i-th size, or there is none so small
        k = int(sizes[i]) if i < half else capacity // 2 + 1
        alone = int(np.searchsorted(sizes, capacity - k, side="right"))  # pieces of over capacity - k leave no room for k
        alone = max(alone, half)
        n_large, room = int(number[-1] - number[half]), int((number[alone] - number[half]) * capacity - (total[alone] - total[half]))
        rest = int(total[half] - total[min(i, half)])
        best = max(best, n_large + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in each): pieces in falling length, each into the fullest bin that has room."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> filling -> bins

    def put(filling: tuple[int, ...], room: int, n: int) -> None:
        if n:
            of = rooms.setdefault(room, {})
            of[filling] = of.get(filling, 0) + n

    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in sorted(r for r in rooms if r >= s):
            each = room // s  # a bin stays the fullest with room until it has no more
            for filling, n in list(rooms[room].items()):
                take = min(n, left // each)
                more = left - take * each if take < n else 0
                put(filling + (s,) * each, room - each * s, take)
                if more:
                    put(filling + (s,) * more, room - more * s, 1)
                left -= take * each + more
                rooms[room][filling] -= take + (more > 0)
                if not rooms[room][filling]:
                    del rooms[room][filling]
                if not left:
                    break
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        each = capacity // s
        put((s,) * each, capacity - each * s, left // each)
        put((s,) * (left % each), capacity - left % each * s, 1 if left % each else 0)
    return [(n, f) for of in rooms.values() for f, n in of.items()]


def least_waste(counts: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in each): a filling of least waste around the largest length at a time, repeated as often as it fits."""
    counts = dict(counts)
    sizes = sorted(counts)
    bins: list[tuple[int, tuple[int, ...]]] = []
    while sizes:
        largest = sizes[-1]
        filling = (largest, *best_filling(counts, sizes, largest, capacity - largest, nodes))
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        times = min(counts[s] // k for s, k in need.items())
        bins.append((times, filling))
        for s, k in need.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
                sizes.remove(s)
    return bins


def dominated(filling: tuple[int, ...], slack: int, others: list[int]) -> bool:
    """Whether a piece left out could replace one, or several, of the filling's that are together no longer, and still fit."""
    sums: dict[int, int] = {0: 0}  # of some pieces -> the largest number of pieces
    for s in filling:
        for t, n in list(sums.items()):
            sums[t + s] = max(sums.get(t + s, 0), n + 1)
        if len(sums) > 4000:  # a test of fewer sums still only finds what is dominated
            break
    order = sorted(t for t in sums if t)
    for x in others:
        i = bisect.bisect_left(order, x - slack)
        if i < len(order) and (order[i] < x or order[i] == x and sums[x] > 1):
            return True
    return False


def fillings(counts: dict[int, int], largest: int, capacity: int, most: int) -> tuple[list[tuple[int, ...]], bool, int]:
    """Undominated fillings around one piece `largest`, least waste first, whether these are all, and how many were looked at, at most `most`."""
    room = capacity - largest
    sizes = sorted((s for s, n in counts.items() if s <= room and n - (s == largest) > 0), reverse=True)
    available = [counts[s] - (s == largest) for s in sizes]
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0
    todo = [(0, room, ())]
    while todo:
        k, free, chosen = todo.pop()
        while k < len(sizes) and sizes[k] > free:
            k += 1
        if k == len(sizes):
            looked += 1
            if looked > most:
                break
            left = [s for s, n in zip(sizes, available, strict=True) if n > chosen.count(s)]
            if not (left and left[-1] <= free) and not dominated(chosen, free, left):
                found.append((free, chosen))
            continue
        for n in range(min(available[k], free // sizes[k]) + 1):  # the last pushed, with most pieces, comes first
            todo.append((k + 1, free - n * sizes[k], chosen + (sizes[k],) * n))
    found.sort(key=lambda x: (x[0], len(x[1])))
    return [c for _, c in found], looked <= most, looked


def complete_bins(counts: dict[int, int], capacity: int, best: int, nodes: int, width: int = 2000) -> tuple[list[tuple[int, ...]] | None, bool, int]:
    """Bins of a packing with fewer than `best`, the fewest that the search meets, or None; whether the search ended by itself; nodes left.

    A node is a filling looked at; at most `width` are, around one piece.
    """
    total = sum(s * n for s, n in counts.items())
    answer: list[tuple[int, ...]] | None = None
    whole, left = True, nodes  # left: nodes not used yet
    seen: dict[tuple, int] = {}
    stack: list[tuple[dict[int, int], Iterator[tuple[int, ...]], int]] = []
    path: list[tuple[int, ...]] = []

    def options(state: dict[int, int]) -> Iterator[tuple[int, ...]]:
        nonlocal whole, left
        largest = max(state)
        found, complete, looked = fillings(state, largest, capacity, max(1, min(width, left)))
        whole &= complete
        left -= looked
        return iter([(largest, *f) for f in found] or [(largest,)])

    least = lower_bound(counts, capacity)
    if not counts or least >= best:
        return None, True, left
    stack.append((dict(counts), options(counts), 0))
    while stack:
        state, ways, waste = stack[-1]
        way = next(ways, None)
        if way is None:
            stack.pop()
            if path:
                path.pop()
            continue
        if left <= 0:
            return answer, False, 0
        lost = waste + capacity - sum(way)
        if lost > (best - 1) * capacity - total:  # more waste than one bin fewer allows; what follows wastes no less
            stack[-1] = (state, iter(()), waste)
            continue
        after = dict(state)
        for s in way:
            after[s] -= 1
            if not after[s]:
                del after[s]
        used = len(path) + 1
        if not after:
            if used < best:
                best, answer = used, [*path, way]
                if best == least:
                    return answer, True, left
            continue
        key = tuple(sorted(after.items()))
        if used + lower_bound(after, capacity) >= best or seen.get(key, best) <= used:
            continue
        seen[key] = used
        path.append(way)
        stack.append((after, options(after), lost))
    return answer, whole, left


def choose(bins: list[tuple[int, tuple[int, ...]]], capacity: int, size: int, turn: int) -> tuple[list[tuple[int, tuple[int, ...]]], list[tuple[int, tuple[int, ...]]]]:
    """(bins that stay, at most about `size` to pack anew): those of most waste, together of more than a bin, and others in turn."""
    order = sorted(bins, key=lambda x: sum(x[1]))
    free, spare, n = [0] * len(order), 0, 0
    for i, (times, filling) in enumerate(order):
        waste = capacity - sum(filling)
        if not waste or spare >= capacity and n >= size // 2 or n >= size:
            break
        enough = max(-(-(capacity - spare) // waste), size // 2 - n)
        free[i] = min(times, enough, size - n)
        spare, n = spare + free[i] * waste, n + free[i]
    for j in range(len(order)):
        i = (turn + j) % len(order)
        more = min(order[i][0] - free[i], max(1, size // 8), size - n)
        free[i], n = free[i] + more, n + more
    return [(t - f, x) for (t, x), f in zip(order, free, strict=True) if t > f], [(f, x) for (t, x), f in zip(order, free, strict=True) if f]


def pack_histogram(histogram: dict[int, int], capacity: int = 2048, nodes: int = 4000, tail: int = 60, turns: int = 6, budget: int = 200_000) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
    """(number of bins, lengths in each) for all pieces of the histogram, and whether no packing has fewer bins."""
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    least = lower_bound(counts, capacity)
    bins = best_fit(counts, capacity)
    for n in (nodes, 10 * nodes):  # the bound is often met by the first
        if sum(t for t, _ in bins) > least:
            bins = min(bins, least_waste(counts, capacity, n), key=lambda b: sum(t for t, _ in b))
    better = True
    while better and (n := sum(t for t, _ in bins)) > least:
        better = False
        for size, turn in [(n, 0)] if n <= tail else [(s, t) for s in (6, 12, 24, tail) for t in range(turns)]:
            kept, freed = choose(bins, capacity, size, turn * len(bins) // turns) if size < n else ([], bins)
            again: dict[int, int] = {}
            for times, filling in freed:
                for s in filling:
                    again[s] = again.get(s, 0) + times
            allowed = budget if not kept else min(budget, nodes)
            made, whole, left = complete_bins(again, capacity, sum(t for t, _ in freed), allowed)
            budget -= allowed - left
            if made is not None:
                bins, better = kept + [(1, b) for b in made], True
            if not kept and whole:
                return bins, True
            if better or budget <= 0:
                break
        better &= budget > 0
    return bins, sum(t for t, _ in bins) == least


def slot_table(spark: SparkSession, bins: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Rows length, lo, hi, each, base, offsets: ranks lo to hi - 1 of a length fill bins base on, `each` a bin at those offsets."""
    at: dict[int, int] = {}
    rows = []
    base = 0
    for times, filling in bins:
        offset, places = 0, {}
        for s in filling:
            places.setdefault(s, []).append(offset)
            offset += s
        for s, offsets in places.items():
            lo = at.get(s, 0)
            at[s] = lo + times * len(offsets)
            rows.append((s, lo, at[s], len(offsets), base, offsets))
        base += times
    return spark.createDataFrame(rows, "slot_length long, lo long, hi long, each int, base long, offsets array<long>")


def pack(df: DataFrame, tokenizer: str, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 0, bucket_rows: int = 20_000, nodes: int = 4000) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset, and in all of them whether the sequences are proved fewest."""
    spark = df.sparkSession
    pieces = written(token_pieces(df, tokenizer, ranks, pattern, text, doc_id, capacity, end_id), "pieces")
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # fewer rows than capacity
    bins, fewest = pack_histogram(histogram, capacity, nodes)
    n_buckets = max(1, sum(histogram.values()) // bucket_rows)
    n_bins = sum(t for t, _ in bins)

    keyed = short.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    slots = slot_table(spark, bins) if bins else spark.createDataFrame([], "slot_length long, lo long, hi long, each int, base long, offsets array<long>")
    slots = F.broadcast(slots)  # a few rows for each length below capacity
    seated = placed.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    seated = seated.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.expr("(_rank - lo) div each")).alias("sequence_id"), F.element_at("offsets", (nth % F.col("each") + 1).cast("int")).alias("offset"))
    # full pieces fill a sequence each; their numbers only have to differ from all others
    ranked_full = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + F.lit(n_bins)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return seated.unionByName(ranked_full).withColumn("fewest", F.lit(fewest))
