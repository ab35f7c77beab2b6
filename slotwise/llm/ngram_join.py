"""Exact Jaccard join of documents' word n-gram sets, and their connected components.

Universe partition with the pigeonhole principle. Sets whose sizes fall in one band hash their elements
into m segments. Two linked sets of which one has n elements differ in at most D(n) elements, so some
segments agree exactly, or up to one deletion where that is allocated: each document emits keys of whole
segments, and for the d segments with an allocated deletion a key per one-deletion neighbour as well.
m and d are chosen for each band by estimated cost (keys written against chance meetings of segments
with hardly any elements). m exceeds what the principle asks for, so a document leaves keys out: in an
order that only depends on a segment's content, fullest segments first, it emits as many of the others
as leave out one segment less than must agree. The first of two sets' agreeing segments in that order
is then emitted by both, so no link is lost. Sets that have partners in a lower band emit keys for it as well.

The text is read once: sizes, sketches and keys are written and read again. Equal sets are one node from
the start (64-bit hash of the set), whose keys one document emits. Keys that two nodes share make
candidates, without making pairs of all who share one: first every node is checked against the most
connected node of each key; then, in keys whose nodes aren't yet one component, only nodes outside the
component of that key's centre meet the others, and only if parities of element counts in buckets, 256 and for
sets of more elements at least as many buckets as elements, allow enough overlap; a key with more than `block_rows` nodes on a side is dealt by node to cells of that
size, each its own group of the join. Each candidate is verified on the words of both whole texts, not on hashes. Links
inside a component that is known already are not looked for: the result is components, and n_links
counts the links that were found and verified, which may be fewer than there are.

Null and empty texts have empty sets and are linked with nothing; texts with fewer words than the width
have their word sequence as only element. Ties and repeated rows are equal sets; rows with a null id take
part but never name a component unless all ids in it are null. Empty tables give no rows. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import column
from slotwise.llm.text import LOWER, blocks, mix, shingles, tokens
from slotwise.session import ship_package, written

_LOWER = LOWER.tobytes()
SKETCH = [f"s{i}" for i in range(4)]
_COARSE = 256  # buckets of SKETCH; beyond so many elements parities in so few no longer tell sets apart
_BAND_GROWTH = 2.0
_CHANCE_COST = 400.0  # keys that a meeting of empty segments costs; each further element makes meetings rarer by
_CHANCE_FALL = 0.05


def differing(n: int, hi: int, percent: int) -> int:
    """Elements by which a set of n and a linked one can differ, if the smaller of both has at most hi."""
    return n * (100 - percent) // percent if n <= hi else (n + hi) * (100 - percent) // (100 + percent)


def _cost(n: int, hi: int, m: int, d: int, percent: int) -> float:
    """Keys that a set of n elements emits, and what their chance meetings cost, with segment sizes by Poisson's law."""
    x = n / m
    sizes = np.arange(int(x + 10 * math.sqrt(x) + 12))
    share = np.exp(sizes * math.log(x) - x - np.array([math.lgamma(k + 1) for k in sizes]))
    whole = max(0, differing(n, hi, percent) + 1 - 2 * d)
    fullest = np.cumsum(((m - d) * share)[::-1])[::-1]  # segments of at least so many elements
    taken = np.minimum(fullest, whole)
    by_size = taken - np.append(taken[1:], 0)
    rare = _CHANCE_FALL ** sizes.astype(float)
    return whole + d * (1 + x) + _CHANCE_COST * float((by_size * rare).sum() + d * (share * rare).sum() + d * (share * sizes * rare).sum() / _CHANCE_FALL)


def allocation(lo: int, hi: int, percent: int) -> tuple[int, int]:
    """(segments m, of which d with one deletion) of least cost for sets of lo to hi elements; m + d is at least one more than they can differ by."""
    most = differing(hi, hi, percent)
    half = most // 2 + 1
    choices = sorted({*range(min(half, 6) + 1), half})
    steps = sorted({max(1, round((most + 1) * 1.12**k)) + extra for k in range(18) for extra in (0, 1, 2)})
    found = []
    for d in choices:
        for m in steps:
            if m + d > most and m >= d:
                found.append((sum(_cost(n, hi, m, d, percent) for n in {lo, round(math.sqrt(lo * hi)), hi}), m, d))
    return min(found)[1:]


def bands(largest: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, m, d) from the first size at which linked sets can differ up to `largest`."""
    lo = -(-percent // (100 - percent))
    out = []
    while lo <= largest:
        hi = max(lo, math.ceil(lo * _BAND_GROWTH) - 1)
        out.append((lo, hi, *allocation(lo, hi, percent)))
        lo = hi + 1
    return out


_bands: dict[int, list] = {}


def block_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row, and the row of each."""
    words, _, first = tokens(data, offsets, lower=True)
    found, row = shingles(words, first, width)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], row[new]


def set_features(found: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, 64-bit set hashes and parity sketches (rows x 4)."""
    sizes = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(0xA5A5)), dtype=np.uint64)])
        twos = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        hashes = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(twos[at[1:]] - twos[at[:-1]] + sizes.astype(np.uint64)))
    parity = np.bincount(row * 256 + (found >> np.uint64(56)).astype(np.int64), minlength=rows * 256).reshape(rows, 256) & 1
    sketch = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
    return sizes, hashes.view(np.int64), sketch


def fine_sketches(found: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities in the least power of two of buckets that is no less than the set, for sets of more than _COARSE elements: words of all rows,
    row by row, and the number of words of each row. A sketch of half the buckets is the xor of its halves."""
    buckets = np.where(sizes > _COARSE, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    start = np.cumsum(buckets) - buckets
    mine = buckets[row] > 0
    of = row[mine]
    place = start[of] + (found[mine] & (buckets[of] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(place, minlength=int(buckets.sum())) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64), buckets // 64


def set_keys(found: np.ndarray, row: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows of a block, row by row, and the number of keys of each row."""
    largest = int(sizes.max()) if len(sizes) else 0
    known = _bands.get(percent, [])
    if not known or known[-1][1] < largest:
        known = _bands[percent] = bands(max(largest, 4096), percent)
    rows_out, keys_out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    contribution = mix(found + np.uint64(0x632BE59BD9B4E019))
    place = mix(found ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32)
    for b, (lo, hi, m, d) in enumerate(known):
        chosen = (sizes >= lo) & (sizes <= hi * 100 // percent)  # larger ones are partners of sets in this band
        if not chosen.any():
            continue
        which = np.flatnonzero(chosen)
        number = np.full(len(sizes), -1)
        number[which] = np.arange(len(which))
        mine = chosen[row]
        part, of = contribution[mine], number[row[mine]]
        segment = (place[mine] % np.uint64(m)).astype(np.int64)
        index = of * m + segment
        total = np.zeros(len(which) * m, np.uint64)
        np.add.at(total, index, part)
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(b << 32) + np.uint64(1))
        keys = mix(total + np.tile(salt, len(which))).reshape(len(which), m)
        if m > d:
            n = sizes[which]
            whole = np.where(n <= hi, n * (100 - percent) // percent, (n + hi) * (100 - percent) // (100 + percent)) + 1 - 2 * d
            count = np.bincount(index, minlength=len(total)).reshape(len(which), m)[:, d:]
            # fullest first, then by content: any two sets put their agreeing segments in the same order
            order = (np.minimum(count, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (keys[:, d:] >> np.uint64(16))
            last = np.sort(order, axis=1)[np.arange(len(which)), np.clip(m - d - whole, 0, m - d - 1)]
            emit = (order >= last[:, None]) & (whole > 0)[:, None]
            rows_out.append(which[np.nonzero(emit)[0]])
            keys_out.append(keys[:, d:][emit])
        if d:
            rows_out.append(np.repeat(which, d))
            keys_out.append(keys[:, :d].ravel())
            near = segment < d
            rows_out.append(which[of[near]])
            keys_out.append(mix(total[index[near]] - part[near] + salt[segment[near]]))
    rows = np.concatenate(rows_out)
    return np.concatenate(keys_out).view(np.int64)[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(sizes))


_LONG = T.LongType()
_NODE = [T.StructField("n", _LONG), T.StructField("node", _LONG), *[T.StructField(s, _LONG) for s in SKETCH]]


def document_sets(df: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """Rows doc_id, n, node (hash of the set; null for empty ones), sketch columns, fine (sketch of a large set), keys (none for sets too small to differ from a linked one)."""
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([source.schema["doc_id"], *_NODE, T.StructField("fine", T.ArrayType(_LONG)), T.StructField("keys", T.ArrayType(_LONG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(column(batch, "t")):
                found, row = block_sets(data, offsets, width)
                sizes, hashes, sketch = set_features(found, row, hi - lo)
                keys, counts = set_keys(found, row, sizes, percent)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(x)) for x, k in (fine_sketches(found, row, sizes), (keys, counts))]
                node = pa.array(hashes, mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array(sizes), node, *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4)], *lists], names=schema.names)

    return source.mapInArrow(run, schema)


def word_set(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, as tuples of words."""
    words = text.translate(_LOWER).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)], strict=False))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets of words are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("t").cast("binary").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").cast("binary").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {"a": (None, set()), "b": (None, set())}  # one side often stays the same from row to row
        for batch in batches:
            keep = []
            ids = {n: column(batch, n).to_pylist() for n in "ab"}
            for i in range(batch.num_rows):
                for n in "ab":
                    if last[n][0] != ids[n][i]:
                        last[n] = (ids[n][i], word_set(column(batch, f"t{n}")[i].as_py(), width))
                p, q = last["a"][1], last["b"][1]
                common = len(p & q)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """Rows node, label for the ends of edges (a, b): the smallest node of each component. Labels are written out every round."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        step = step.join(jump, "_new").select("node", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") < F.col("_old")).alias("_moved"))
        step = written(step, name)
        moved = step.where("_moved").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, percent: int = 90, broadcast_ids: int = 1_000_000, block_rows: int = 1000) -> DataFrame:
    """Rows doc_id, n_shingles, component_id and n_links (verified links of the document's set)."""
    if not 50 < percent < 100:
        raise ValueError("percent must be above 50 and below 100")
    spark = df.sparkSession
    ship_package(spark)
    docs = written(document_sets(df, text, doc_id, width, percent), "sets")
    full = docs.where("node is not null")
    nodes = written(full.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SKETCH], F.count(F.lit(1)).alias("rows")), "nodes")

    # one document of each node emits its keys
    copied = nodes.where("rows > 1").select("node", F.col("first").alias("_first"))
    copied = F.broadcast(copied) if copied.limit(broadcast_ids + 1).count() <= broadcast_ids else copied
    single = full.select("doc_id", "node", "keys").join(copied, "node", "left").where("_first is null or _first <=> doc_id")
    keys = single.select("node", F.explode("keys").alias("key"))
    of_key = Window.partitionBy("key")
    members = keys.withColumn("_a", F.min("node").over(of_key)).withColumn("_b", F.max("node").over(of_key)).where("_a <> _b")
    members = written(members.select("key", "node").distinct(), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    fame = members.join(sizes, "key").groupBy("node").agg(F.sum("_size").alias("_fame"))
    rated = members.join(fame, "node")
    centres = written(rated.groupBy("key").agg(F.max_by("node", F.struct("_fame", "node")).alias("centre")), "centres")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first").alias("doc_id"))
    wanted = written(wanted, "wanted")
    few = wanted.count() <= broadcast_ids
    whole = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    # a repeated id may have other texts: the one whose set is the node is found by its hash
    texts = whole.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "t")
    texts = written(_matching(texts, width), "texts")

    # large sets are told apart by sketches of their own size; one row of each node has it
    fine = docs.where(F.size("fine") > 0).select("doc_id", "node", "fine").join(F.broadcast(wanted) if few else wanted, ["doc_id", "node"])
    fine = written(fine.select("node", "fine").dropDuplicates(["node"]), "fine")
    sketched = nodes.select("node", "n", *SKETCH).join(fine, "node", "left")

    star = members.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    linked = written(verified(_possible(star, sketched, percent), texts, width, percent), "links")
    labels = components(linked)

    # nodes outside the component of their key's centre meet the other components of that key
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    centre_labels = centres.join(labels.withColumnRenamed("node", "centre"), "centre", "left").select("key", F.coalesce("label", "centre").alias("_centre"))
    outside = placed.join(centre_labels, "key").where("label <> _centre").select("key", "node", "label")
    # a key's meetings are dealt to cells of at most about block_rows nodes a side, so that no task meets a hot key alone
    blocks_of = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    n_outside = outside.groupBy("key").agg(F.count(F.lit(1)).alias("_l"))
    cells = n_outside.join(sizes, "key").select("key", blocks_of("_l").alias("_rows"), blocks_of("_size").alias("_columns"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ("node", "label", "n", *SKETCH, "fine")
    left = outside.join(cells, "key").join(sketched, "node").select(F.col("key").alias("l_key"), own("_rows").alias("l_row"), every("_columns").alias("l_column"), *[F.col(c).alias(f"l_{c}") for c in fields])
    right = placed.join(cells, "key").join(sketched, "node").select(F.col("key").alias("r_key"), every("_rows").alias("r_row"), own("_columns").alias("r_column"), *[F.col(c).alias(f"r_{c}") for c in fields])
    meet = left.join(right, (F.col("l_key") == F.col("r_key")) & (F.col("l_row") == F.col("r_row")) & (F.col("l_column") == F.col("r_column")) & (F.col("l_label") != F.col("r_label")) & _alike("l", "r", percent))
    more = meet.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()
    linked = written(linked.union(verified(more, texts, width, percent)), "all-links")
    labels = components(linked, "all-labels")

    links = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classed = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    smallest = classed.groupBy("label").agg(F.min("first").alias("component_id"))
    classed = classed.join(smallest, "label").join(links, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = docs.drop("fine", "keys").join(classed, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _alike(p: str, q: str, percent: int) -> Column:
    """Whether sizes and sketches of two nodes, in columns with prefixes p and q, allow the similarity. Buckets of unlike parity are no more
    than the elements in which the sets differ, so no link is lost."""
    n, k, x, y = (F.col(c) for c in (f"{p}_n", f"{q}_n", f"{p}_fine", f"{q}_fine"))
    allowed = lambda apart: apart * (100 + percent) <= (n + k) * (100 - percent)
    coarse = sum(F.bit_count(F.col(f"{p}_{s}").bitwiseXOR(F.col(f"{q}_{s}"))) for s in SKETCH)
    half = lambda z: F.zip_with(F.slice(z, F.lit(1), (F.size(z) / 2).cast("int")), F.slice(z, (F.size(z) / 2).cast("int") + 1, (F.size(z) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    # sizes differ by less than twice, so buckets by twice at most
    to_size = lambda z, other: F.when(F.size(z) > F.size(other), half(z)).otherwise(z)
    fine = F.aggregate(F.zip_with(to_size(x, y), to_size(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, c: total + c)
    near = F.least(n, k) * 100 >= F.greatest(n, k) * percent
    return near & allowed(coarse) & F.when((F.size(x) > 0) & (F.size(y) > 0), allowed(fine)).otherwise(F.lit(True))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda p: nodes.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("n", *SKETCH, "fine")])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("a", "b", percent)).select("a", "b")


def _matching(texts: DataFrame, width: int) -> DataFrame:
    """Rows node, t whose text has the node's set, one for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = column(batch, "node").to_numpy()
            keep = []
            for lo, hi, data, offsets in blocks(column(batch, "t")):
                found, row = block_sets(data, offsets, width)
                keep.append(set_features(found, row, hi - lo)[1] == nodes[lo:hi])
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return texts.mapInArrow(run, "node long, t string").dropDuplicates(["node"])
