"""Line deduplication by a segment-partition edit join, in DataFrame expressions only.

A line of at least `least_exact` characters goes if an equal line stands earlier (ids, then place, in
order), and one of at least `least_near` characters also if an earlier line is within `tau` edits. Both
need `least_exact` characters without the spaces around them, so lines of spaces stay. The earlier line
need not stay itself, so the result does not depend on the order of work.

Near lines: each distinct line is split into tau + 1 segments, of which tau edits leave one whole. Its
segments are indexed by length, number and content; the same line probes, for its own and up to tau
shorter lengths, the substrings that multi-match-aware selection leaves for each segment. A line's length
and its counts of fifteen letters, modulo 16, travel with each key in one long and prune meetings inside
the join. Candidates are verified by a banded bit-parallel automaton: a bit for each diagonal within tau
of the main one, a register for each number of errors.

Texts are split twice: to count lines, and to write the lines that are left, each with its hash and
letters. Keys are made from that table. Equal lines are told by two 64-bit hashes, so their text isn't
shuffled. What repeats, and the lines that candidates name, are small tables as a rule: up to
`broadcast_rows` rows they are broadcast, beyond that they go by shuffle.

Null text stays null and empty text empty. Rows of one id are one document: a line at the same place of
the same id isn't a repetition of itself. Empty tables give no rows. Extra columns are kept; a column
that is named as one of the results is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.arrow import unused, without
from slotwise.session import written

_COUNTED = "etaonrishdlcumg"  # letters whose counts prune, 15 at most


def _segments(tau: int, shorter: int) -> dict[str, Column]:
    """Columns s<gap>_<i>, z<gap>_<i>: start (from 1) and size of segment i of a line `gap` shorter than n; even parts, the longer ones last.

    Columns of their own keep the code of the keys small enough to be compiled.
    """
    parts = tau + 1
    out = {}
    for gap in range(shorter + 1):
        base, longer = F.expr(f"cast((n - {gap}) div {parts} as int)"), F.expr(f"cast((n - {gap}) % {parts} as int)")
        for i in range(parts):
            extra = F.greatest(F.lit(0), longer + (i - parts))
            out[f"s{gap}_{i}"] = base * i + extra + 1
            out[f"z{gap}_{i}"] = base + F.when(longer >= parts - i, 1).otherwise(0)
    return out


def _key(gap: int, i: int, shift: int) -> Column:
    return F.xxhash64(F.substring(F.col("line"), F.col(f"s{gap}_{i}") + shift, F.col(f"z{gap}_{i}")), F.col("n") - gap, F.lit(i))


def index_keys(tau: int) -> list[Column]:
    return [_key(0, i, 0) for i in range(tau + 1)]


def probe_keys(tau: int, least: int) -> list[Column]:
    """Keys under which lines of the same length or up to tau shorter can be found."""
    out = []
    for gap in range(tau + 1):
        for i in range(tau + 1):
            # edits left of the segment are at most i, edits right of it at most tau - i
            for shift in range(max(-i, gap - (tau - i)), min(i, gap + (tau - i)) + 1):
                key = _key(gap, i, shift)
                out.append(F.when(F.col("n") >= least + gap, key) if gap else key)
    return out


def _letters(line: Column, length: Column) -> Column:
    """The length and the counts of a few letters, modulo 16, in four bits each."""
    packed = F.pmod(length, F.lit(16)).cast("long")
    for k, c in enumerate(_COUNTED, 1):  # each is one byte in UTF-8
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(F.pmod(count, F.lit(16)).cast("long"), 4 * k))
    return packed


def _nibble(letters: Column, k: int) -> Column:
    return F.shiftrightunsigned(letters, 4 * k).bitwiseAND(F.lit(15)).cast("int")


def _may_be_near(a: Column, b: Column, tau: int) -> Column:
    """An edit changes the length or two counts of letters: counts differ by at most 2 tau less the gap of lengths."""
    total = F.lit(0)
    for k in range(len(_COUNTED) + 1):
        d = F.abs(_nibble(a, k) - _nibble(b, k))
        total = total + F.least(d, 16 - d)
    return total <= 2 * tau


def within_edits(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings is at most tau: automaton registers r[e], one bit for each diagonal.

    The matches of a column's character along the band are found once a column, before the automaton runs.
    """
    mask = (1 << (2 * tau + 1)) - 1
    rows, cols = F.char_length(a), F.char_length(b)
    names = [f"r{e}" for e in range(tau + 1)]
    start = F.struct(*[F.lit((1 << (tau + e + 1)) - (1 << tau)).alias(n) for e, n in enumerate(names)])  # deletions before any column

    def match(chars: Column, j: Column, char: Column) -> Column:
        near = [F.when((j + (k - tau) >= 0) & (F.get(chars, j + (k - tau)) == char), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * tau + 1)]
        return sum(near[1:], near[0])

    def step(s: Column, m: Column) -> Column:
        new: list[Column] = []
        for e, n in enumerate(names):
            r = s[n].bitwiseAND(m)
            if e:
                before = s[names[e - 1]]
                r = r.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(mask))
            new.append(r)
        return F.struct(*[x.alias(n) for x, n in zip(new, names, strict=True)])

    def run(s: Column) -> Column:
        matches = F.transform(s["t"], lambda char, j: match(s["p"], j, char))
        return F.aggregate(matches, start, step, lambda r: r[names[-1]])

    # the lambda binds the split strings, which would else be split again for every character
    final = F.transform(F.array(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"))), run)[0]
    goal = F.lit(tau) + rows - cols
    return F.when(F.abs(rows - cols) > tau, F.lit(False)).when(cols == 0, rows <= tau).otherwise(F.call_function("shiftright", final, goal).bitwiseAND(F.lit(1)) == 1)


def lines_of(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text}`").cast("string"), "\n", -1)).alias("pos", "line"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def repeated_lines(lines: DataFrame, least: int) -> DataFrame:
    """Rows h, g (hashes of a line that occurs more than once), first_doc, first_pos."""
    hashed = lines.where(F.char_length(F.trim("line")) >= least).select("doc", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    place = F.struct(F.col("doc"), F.col("pos"))
    many = hashed.groupBy("h", "g").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last")))
    return many.select("h", "g", F.col("_first.doc").alias("first_doc"), F.col("_first.pos").alias("first_pos"))


def remaining(parts: Column, gone: Column) -> Column:
    """The lines whose (place, hash) isn't among `gone`: both are sorted together, and a line goes if such an entry precedes it."""
    lines = F.transform(parts, lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("h"), F.lit(1).alias("kind"), line.alias("line")))
    marks = F.transform(gone, lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))

    def unmarked(s: Column) -> Column:
        def here(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)
            return (x["kind"] == 1) & ~F.coalesce((before["kind"] == 0) & (before["pos"] == x["pos"]) & (before["h"] == x["h"]), F.lit(False))

        return F.transform(F.filter(s, here), lambda x: x["line"])

    # the lambda binds the sorted array, which would else be sorted again for every line
    return F.transform(F.array(F.sort_array(F.concat(lines, marks))), unmarked)[0]


def near_pairs(lines: DataFrame, tau: int, least: int) -> DataFrame:
    """Candidate pairs x, y (hashes) of distinct lines (h, line, n, letters) that may be within tau edits."""
    long = lines.where(F.col("n") >= least).select("h", "letters", "line", "n")
    # segments are columns of their own, below the generators; explode would also test the keys for being there
    index = long.withColumns(_segments(tau, 0)).select("h", "letters", F.explode_outer(F.array(*index_keys(tau))).alias("key"))
    probe = long.withColumns(_segments(tau, tau)).select(F.col("h").alias("p_h"), F.col("letters").alias("p_letters"), F.explode_outer(F.array(*probe_keys(tau, least))).alias("p_key")).where("p_key is not null")
    # two lines of one length would find each other twice, and a line itself: there only one way counts
    one_way = (_nibble(F.col("letters"), 0) != _nibble(F.col("p_letters"), 0)) | (F.col("p_h") > F.col("h"))
    met = probe.join(index, (F.col("p_key") == F.col("key")) & one_way & _may_be_near(F.col("letters"), F.col("p_letters"), tau))
    return met.select(F.least("h", "p_h").alias("x"), F.greatest("h", "p_h").alias("y")).distinct()


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = 2, least_exact: int = 10, least_near: int = 24, broadcast_rows: int = 500_000, removed: str = "lines_removed", left: str = "lines_left") -> DataFrame:
    """df with its text less the lines that go, and the numbers of lines removed and left (blank lines are never removed)."""
    df = without(df, [removed, left])
    lines = lines_of(df, text, doc_id)
    repeated = written(repeated_lines(lines, least_exact), "repeated")
    keyed = lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))
    first = F.col("first_doc").eqNullSafe(F.col("doc")) & (F.col("first_pos") == F.col("pos"))
    known = keyed.join(_few(repeated, broadcast_rows), ["h", "g"], "left").withColumn("later", F.col("first_pos").isNotNull() & ~first)
    # lines that take part in near pairs keep their text; those of under least_exact characters aren't collapsed, so all copies would meet
    near_too = ~F.col("later") & (F.char_length(F.trim("line")) >= least_exact) & (F.char_length("line") >= least_near)
    chosen = known.where(F.col("later") | near_too).select("doc", "pos", "h", "later", F.when(~F.col("later"), F.col("line")).alias("line"))
    chosen = chosen.withColumn("n", F.char_length("line")).withColumn("letters", _letters(F.col("line"), F.col("n")))
    chosen = written(chosen, "lines")
    exact = chosen.where("later").select("doc", "pos", "h")

    fresh = chosen.where("not later")
    pairs = written(near_pairs(fresh, tau, least_near), "line-pairs")
    named = written(pairs.select(F.col("x").alias("h")).union(pairs.select("y")).distinct(), "line-names")
    content = written(fresh.join(_few(named, broadcast_rows), "h", "left_semi").select("h", "doc", "pos", "line"), "line-texts")
    side = lambda s: content.select(F.col("h").alias(s), F.struct("doc", "pos").alias(f"{s}_place"), F.col("line").alias(f"{s}_line"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(~F.col("x_place").eqNullSafe(F.col("y_place")))
    later_is_y = F.col("y_place") > F.col("x_place")
    close = both.where(within_edits(F.col("x_line"), F.col("y_line"), tau))
    near = close.select(F.when(later_is_y, F.col("y_place")).otherwise(F.col("x_place")).alias("place"), F.when(later_is_y, F.col("y")).otherwise(F.col("x")).alias("h")).select("place.doc", "place.pos", "h")

    at_doc, at_gone = unused(df, "_doc"), unused(df, "_gone")
    gone = exact.union(near).groupBy(F.col("doc").alias(at_doc)).agg(F.collect_set(F.struct("pos", "h")).alias(at_gone))
    out = df.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(at_doc)), "left")
    parts = F.split(F.col(f"`{text}`").cast("string"), "\n", -1)
    stay = remaining(parts, F.col(at_gone))
    touched = F.col(at_gone).isNotNull()
    others = [F.col(f"`{c}`") if c != text else F.when(touched, F.array_join(stay, "\n")).otherwise(F.col(f"`{text}`")).alias(text) for c in df.columns]
    filled = lambda lines: F.size(F.filter(lines, lambda x: F.trim(x) != ""))
    n = F.coalesce(F.when(touched, F.size(parts) - F.size(stay)), F.lit(0)).cast("long")
    return out.select(*others, n.alias(removed), F.coalesce(F.when(touched, filled(stay)).otherwise(filled(parts)), F.lit(0)).cast("long").alias(left))
