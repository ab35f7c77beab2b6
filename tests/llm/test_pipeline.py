"""The stages of the corpus pipeline on small tables: odd rows, clashing columns, and rules applied by plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import queries
from tests.llm.test_group_operators import brute_components, edit_distance

CLASHES = ["lines_removed", "n_words", "spans", "contaminated", "log_weight", "key", "node", "piece", "Gumbel_Key", "_doc"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with nulls, repeats, ties, long texts and clashing extra columns."""
    rnd = random.Random(21)
    words = lambda n, of="abcdefghij": " ".join("".join(rnd.choice(of) for _ in range(5)) for _ in range(n))
    passage = words(30, "klmnop")
    texts = [None, "", "  ", words(60), words(60), "x" * 50_000]
    base = words(80)
    texts += [base, base, base + " " + words(4), base.upper(), words(40) + " " + passage + " " + words(40)]
    shared = words(20)
    texts += [f"{shared}\n{words(25)}" for _ in range(4)] + [shared, words(30_000)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, words(50), None, None, None)]
    where = tmp_path_factory.mktemp("documents")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in CLASHES})
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def key(x):
    return -1 if x is None else x


def rows_of(df):
    return sorted(((key(r.doc_id), r.text) for r in df.collect()), key=str)


def test_every_stage_on_odd_rows(spark, folder):
    docs = queries.table(spark, folder, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, folder)
        assert made.columns == docs.columns, name
        assert set(rows_of(made.select("doc_id", "text"))) <= set(rows_of(kept.select("doc_id", "text"))) or name == "lines"
        assert made.where(" or ".join(f"`{c}` <> 'clash'" for c in CLASHES)).isEmpty()
        kept = spark.createDataFrame(made.collect(), made.schema)
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 3, 4, 6, None} <= ids and not {7, 8, 9, 10} & ids
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {key(r.doc_id) for r in packed} == {key(x) for x in ids}
    for stage in [s for _, s in corpus_pipeline.STAGES]:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_by_plain_rules(spark, folder):
    """Lines, near duplicates and benchmark, each on the whole table, against rules in plain Python."""
    docs = queries.table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = sorted({(key(d), p, x) for d, t in rows if t is not None for p, x in enumerate(t.split("\n"))})
    gone = set()
    for i, (d, p, x) in enumerate(lines):
        for d2, p2, x2 in lines[:i]:
            near = min(len(x), len(x2)) >= 24 and abs(len(x) - len(x2)) <= 2 and len(x) < 1000 and edit_distance(x, x2) <= 2
            if (d2, p2) != (d, p) and len(x.strip(" ")) >= 10 and (x == x2 or near):
                gone.add((d, p))
                break
    want = []
    for d, t in rows:
        left = None if t is None else [x for p, x in enumerate(t.split("\n")) if (key(d), p) not in gone]
        if t is None or len(left) == t.count("\n") + 1 or any(x.strip(" ") for x in left):
            want.append((key(d), None if t is None else "\n".join(left)))
    assert rows_of(corpus_pipeline.lines(spark, docs, folder)) == sorted(want, key=str)

    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in rows]
    sets = [set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set() for w in low]
    of = brute_components(sets, 80)
    first = {}
    for (d, _), c in zip(rows, of, strict=True):
        if d is not None:
            first[c] = min(first.get(c, d), d)
    want = [(key(d), t) for (d, t), c in zip(rows, of, strict=True) if d is None or first[c] == d]
    assert rows_of(corpus_pipeline.near_duplicates(spark, docs, folder)) == sorted(want, key=str)

    [passage] = [r.text for r in queries.table(spark, folder, "benchmark").collect() if r.text]
    w = passage.split()
    grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    want = []
    for (d, t), words in zip(rows, low, strict=True):
        hit = {p for i in range(len(words) - 12) if tuple(words[i : i + 13]) in grams for p in range(i, i + 13)}
        if not hit or 20 * len(hit) < len(words):
            want.append((key(d), t))
    assert rows_of(corpus_pipeline.benchmark(spark, docs, folder)) == sorted(want, key=str)
