"""Row-wise operators against brute force, with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from slotwise.llm import chat, decontaminate, importance, licenses, queries, repetition

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [None, "", " \n\t", "one", "a b a b a b", "é " * 30, LONG, "x y z\nx y z\n\nq", "Licensed under the Apache License, Version 2.0."]


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, N_WORDS string")


def brute_repeats(words, n):
    at = {}
    for i in range(len(words) - n + 1):
        at.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + n)})


def test_repetition_against_windows(spark):
    rnd = random.Random(1)
    texts = [*TEXTS[:6], *TEXTS[7:]] + [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(["head"] + [str(i) for i in range(40)] * 2)]
    for r in repetition.repetition_rules(table(spark, texts)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_repeat_words, r.n_covered) == (brute_repeats(words, 8), brute_repeats(words, 5))
        longest = next((n for n in range(len(words), 0, -1) if brute_repeats(words, n)), 0)
        assert r.longest_repeat == longest
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)
    whole = repetition.repetition_rules(table(spark, [LONG])).first()
    assert whole.n_words == 60_000 and whole.n_repeat_words == 60_000 and not whole.kept
    assert repetition.repetition_rules(table(spark, [])).count() == 0


def test_decontamination(spark):
    rnd = random.Random(2)
    words = [f"t{i}" for i in range(30)]
    item = [rnd.choice(words) for _ in range(20)]
    items = [(7, " ".join(item)), (8, "Short, item!"), (9, None), (10, ""), (11, " ".join(item))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "a short-ITEM here", "x " * 10 + " ".join(item[3:16]).upper() + "? y", " ".join(item[:12]), LONG]
    for kw in ({}, {"block_chars": 30}):  # one block and several
        got = {r.doc_id: r for r in decontaminate.decontaminate(table(spark, texts), bench, **kw).collect()}
        assert [got[i].n_hit for i in range(6)] == [0, 0, 2, 13, 0, 0]
        assert got[2]["items"] == ["8"] and got[3]["items"] == ["11", "7"] and got[3].contaminated
        span = got[3].spans[0]
        assert texts[3][span.start : span.end] == " ".join(item[3:16]).upper()
        assert got[2].n_words == 4 and "N_WORDS" not in got[2].asDict()
    assert decontaminate.decontaminate(table(spark), bench.limit(0)).where("contaminated").isEmpty()


def test_windows_against_brute_force():
    rnd = random.Random(12)
    for width in (1, 2, 4, 5, 13):
        for letters in ("ab", "abcdef"):
            items = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 3 * width + 2))) for _ in range(12)]
            machine = decontaminate.Windows(items, width)
            for _ in range(40):
                words = [rnd.choice(letters + "z") for _ in range(rnd.randint(0, 60))]
                if rnd.random() < 0.7:
                    x = rnd.choice(items).split()
                    at = rnd.randint(0, len(x))
                    words[5:5] = x[at:]
                hit, of = set(), set()
                for k, item in enumerate(items):
                    x = item.split()
                    size = min(width, len(x))
                    grams = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
                    for i in range(len(words) - size + 1):
                        if size and tuple(words[i : i + size]) in grams:
                            hit.update(range(i, i + size))
                            of.add(k)
                spans = list(machine.spans([w.encode() for w in words]))
                assert {p for lo, hi, _ in spans for p in range(lo, hi)} == hit
                assert {k for *_, own in spans for k in own} == of


def test_chat_round_trip(spark):
    evil = ["", "\\", "\\\\</turn>", "<turn:user>\n", "### Assistant: x", "\\### Assistant: </turn> ok", "<|image:0|>", "a\nb", "</turn", "é😀<"]
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "a>b\\", None]), rnd.choice([*evil, None])) for c in range(40) for t in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part("text"))
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in made.collect()}
    for c in got:
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert chat.read_back(got[c].formatted) == turns
        said = "".join(chat.unescape(got[c].formatted[s.start : s.end]) for s in got[c].loss)
        assert said == "".join(t for r, t in turns if r == "assistant")
    d = {r.conv_id: r for r in chat.digests(made).collect()}
    assert d[0].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for k, _, r, t in rows if k == 0).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "u1", 28, 15, None, None), ("audio", None, "u2", None, None, 1.5, None), ("document", None, "u3", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS.simpleString()}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<turn:user>\nsee <|image:0|><|audio:1|><|document:2|></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "u1", 4), ("audio", "u2", 38), ("document", "u3", 1536)]
    assert r.expanded_tokens == 4 + 38 + 1536
    assert chat.read_parts(r.formatted, [a.asDict() for a in r.attachments]) == [("user", [("text", "see "), ("image", "u1"), ("audio", "u2"), ("document", "u3")])]
    odd = [None, ("text", "\\<|image:0|> <|image:0|>", None, None, None, None, None), ("image", None, None, -3, None, None, None), ("audio", None, "u", None, None, float("nan"), None), ("video", None, "v", None, None, None, None), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", odd), (2, 0, None, None)], f"conv_id long, turn long, role string, parts {chat.PARTS.simpleString()}")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[2].formatted == "<turn:>\n</turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "", 1), ("audio", "u", 0), ("video", "v", 0)]
    assert chat.read_parts(got[1].formatted, [a.asDict() for a in got[1].attachments]) == [("user", [("text", "\\<|image:0|> <|image:0|>"), ("image", ""), ("audio", "u"), ("video", "v")])]


def test_licences(spark):
    rows = [("a/LICENSE", "x\nReleased under the MIT License.\ny"), ("a/b/c.txt", "nothing"), ("a/b/d.txt", "# Licensed under CC BY-NC 4.0."), ("e.txt", "z"), (None, "q"), ("a/b2/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), ("a/b2/f/g.txt", None), ("a/b2/h.txt", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.effective_licence, r.inherited_from, r.method) for r in licenses.inherit(licenses.scan_notices(df)).collect()}
    assert got == {"a/LICENSE": ("MIT", None, "file"), "a/b/c.txt": ("CC-BY-NC-4.0", "a/b", "inherited"), "a/b/d.txt": ("CC-BY-NC-4.0", None, "file"), "e.txt": (None, None, "none"), None: (None, None, "none"), "a/b2/LICENSE.md": ("GPL-3.0", None, "file"), "a/b2/f/g.txt": ("GPL-3.0", "a/b2", "inherited"), "a/b2/h.txt": ("GPL-3.0", "a/b2", "inherited")}
    clash = df.withColumns({c: F.lit("x") for c in ("method", "_n", "_nearest", "Directory", "effective_licence")})
    again = licenses.inherit(licenses.scan_notices(clash)).collect()
    assert {r.path: (r.effective_licence, r.inherited_from, r.method) for r in again} == got and all(r._nearest == r._n == "x" for r in again)
    assert licenses.inherit(licenses.scan_notices(df.limit(0))).count() == 0
    own = (("house", "For use inside the house only"),)
    assert licenses.Matcher(own).scan("a\nfor use inside the house only\nb")[1] == "house"
    m = licenses.Matcher(licenses.TEMPLATES)
    assert all(m.best(t)[0] == pytest.approx(1) and m.best(t)[1] == n for n, t in licenses.TEMPLATES)
    assert all(any(k in t.lower() for k in licenses.TRIGGERS) or n == "ISC" for n, t in licenses.TEMPLATES)


def test_licences_of_sources(spark, tmp_path):
    bsd = [t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause"][-1]
    mit = [t for n, t in licenses.TEMPLATES if n == "MIT"][-1].replace("MIT License.", "MIT License\n\nCopyright (c) 2020 The Authors\n\n").replace("conditions: The", "conditions:\n\nThe")
    short = "Was orer.\nThis work is licensed under the GNU General Public License, version 3."
    rows = [(1, mit, "a"), (2, "nothing", "a"), (3, "some words\nand more of them\nLicensed under CC BY-NC 4.0.", "a"), (4, short, "b"), (5, "nothing", "b"), (6, None, "c"), (7, bsd, "c"), (8, "nothing", None), (9, None, "a/sub"), (10, bsd, None), (11, bsd, "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.effective_licence, r.inherited_from, r.method) for r in queries.op8_license_scan(spark, str(tmp_path)).collect()}
    none = (None, None, "none")
    assert got == {1: ("MIT", None, "file"), 2: ("MIT", "a", "inherited"), 3: ("CC-BY-NC-4.0", None, "notice"), 4: ("GPL-3.0", None, "notice"), 5: none, 6: ("BSD-3-Clause", "c", "inherited"), 7: ("BSD-3-Clause", None, "file"), 8: none, 9: ("MIT", "a", "inherited"), 10: ("BSD-3-Clause", None, "file"), 11: ("BSD-3-Clause", None, "file")}


def test_licences_of_standard_texts():
    m = licenses.Matcher(licenses.TEMPLATES)
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    heads = {name: "\n".join((folder / f).read_text().strip().split("\n")[:3]) for f, name in files.items() if (folder / f).exists()}
    gpl = "This {} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    cases = [*heads.items(), ("GPL-2.0", gpl.format("program", "", "2")), ("LGPL-2.1", gpl.format("library", "Lesser ", "2.1")), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause")]
    cases += [("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")]
    cases += [("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:")]
    cases += [(n, f"Copyright (c) 2020 The Authors\nAll rights reserved.\n\n{x.replace('met: 1.', 'met:' + chr(10) * 2 + '1.')}\n") for n, x in licenses.TEMPLATES if n.startswith("BSD") and "THIS SOFTWARE IS" in x]
    for name, text in cases:
        score, found, _ = m.scan(text)
        assert (found, score >= 0.75) == (name, True), (name, found, score, text)


def test_importance_held_out(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    fit = labels.where("pmod(doc_id, 2) = 0")
    got = importance.resample(docs, fit).join(labels.where("pmod(doc_id, 2) = 1"), "doc_id")
    rate = {(r.quality, r.toxic): r.share for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert rate[(1, 0)] > 0.97 and rate[(1, 1)] < 0.5 and rate[(0, 0)] < 0.4


def test_importance_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert importance.resample(table(spark, []), labels).count() == 0
    assert importance.resample(table(spark), none).where("kept").count() == len(TEXTS)
    assert importance.resample(table(spark), labels, k=3).where("kept").count() == 3
    rows = importance.resampled_rows(table(spark), labels, k=4)
    assert rows.count() == 4 and rows.columns == table(spark).columns


def test_importance_against_brute_force(spark):
    """Counts, ratios and the draw on a small table, by plain Python."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("abcdefgh" if i % 3 else "stuvwxyz") for _ in range(rnd.randint(3, 12))) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    bits = (20, 20)
    made = importance.draw(docs, labels, bits=bits, smoothing=(1.0,), least_ratio=(0.5,), k=20)
    got = {r.doc_id: r for r in made.scored.collect()}
    grams = []
    for t in texts:
        w = t.split()
        grams.append(({("1", x) for x in w}, {("2", x, y) for x, y in zip(w, w[1:], strict=False)}))
    good = {i for i in range(30) if i % 3}
    for i in range(60):
        total = 0.0
        for part in (0, 1):
            raw, target = collections.Counter(g for x in grams for g in x[part]), collections.Counter(g for k in good for g in grams[k][part])
            share = sum(target.values()) / sum(raw.values())
            for g in grams[i][part]:
                ratio = math.log((target[g] - (i in good) + share) / (share * (raw[g] - 1 + 1)))
                total += ratio if abs(ratio) >= 0.5 else 0
        assert got[i].log_weight == pytest.approx(total, abs=1e-4)
    order = sorted(got.values(), key=lambda r: (-r.key, r.doc_id))
    assert made.k == 20 and {r.doc_id for r in made.scored.where(made.drawn(F.col("key"), F.col("doc_id"))).collect()} == {r.doc_id for r in order[:20]}
    assert importance.resample(docs, labels, bits=bits, share=0.25).where("kept").count() == 15


def test_draws_follow_the_weights(spark):
    weights = {i: w for i, w in enumerate([2.0, 1.0, 0.0, -1.0, 1.5, 0.5])}
    seeds = 3000
    table = spark.createDataFrame(list(weights.items()), "doc_id long, w double").crossJoin(spark.range(seeds).withColumnRenamed("id", "seed"))
    keys = [importance._key(F.col("w"), 1.0, s) for s in (1, 2)]
    first = table.limit(1).select(*keys).first()
    assert first[0] != first[1]  # another seed, other noise
    # the hash of id and seed, for many seeds at once
    unit = (F.pmod(F.xxhash64("doc_id", F.col("seed").cast("int")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    best = table.withColumn("key", F.col("w") - F.log(-F.log(unit))).groupBy("seed").agg(F.max_by("doc_id", "key").alias("doc_id"))
    drawn = {r.doc_id: r["count"] / seeds for r in best.groupBy("doc_id").count().collect()}
    total = sum(math.exp(w) for w in weights.values())
    for i, w in weights.items():
        assert drawn.get(i, 0) == pytest.approx(math.exp(w) / total, abs=0.03)


def test_cosine_against_brute_force():
    """Weights, cosines and the best template by plain vectors over all words."""
    rnd = random.Random(15)
    names = [f"t{i}" for i in range(8)]
    templates = tuple((n, " ".join(rnd.choice(["licence", "a", "b", "c", "d", "e", "f"]) for _ in range(rnd.randint(3, 9))) + " license") for n in names)
    m = licenses.Matcher(templates)
    bags = [collections.Counter(t.split()) for _, t in templates]
    weight = lambda w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1
    for _ in range(100):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))] + ["license"]
        bag = collections.Counter(words)
        cosines = []
        for b in bags:
            dot = sum(bag[w] * b[w] * weight(w) ** 2 for w in bag)
            cosines.append(dot / math.sqrt(sum((n * weight(w)) ** 2 for w, n in bag.items()) * sum((n * weight(w)) ** 2 for w, n in b.items())))
        score, name = m.best(" ".join(words))
        assert score == pytest.approx(max(cosines)) and cosines[names.index(name)] == pytest.approx(max(cosines))
