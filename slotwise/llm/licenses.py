"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from ancestor directories.

Whole texts are searched. A line, sentence or block of lines that holds a licence word, and the text as a
whole if it holds one, is a notice; its
TF-IDF vector over words (weights from the templates, words outside them at the weight of a word in no
template) is compared with every template, and the best cosine of at least `threshold` names the
licence. A file whose name or coverage makes it a licence file speaks for its directory. A file without
a notice of its own takes the licence of its nearest ancestor directory that has one: distinct
directories are exploded to their ancestors and joined, then files join their directory's row, so the
number of files in a directory does not multiply anything.

Null text has no notice, a null path no directory; repeated rows give repeated results; of several
licence files in a directory the one with the largest cosine counts, then the smallest path. Empty
tables give no rows. Input columns named as one of the results are replaced, others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import add_columns, column, unused, without

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Notices by SPDX identifier, whole texts or shortened to what tells them apart.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    *((name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.") for name, what, kind, version in (("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"))),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.") for name, kind in (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"))),
    *((name, f"SPDX-License-Identifier: {name}{suffix}") for name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for suffix in (("", "-only", "-or-later") if "GPL" in name else ("",))),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is licensed under CC0 1.0 Universal, dedicated to the public domain."),
)
#: One of these stands in every template.
TRIGGERS = ("licens", "permission", "redistribut", "public domain", "free software", "creative commons")
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SAME = 0.95  # cosine from which a notice is all licence


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        bags = [Counter(_WORD.findall(t.lower())) for _, t in templates]
        seen = Counter(w for b in bags for w in b)
        self.names = [n for n, _ in templates]
        # templates of a caller's own may hold no licence word: then any text can be a notice
        self.triggers = TRIGGERS if all(any(w in t.lower() for w in TRIGGERS) for _, t in templates) else ("",)
        self.weight = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
        self.unknown = math.log(1 + len(bags)) + 1
        self.posting: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.weight[w]) ** 2 for w, n in bag.items()))
            for w, n in bag.items():
                self.posting.setdefault(w, []).append((i, n * self.weight[w] / norm))

    def best(self, text: str) -> tuple[float, str | None]:
        """Largest cosine and its template's name; ties go to the first template."""
        scores = [0.0] * len(self.names)
        square = 0.0
        for w, n in Counter(_WORD.findall(text.lower())).items():
            x = n * self.weight.get(w, self.unknown)
            square += x * x
            for i, y in self.posting.get(w, ()):
                scores[i] += x * y
        if not square:
            return 0.0, None
        i = max(range(len(scores)), key=lambda j: (scores[j], -j))
        return scores[i] / math.sqrt(square), self.names[i]

    def scan(self, text: str | None) -> tuple[float, str | None, int]:
        """Best cosine over the notices of a whole text, its name, and the words of the notice or of a longer one that is all that licence."""
        lower = (text or "").lower()
        if not any(t in lower for t in self.triggers):
            return 0.0, None, 0
        lines = text.split("\n")
        hit = [i for i, line in enumerate(lines) if any(t in line.lower() for t in self.triggers)]
        notices: dict[str, None] = {}
        for i in hit:
            notices[lines[i]] = None
            notices.update((s, None) for s in _SENTENCE.split(lines[i]) if any(t in s.lower() for t in self.triggers))
        a = 0
        while a < len(hit):  # blocks of lines without an empty one between, around the hits
            lo = hi = hit[a]
            while lo and lines[lo - 1].strip():
                lo -= 1
            while hi + 1 < len(lines) and lines[hi + 1].strip():
                hi += 1
            notices["\n".join(lines[lo : hi + 1])] = None
            while a < len(hit) and hit[a] <= hi:
                a += 1
        notices[text] = None
        scored = [(*self.best(n), len(n.split())) for n in notices]
        score, name, words = max(scored, key=lambda x: x[0])
        if not score:
            return 0.0, None, 0
        # a paragraph can be a closer match than the licence's whole text with the holder's name in it
        return score, name, max([words, *(w for s, m, w in scored if m == name and s >= _SAME)])


def scan_notices(df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """Columns licence, cosine and coverage (words of the notice over words of the text) of each row's own notice."""
    made: list[Matcher] = []

    def judge(batch: pa.RecordBatch) -> list:
        if not made:
            made.append(Matcher(templates))
        names, scores, covers = [], [], []
        for t in column(batch, text).to_pylist():
            score, name, words = made[0].scan(t)
            passed = score >= threshold - 1e-12
            names.append(name if passed else None)
            scores.append(round(score, 6))
            covers.append(round(words / max(1, len(t.split())), 6) if passed else 0.0)
        return [names, scores, covers]

    return add_columns(df, judge, [T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("coverage", T.DoubleType())], keep, [text])


def inherit(files: DataFrame, file_coverage: float = 0.5, broadcast_rows: int = 500_000) -> DataFrame:
    """files (path, licence, cosine, coverage, ...) with licence_file, directory, effective_licence, inherited_from and method."""
    files = without(files, ["directory", "licence_file", "effective_licence", "inherited_from", "method"])
    nearest_ = unused(files, "_nearest")
    f = files.withColumn("directory", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    f = f.withColumn("licence_file", F.col("licence").isNotNull() & (F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False)) | (F.col("coverage") >= file_coverage)))
    order = F.struct(-F.col("cosine"), F.col("path"), F.col("licence"))
    speaks = f.where("licence_file and directory is not null").groupBy("directory").agg(F.min_by("licence", order).alias("_licence")).withColumnRenamed("directory", "_ancestor")
    # a directory's ancestors, the root among them, are looked up in a table of those that have a licence
    speaks = F.broadcast(speaks) if speaks.limit(broadcast_rows + 1).count() <= broadcast_rows else speaks
    places = f.where("directory is not null").select("directory").distinct()
    depth = F.explode(F.sequence(F.lit(0), F.size(F.split("directory", "/"))))
    up = places.select("directory", depth.alias("_depth")).withColumn("_ancestor", F.expr("array_join(slice(split(directory, '/'), 1, _depth), '/')"))
    nearest = up.join(speaks, "_ancestor").groupBy("directory").agg(F.max(F.struct("_depth", "_ancestor", "_licence")).alias(nearest_))
    # a directory can hold most of the files, which then don't meet in one task
    nearest = F.broadcast(nearest) if nearest.limit(broadcast_rows + 1).count() <= broadcast_rows else nearest
    out = f.join(nearest, "directory", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in f.columns],
        F.coalesce("licence", F.col(f"{nearest_}._licence")).alias("effective_licence"),
        F.when(~own, F.col(f"{nearest_}._ancestor")).alias("inherited_from"),
        F.when(own & F.col("licence_file"), "file").when(own, "notice").when(F.col(nearest_).isNotNull(), "inherited").otherwise("none").alias("method"),
    )
