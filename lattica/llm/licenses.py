"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Passages are the lines of a text, its blocks between blank lines, and the whole text. They are compared to notices (headers) and titles of licences; the
whole text, and the text without its first and second block (a title, a copyright line), are compared to licences' whole texts too. Document frequencies of the
templates' words are counted over all texts; words of no template weigh as the rarest. A match is a cosine of at least `least`.
A text's licence is that of the best match with a licence's whole text, or else with a title that it begins with (long licences are known by
these), or else of any passage with a notice or title. In the first two cases, and if the passage makes up at least `share` of its words, a file is a licence file; a directory has the licence of its licence
file (the first by path). A file without a licence of its own takes that of its nearest ancestor directory which has one, by joins over
directories' paths, so that files meet only one row of their own directory.

A text is compared to those templates only of which it holds words of enough weight: the cosine of a passage to a template is at most the length
of the template's part in the passage's words over the template's length (Cauchy-Schwarz), and a passage has no words but its text's.

Defined cases: null and empty texts hold no licence; a null path has no directory and inherits nothing; rows that repeat a path are judged each
by itself, and where they are licence files the least (doc_id, licence) counts for the directory; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import stored, table, word_array

#: Public notices, fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Distributed under the GNU General Public License v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
}
#: Titles that long licences begin with, fixed values.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
}
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole texts of short licences, fixed values.
FULL = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": f"{_CONDITIONS} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
#: What a template is compared to.
NOTICE, TITLE, WHOLE = "notice", "title", "whole"
LEAST, SHARE = 0.8, 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def _vector(words: Counter, idf: dict[str, float], most: float) -> tuple[dict[str, float], float]:
    v = {w: (1 + math.log(n)) * idf.get(w, most) for w, n in words.items()}
    return v, math.sqrt(sum(x * x for x in v.values()))


Template = tuple[str, str, dict[str, float], float]


def templates_of(idf: dict[str, float], most: float) -> list[Template]:
    """(licence, what it is compared to, vector, its length) of each template."""
    said = [(name, NOTICE, t) for name, ts in TEMPLATES.items() for t in ts] + [(name, TITLE, t) for name, t in TITLES.items()] + [(name, WHOLE, t) for name, t in FULL.items()]
    return [(name, kind, *_vector(Counter(terms(t)), idf, most)) for name, kind, t in said]


def vocabulary() -> list[str]:
    return sorted({w for _, _, t, _ in templates_of({}, 1.0) for w in t})


def best(text: str, templates: list[Template], idf: dict[str, float], most: float, least: float = 0.0) -> tuple[str | None, float, bool, float]:
    """Licence and cosine of the best match (a licence's whole text before its title at the head before any passage; then the most similar, template order, the
    longer passage), whether it is of the first two kinds, and its share of the text's words. Templates that no passage can come within `least` of are left out."""
    found = terms(text)
    whole, held = len(found), idf.keys() & found
    top: list[tuple[str | None, float, bool, float]] = [(None, 0.0, False, 0.0)] * 3
    if not held:
        return top[0]
    near = [x for x in templates if math.sqrt(sum(v * v for w, v in x[2].items() if w in held)) >= (least - 1e-9) * x[3]]
    if not near:
        return top[0]
    blocks = [b for b in re.split(r"\n[ \t]*\n", text) if b.strip()]
    bodies = {text, *("\n\n".join(blocks[k:]) for k in (1, 2))}
    heads = {*blocks[:1], text.strip().split("\n")[0]}
    for p in dict.fromkeys([text, *blocks, *bodies, *text.split("\n")]):
        words = Counter(terms(p))
        if not any(w in idf for w in words):
            continue
        v, norm = _vector(words, idf, most)
        for name, kind, t, t_norm in near:
            if kind == WHOLE and p not in bodies:
                continue
            tier = 0 if kind == WHOLE else 1 if kind == TITLE and p in heads else 2
            cos = sum(x * t[w] for w, x in v.items() if w in t) / (norm * t_norm)
            if cos >= least and cos > top[tier][1] + 1e-12:
                top[tier] = (name, cos, tier < 2, sum(words.values()) / whole)
    return next((x for x in top if x[0]), top[2])


def own(files: DataFrame, least: float = LEAST) -> DataFrame:
    """`files` (key columns, path, text) with _m (licence, cosine, file, share) of the most similar passage, right where its cosine is at least `least`."""
    known = vocabulary()
    total = files.count()
    met = files.select(F.explode(F.array_intersect(word_array(F.col("text")), F.array(*[F.lit(w) for w in known]))).alias("w"))
    df = {r["w"]: r["n"] for r in met.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the templates' words at most
    most = math.log(total + 1) + 1
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for w in known}
    templates = templates_of(idf, most)

    @F.arrow_udf("struct<licence:string,cosine:double,file:boolean,share:double>")
    def compared(texts: pa.Array) -> pa.Array:
        rows = [dict(zip(("licence", "cosine", "file", "share"), best(t.as_py(), templates, idf, most, least), strict=True)) if t.is_valid else None for t in texts]
        return pa.array(rows, pa.struct([("licence", pa.string()), ("cosine", pa.float64()), ("file", pa.bool_()), ("share", pa.float64())]))

    return files.withColumn("_m", compared("text"))


def parent(path: F.Column) -> F.Column:
    """The directory of a path; none for a path without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", ""))


def scan(files: DataFrame, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """doc_id, path, licence, cosine, how ("own", "inherited" or null), from_dir for each row of `files` (doc_id, path, text)."""
    judged = own(files.select("doc_id", "path", "text"), least)
    ok = F.col("_m.cosine") >= least
    rows = stored(judged.select("doc_id", "path", parent(F.col("path")).alias("_dir"), F.when(ok, F.col("_m.licence")).alias("_own"), F.when(ok, F.col("_m.cosine")).alias("cosine"), (ok & (F.col("_m.file") | (F.col("_m.share") >= share))).alias("_is_file")), "licence-rows")
    has = rows.filter("_is_file and _dir is not null").groupBy("_dir").agg(F.min_by("_own", F.struct("path", "doc_id", "_own")).alias("_licence"))
    # Each directory meets its ancestors, itself included; the deepest one with a licence wins.
    dirs = rows.select("_dir").filter("_dir is not null").distinct()
    steps = F.split("_dir", "/")
    up = dirs.select(F.col("_dir").alias("_of"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("_depth", "_dir"))
    near = up.join(has, "_dir").groupBy("_of").agg(F.max_by(F.struct("_licence", "_dir"), "_depth").alias("_near"))
    out = rows.join(near.select(F.col("_of").alias("_dir"), "_near"), "_dir", "left")
    inherited = F.col("_own").isNull() & F.col("_near").isNotNull()
    how = F.when(F.col("_own").isNotNull(), F.lit("own")).when(inherited, F.lit("inherited"))
    return out.select("doc_id", "path", F.coalesce("_own", "_near._licence").alias("licence"), "cosine", how.alias("how"), F.when(inherited, F.col("_near._dir")).alias("from_dir"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` has no paths, so its rows stand in a tree source / thousand / fifty / doc_id."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(n / 1000), F.floor(n / 50), F.col("doc_id"))
    return scan(d.select("doc_id", path.alias("path"), "text"))
