"""Notices without a word like licence count as others do."""

import math
import random
import re
from collections import Counter

from lattica.llm import licenses


def test_notices_without_a_marker(spark):
    rows = [(1, "a/x", "Released under MIT."), (2, "b/NOTE", "CC BY-NC 4.0"), (3, "b/c/y", "plain words"), (4, "d/z", "of the and to")]
    rows += [(k, f"e/{k}", f"under the license of number {k}" if k % 2 else f"words by and of the {k}") for k in range(10, 200)]
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "own") and got[2] == ("CC-BY-NC-4.0", "own") and got[3] == ("CC-BY-NC-4.0", "inherited") and got[4] == (None, None)


MIT_FILE = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses.FULL["MIT"].replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
BSD_FILE = "Copyright 2019 The Authors. All rights reserved.\n\n" + licenses.FULL["BSD-3-Clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ")
APACHE_FILE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n\n" + "\n\n".join(f"clause {k} says what every clause of this kind says about contributors" for k in range(60))


def test_licence_files_give_their_directory_a_licence(spark):
    rows = [(1, "m/LICENSE", MIT_FILE), (2, "m/src/a", "plain words"), (3, "b/LICENSE", BSD_FILE), (4, "b/x", "plain"), (5, "a/LICENSE", APACHE_FILE), (6, "a/x/y", "text"), (7, "h/z", "Distributed under the GNU General Public License v3"), (8, "g/y", None)]
    rows += [(k, f"e/{k}", f"ordinary words number {k} of a text that has no licence") for k in range(10, 100)]
    got = {r["doc_id"]: (r["licence"], r["how"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k] for k in range(1, 9)] == [("MIT", "own"), ("MIT", "inherited"), ("BSD-3-Clause", "own"), ("BSD-3-Clause", "inherited"), ("Apache-2.0", "own"), ("Apache-2.0", "inherited"), ("GPL-3.0", "own"), (None, None)]
    assert not any(got[k][0] for k in range(10, 100))


def test_scan_against_brute_force(spark):
    """Every passage against every template by plain dense cosines, every file against every directory above it."""
    rng = random.Random(4)
    pool = [t for ts in licenses.TEMPLATES.values() for t in ts] + [*licenses.TITLES.values(), *licenses.FULL.values()]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(pool).split()
            for _ in range(rng.randrange(0, 1 + len(w) // 3)):
                w[rng.randrange(len(w))] = rng.choice(["zebra", "the", "of", "License"])
            parts.append(" ".join(w))
        parts += [" ".join(rng.choice(["river", "stone", "the", "software", "and"]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((k, None if k == 7 else "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) + f"/f{k}", None if k == 9 else rng.choice(["\n", "\n\n", "\n \n"]).join(parts)))
    rows += [(200, rows[0][1], "Released under the MIT License."), (201, rows[0][1], "Licensed under CC BY 4.0."), (202, "a/long", "word " * 50_000 + "\nReleased under the MIT License.")]
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_dir"]) for r in licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, _own string, _near int")).collect()}

    texts = [t for *_, t in rows]
    said = [(n, licenses.NOTICE, t) for n, ts in licenses.TEMPLATES.items() for t in ts] + [(n, licenses.TITLE, t) for n, t in licenses.TITLES.items()] + [(n, licenses.WHOLE, t) for n, t in licenses.FULL.items()]
    names = sorted({w for *_, t in said for w in licenses.terms(t)})
    total = len(texts)
    df = {w: sum(w in set(licenses.terms(t or "")) for t in texts) for w in names}
    weight = lambda w: math.log((total + 1) / (df[w] + 1)) + 1 if w in df else math.log(total + 1) + 1

    def vector(t):
        c = Counter(licenses.terms(t))
        return {w: (1 + math.log(n)) * weight(w) for w, n in c.items()}

    def cosine(a, b):
        dot = sum(a.get(w, 0.0) * b[w] for w in b)
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0

    vectors = [(n, kind, vector(t)) for n, kind, t in said]
    mine, of_dir = {}, {}
    for i, path, t in rows:
        tops = [(0.0, None, False)] * 3
        blocks = [b for b in re.split(r"\n[ \t]*\n", t or "") if b.strip()]
        wholes = [t or "", "\n\n".join(blocks[1:]), "\n\n".join(blocks[2:])]
        for p in [*wholes[:1], *blocks, *wholes[1:], *(t or "").split("\n")]:
            v = vector(p)
            for n, kind, x in vectors:
                tier = 0 if kind == licenses.WHOLE else 1 if kind == licenses.TITLE and p in [*blocks[:1], (t or "").strip().split("\n")[0]] else 2
                if tier or p in wholes:
                    c = cosine(v, x)
                    if c >= licenses.LEAST and c > tops[tier][0] + 1e-12:
                        tops[tier] = (c, n, tier < 2 or len(licenses.terms(p)) >= licenses.SHARE * len(licenses.terms(t)))
        top = next((x for x in tops if x[1]), tops[2])
        mine[i] = top[1]
        if path and mine[i] and top[2]:
            of_dir.setdefault(path.rsplit("/", 1)[0], []).append((path, i, mine[i]))
    for i, path, _ in rows:
        want = (mine[i], "own", None) if mine[i] else (None, None, None)
        d = path.rsplit("/", 1)[0] if path and not mine[i] else ""
        while d and want[0] is None:
            if d in of_dir:
                want = (min(of_dir[d])[2], "inherited", d)
            d = d.rsplit("/", 1)[0] if "/" in d else ""
        assert got[i] == want, (i, path)
