"""The pipeline's near-dedup against brute force."""

import random

import corpus_pipeline
from lattica.llm import neardup


def edited(words, changes, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(base)
        for share in (0.005, 0.015, 0.03, 0.06):
            rows.append(edited(base, max(1, int(len(base) * share)), rng))
    texts = [" ".join(w) for w in rows] + ["", None, "one two", "One  two", "one three"]
    return list(enumerate(texts))


def groups(rows):
    sets = {i: neardup.shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and neardup.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def test_stage_against_brute_force(spark):
    rows = corpus()
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = groups(rows)
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < len(rows)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 1)
    rows = corpus()
    assert {r["doc_id"] for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == groups(rows)


def test_hashes_are_the_shingles():
    for _, t in corpus():
        assert len(neardup.hashes(t)) == len(neardup.shingles(t))


def test_copies_meet_the_text_they_were_made_from(spark, monkeypatch):
    """Copies that are LEAST alike to one text, but not to one another, are linked by comparisons that grow with the group, not its square."""
    monkeypatch.setattr(neardup, "HOT", 20)
    compared, verified = [], neardup._verified

    def counted(pairs, *more):
        compared.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(neardup, "_verified", counted)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    rows = list(enumerate(" ".join(w) for w in [*(edited(base, 4, rng) for _ in range(200)), base]))
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert groups(rows) == {0} and got.count() <= 5  # the plan may miss a pair in a hundred or so, as all have one end in common
    assert sum(compared) < 10 * len(rows)


def test_copies_too_far_from_their_text_arent_read_pair_by_pair(spark, monkeypatch):
    """Copies with so many edits of their own that none is LEAST alike to another or to their text, but for a few that are: large buckets
    don't read the texts of all their pairs."""
    monkeypatch.setattr(neardup, "HOT", 20)
    compared, verified = [], neardup._verified

    def counted(pairs, *more):
        compared.append(pairs.distinct().count())
        return verified(pairs, *more)

    monkeypatch.setattr(neardup, "_verified", counted)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    far = [edited(base, 6, rng) for _ in range(200)]
    shorter = [w[: len(w) - k] for k, w in enumerate(far[:5])]  # linked to these only, not to the text
    rows = list(enumerate(" ".join(w) for w in [base, *far, *(edited(w, 1, rng) for w in far[-15:]), *shorter]))
    got = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == groups(rows)
    assert sum(compared) < len(rows) ** 2 / 8  # most of these are of buckets of up to HOT nodes


def test_what_nodes_have_beside_the_middle_rules_out_no_link(spark):
    """_POSSIBLE holds for every pair that is LEAST alike, whatever the middle: edits in common, cuts, empty and short texts."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(50)}" for _ in range(80)]
    some = [base, base[:70], base[10:], edited(base, 2, rng), [], base[:3], base[:64]]
    some += [edited(w, k, rng) for w in some[:4] for k in (1, 2, 3)]
    texts = [" ".join(w) for w in some]
    rows = [(i, j, m, texts[i], texts[j], texts[m]) for i in range(len(some)) for j in range(len(some)) for m in range(7)]
    df = spark.createDataFrame(rows, "i long, j long, m long, x string, y string, z string").withColumn("p", neardup._beside("z", "x")).withColumn("q", neardup._beside("z", "y"))
    got = df.selectExpr("i", "j", "p._i _ia", "q._i _ib", "p._z _za", "q._z _zb", "p._d _da", "q._d _db").selectExpr("i", "j", f"{neardup._POSSIBLE} ok").collect()
    sets = [neardup.shingles(t) for t in texts]
    linked = [r["ok"] for r in got if neardup.jaccard(sets[r["i"]], sets[r["j"]]) >= 0.8]
    assert all(linked) and 100 < len(linked) < sum(r["ok"] for r in got) < len(got)
