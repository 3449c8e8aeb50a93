"""Defined cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, licenses, linededup, lm_score, packing, quality, secrets, sharding, simhash, topk
from lattica.llm.components import components

SCHEMA = "doc_id long, text string, _rid string, key string, _row long, _runs int"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
ROWS = [
    (1, None, "a", "b", 1, 2), (2, "", "a", None, 1, 2), (None, "one two three", None, "b", 1, 2), (3, "Ten words make One window of this item here now.", "a", "b", 1, 2),
    (3, "Ten words make One window of this item here now.", "a", "b", 1, 2), (3, "another text of a repeated id", "a", "b", 1, 2), (4, LONG, "x", "y", 0, 0), (5, LONG + " tail", "x", "y", 0, 0), (6, "\n\n \n", "x", "y", 0, 0),
]
BENCH = [(10, "ten words make one window of this item here now and more"), (11, "81"), (12, None), (13, ""), (None, "repeated id"), (11, "81")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def test_decontaminate(docs, none, bench):
    got = decontaminate.report(docs, bench).collect()
    assert len(got) == len(ROWS)
    tens = [r for r in got if r["n_words"] == 10]
    assert [(r["n_hit"], r["n_items"], r["items_sha256"]) for r in tens] == [(10, 1, hashlib.sha256(b"10").hexdigest())] * 2
    unlisted = next(r for r in got if r["n_words"] == 6)
    assert (unlisted["n_hit"], unlisted["n_items"], unlisted["contaminated"]) == (2, 0, True)
    assert decontaminate.report(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(docs, bench.limit(0)).collect())


def test_decontaminate_blocks_change_nothing(docs, bench):
    whole, parts = (sorted(decontaminate.hits(decontaminate.with_rid(docs.select("doc_id", "text")), bench, block=b).select("n_words", F.size("_runs")).collect()) for b in (1000, 1))
    assert whole == parts


def test_decontaminate_window_of_many_items(spark, docs):
    many = spark.createDataFrame([(k, "ten words make one window of this item here now" + " and more" * (k % 2)) for k in range(50)], "item_id long, text string")
    wins, holders = decontaminate.windows(many)
    assert wins.count() == 3 and holders.count() == 100
    got = decontaminate.hits(decontaminate.with_rid(docs.select("doc_id", "text")), many, block=1).filter(F.size("_items") > 0)
    assert [len(r["_items"]) for r in got.collect()] == [50, 50]


def test_decontaminate_clean(docs, none, bench):
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns and got.schema == docs.schema
    texts = [r["text"] for r in got.collect()]
    assert len(texts) == len(ROWS) - 2 and "another text of a" in texts
    assert decontaminate.clean(docs, bench, mode="documents").count() == len(ROWS) - 3
    assert decontaminate.clean(none, bench).count() == 0
    with pytest.raises(ValueError, match="no such mode"):
        decontaminate.clean(docs, bench, mode="x")


def test_simhash_against_brute_force(spark):
    random.seed(3)
    base = [[random.choice("abcdefghij") * 3 + str(random.randrange(40)) for _ in range(60)] for _ in range(12)]
    texts = [None, "", " \n"]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                c[random.randrange(60)] = "z" + str(random.randrange(9))
            texts.append(" ".join(c))
    rows = [(None if k == 7 else k // 2 if k < 12 else k, t) for k, t in enumerate(texts)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    fps = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    assert got == sorted((i is None, i or 0, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True))


@pytest.mark.parametrize(("hot", "thresholds"), [(4, [0, 0, 0]), (48, [0, 0, 0]), (48, [1, 0])])
def test_simhash_hot_buckets_lose_no_link(spark, monkeypatch, hot, thresholds):
    random.seed(5)
    center = random.getrandbits(64)
    fps = {center}
    while len(fps) < 150:  # a chain of near values, all in the same buckets
        fps.add(random.choice(sorted(fps)) ^ (1 << random.randrange(10)) ^ (1 << random.randrange(10)))
    fps |= {random.getrandbits(64) for _ in range(50)}
    values = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "plan", lambda nodes, n, bits: list(zip(simhash.grouped_bits(simhash._gram(nodes), n, len(thresholds)), thresholds, strict=True)))
    nodes = spark.createDataFrame([(v,) for v in values], "_fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes)).collect()}
    group = {v: v for v in values}
    for a in values:
        for b in values:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    assert {v: got.get(v, v) for v in values} == group


@pytest.mark.parametrize("small", [10_000, 0])
def test_components(spark, small):
    """Chains, stars, a ring, self-loops, nulls and repeated edges, in one task and by stars."""
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    rng.shuffle(edges)
    odd = [(5, 5), (None, 7), (8, None), (-3, -9), (-9, -3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + odd, "a long, b long"), small=small).collect()}
    group: dict[int, int] = {}
    for a, b in [e for e in edges if e[0] != e[1]] + [(-3, -9)]:
        a, b = group.setdefault(a, a), group.setdefault(b, b)
        group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert got == group
    assert components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def test_simhash_thresholds():
    assert simhash.allocate([{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 30}], 0)[1] in ([0, 0], [1, -1])
    assert simhash.fingerprint("a b") == simhash.fingerprint("A  B\n")


def test_simhash_dedup(docs, none):
    got = simhash.dedup(docs)
    assert got.schema == docs.schema
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 3, 3, 4]
    assert simhash.dedup(none).count() == 0 and simhash.report(none).count() == 0


def test_line_dedup(spark, docs, none):
    shared = "\n".join(f"shared line {k} of a passage" for k in range(40))
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(k, f"own start {k}\n" * (k + 1) + shared + f"\nown end {k}") for k in range(4)] + [(9, long), (10, "head\n" + long + "\ntail"), (11, None), (12, ""), (13, "a\nb"), (14, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(d).collect()}
    assert got[0] == rows[0][1] and got[9] == long and got[11] is None and got[12] == "" and got[13] == "a\nb" and got[14] == "c"
    assert got[10] == "head\ntail"
    for k in (1, 2, 3):
        left = got[k].split("\n")
        assert f"own end {k}" in left and left.count(f"own start {k}") >= 1 and sum("shared" in x for x in left) < 12
    assert linededup.dedup(docs).schema == docs.schema and linededup.dedup(none).count() == 0
    counts = {r["doc_id"]: r["removed_lines"] for r in linededup.report(d).collect()}
    assert counts[0] == 0 and counts[10] == 1 and counts[2] > 28


def test_line_chunks_give_the_text_again():
    random.seed(1)
    for _ in range(50):
        text = "\n".join(random.choice(["", "a", "bb c", "x " * 60]) for _ in range(random.randrange(30)))
        assert "\n".join(x for c, _ in linededup.chunks(text) for x in c) == text


def test_shard(docs, none):
    rows = sharding.shard(docs).collect()
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t, *_ in ROWS)
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["size"] == 1}) == 1
    assert sharding.shard(none).count() == 0


def test_shard_runs_are_the_heap():
    random.seed(2)
    for k in range(60):
        sizes = [(s, random.randrange(1, 60)) for s in sorted(random.sample(range(1, 500), 12), reverse=True)]
        if k % 3 == 0:
            sizes = [(40_000 * (1 + k % 2), 1 + k % 4), *sizes]  # groups that outweigh a shard
        runs, loads = list(sharding.lpt_runs(sizes)), [0] * 8
        for size, n in sizes:
            own = [r for r in runs if r[0] == size]
            assert len(own) <= 8
            for rank in range(n):
                want = loads.index(min(loads))
                loads[want] += size
                assert [turn[(rank - a) % len(turn)] for _, a, z, turn in own if a <= rank < z] == [want]


def test_shard_places_are_the_heap(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randrange(1, 40) + rng.choice("abc") for _ in range(400)] + ["hot"] * 300 + [None, "", "é", "é"]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shards_of: dict[str, set] = {}
    for r in rows:
        shards_of.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
    assert all(len(s) == 1 for s in shards_of.values()) and len(shards_of) == len({t or "" for t in texts})
    want, groups = [0] * 8, {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    for size in sorted(groups.values(), reverse=True):
        want[want.index(min(want))] += size
    got = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert got == want


def test_pack(docs, none):
    rows = packing.pack(docs, ids=True).collect()
    encode = packing.Encoder()
    by = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    whole = sorted(b"".join(r["ids"] for r in sorted(g, key=lambda r: r["piece"])) for g in ([r for r in rows if r["doc_id"] == i] for i in (4, 5)))
    assert whole == sorted(encode(t) + b"\0\0\0\0" for i, t, *_ in ROWS if i in (4, 5))
    assert sum(r["length"] for r in rows) == sum(len(encode(t)) // 4 + 1 for _, t, *_ in ROWS)
    assert packing.pack(none).count() == 0


def test_pack_encoder_matches_the_tokenizer():
    e = packing.Encoder()
    for t in ["a'b don't 'S x²y½ Ünïcode éle  nb sp _a_b 12ab c3 <|endoftext|>", "ǅ İstanbul ΣΑΣ. ", "x\x1cy z\x85w", "ﬁne ½ Å é", "'s 't ''q'' (p) a-b--c", "한국어 日本語!?!", "", " \n"]:
        assert list(np.frombuffer(e(t), "<u4")) == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_plan_is_close_to_the_bound():
    random.seed(4)
    spread = {n: random.randrange(1, 9) for n in range(1, 2048)}
    # The least number of sequences: by volume, or (second case) by the only fillings that there are.
    for lengths, least in [(spread, -(-sum(k * v for k, v in spread.items()) // 2048)), ({700: 999, 650: 500, 5: 2000}, 625), ({1: 5000}, 3), ({2048: 3, 2047: 2, 1: 1}, 5), ({1025: 10}, 10)]:
        got = packing.plan(lengths)
        back = {}
        for content, n in got:
            assert sum(content) <= packing.CAPACITY
            for x in content:
                back[x] = back.get(x, 0) + n
        assert back == lengths
        assert least <= sum(n for _, n in got) <= least * 1.02 + 1


@pytest.mark.parametrize("draw", ["spread", "middle", "wide", "lognormal"])
def test_pack_plan_is_never_longer_than_best_fit(draw):
    rng = np.random.default_rng(7)
    drawn = {"spread": rng.integers(1, 2049, 3000), "middle": rng.integers(300, 901, 3000), "wide": rng.integers(200, 1201, 3000), "lognormal": np.clip(rng.lognormal(6, 1, 3000).astype(int), 1, 2048)}[draw]
    rooms: list[int] = []
    for n in sorted(drawn.tolist(), reverse=True):
        k = min((r for r in rooms if r >= n), default=None)
        if k is None:
            rooms.append(2048 - n)
        else:
            rooms[rooms.index(k)] = k - n
    lengths = dict(zip(*(x.tolist() for x in np.unique(drawn, return_counts=True)), strict=True))
    assert sum(n for _, n in packing.plan(lengths)) <= len(rooms)


def test_pack_ids_are_the_tokenizers(spark):
    texts = ["Ten words, it's 12ab!", None, "", "Ünïcode éle x²y½ 한국어", "w " * 5000, "no" * 3000]
    by: dict[int, list] = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ids=True).collect():
        by.setdefault(r["doc_id"], []).append(r)
    tokenizer = packing.Encoder().tokenizer
    for i, t in enumerate(texts):
        got = sorted(by[i], key=lambda r: r["piece"])
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(r["ids"] for r in got), "<u4").tolist() == want
        assert [(r["start"], r["length"]) for r in got] == [(s, min(2048, len(want) - s)) for s in range(0, len(want), 2048)]


def test_quality(spark, docs, none):
    random.seed(6)
    good = [" ".join(random.choice(["the", "a", "river", "stone", "walks"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(random.choice(["BUY!!", "NOW%%", "###", "the"]) for _ in range(40)) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    got = quality.classify(d, lab).collect()
    assert all(r["predicted"] == int(r["doc_id"] < 150) for r in got if r["held_out"]) and sum(r["held_out"] for r in got) > 40
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    odd = quality.classify(docs, lab).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd) and len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify(none, lab).count() == 0
    assert {r["score"] for r in quality.classify(docs, lab.limit(0)).collect()} == {0.5}
    assert quality.filtered(docs, lab, threshold=0.0).schema == docs.schema


def test_quality_against_dense_vectors(spark):
    """The same model from dense matrices: log-count ratios, dual coordinate descent in the same order, Platt's logistic by plain gradient steps."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["calm", "sea", "river"] if k % 3 else ["WIN", "now", "river"]) for _ in range(rng.randrange(0, 12))) for k in range(60)]
    labels = [(k, int(k % 3 > 0)) for k in range(50)] + [(4, 0)]  # an id labelled twice
    got = {r["doc_id"]: r["score"] for r in quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def dense(t):
        b, x = t.encode(), np.zeros(quality.FEATURES)
        for i in range(len(b) - 1):
            x[((b[i] << 8 | b[i + 1]) * 0x9E3779B1 % 2**32) >> 18] = 1
        for i in range(len(b) - 3):
            x[quality.FEATURES // 4 + ((int.from_bytes(b[i : i + 4], "big") * 0x85EBCA6B % 2**32) >> 16) % (quality.FEATURES * 3 // 4)] = 1
        return x

    rows = sorted((k, q) for k, q in labels if zlib.crc32(str(k).encode()) % 4 != 2)
    x, y = np.stack([dense(texts[k]) for k, _ in rows]), np.array([1.0 if q else -1.0 for _, q in rows])
    up, down = x[y > 0].sum(axis=0) + 1, x[y < 0].sum(axis=0) + 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    scaled = lambda m: m * ratio / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    z = np.hstack([scaled(x), np.ones((len(x), 1))])
    cost, w, alpha, order = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())), np.zeros(z.shape[1]), np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(quality.PASSES):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (z[i] @ w) - 1) / (z[i] @ z[i]), 0), cost[i])
            w, alpha[i] = w + (new - alpha[i]) * y[i] * z[i], new
    margin, target = z @ w, np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    p = np.array([1.0, 0.0])
    for _ in range(200_000):
        q = 1 / (1 + np.exp(-(margin * p[0] + p[1])))
        p -= 0.02 * np.array([(q - target) @ margin, (q - target).sum()]) / len(y) * 5
    all_ = np.hstack([scaled(np.stack([dense(t) for t in texts])), np.ones((len(texts), 1))]) @ w
    assert np.allclose([got[k] for k in range(60)], 1 / (1 + np.exp(-(all_ * p[0] + p[1]))), atol=1e-4)


def test_secrets(spark, docs, none):
    key = "AKIA" + "Q7" * 8
    token = "aB3" * 14
    rows = [(1, f"é id {key} and {token} at s3://bucket/x"), (2, f"only {token} and ftp://host/path"), (3, "token=token:abcdefg PassWord = 'hunter22' api_key:short"), (4, "f" * 24 + " " + "0" * 23), (5, key + " " * 900 + token), (None, None), (6, ""), (6, "")]
    got = {(r["doc_id"], r["spans"], r["n_assign"], r["n_access"], r["n_hex"], r["n_linked"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, "access:5:25,token:30:72,endpoint:76:89", 0, 1, 0, 2), (2, "", 0, 0, 0, 0), (3, "assign:20:40", 1, 0, 0, 0), (4, "hex:0:24", 0, 0, 1, 0), (5, "access:0:20", 0, 1, 0, 0), (None, "", 0, 0, 0, 0), (6, "", 0, 0, 0, 0),
    }
    assert secrets.scan(docs).count() == len(ROWS) and secrets.scan(none).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 16)) / 4
    v[100:180] = v[50]  # ties
    rows = [(k, [float(x) for x in row], 1) for k, row in enumerate(v)] + [(900, None, 1), (950, [None] + [0.1] * 15, 1), (1000, [float("nan")] + [0.1] * 15, 1), (50, [0.5] * 16, 2), (None, [0.1] * 16, 3)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 50 == 0).collect()
    kept = [(i, np.floor(256 * np.array(np.float32(e), dtype=float)).astype(int)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, x in kept:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in kept if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sum(q == 50 for q, *_ in want) == 10
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (50, [2.0, 2.0]), (3, []), (4, [1e9, 1.0]), (5, [1e38, 1.0]), (100, [200_000.0, 1.0]), (6, [100_000.0, 0.5])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()]
    x = {i: [math.floor(256 * c) for c in e] for i, e in rows if len(e) == 2 and abs(e[0]) < 1e6}
    want = [(q, k + 1, i, s) for q in (50, 100) for k, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(x[q], y, strict=True)), i) for i, y in x.items() if i != q), key=lambda t: (-t[0], t[1]))[:5])]
    assert sorted(got) == sorted(want)


def test_lm_scores(docs, none):
    got = lm_score.lm_scores(docs, head=20, listed=1).collect()
    counts: dict[bytes, int] = {}
    words = [(i, lm_score.words(t) + [b""]) for i, t, *_ in ROWS]
    learn = [w for i, w in words if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    for w in learn:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(w), sum(x in counts for x in w), round(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for _, w in words)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_score.lm_scores(none).count() == 0


def test_lm_probabilities_sum_to_one():
    m = lm_score.Gru(np.array([9.0, 5, 3, 2, 1]), 4, hidden=6, n_classes=3)
    m.fit([np.array([1, 2, 5, 0] * 8)] * 3, streams=2, window=4, updates=1, passes=2)
    state = np.random.default_rng(1).standard_normal((2, 6)).astype(np.float32)
    total = sum(np.exp(m.log_prob(state, np.array([w, w]))) for w in range(6))
    assert np.allclose(total, 1, atol=1e-5)


def test_lm_documents_score_as_a_plain_run():
    """State carried over windows, and documents of all lengths together, against one step after another."""
    rng = np.random.default_rng(3)
    m = lm_score.Gru(np.array([9.0, 5, 3, 2, 1]), 4, hidden=6, n_classes=3)
    docs = [np.append(rng.integers(1, 6, n), 0) for n in (0, 1, 63, 64, 65, 200, 3)]
    m.fit(docs, window=8)
    p = {k: w.astype(float) for k, w in m.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    for d, got in zip(docs, m.score(docs, window=64), strict=True):
        h, want = np.zeros(6), 0.0
        for y in d:
            c = m.class_of[y]
            want += log_softmax(h @ p["wc"] + p["bc"])[c]
            if c < m.n_classes:
                a, b = m.bounds[c], m.bounds[c + 1]
                want += log_softmax(p["wo"][a:b] @ h + p["bo"][a:b])[y - a]
            x, g = p["e"][y] + p["b"], h @ p["u"]
            z, r = sig(x[:6] + g[:6]), sig(x[6:12] + g[6:12])
            h = z * h + (1 - z) * np.tanh(x[12:] + r * g[12:])
        assert abs(got - want) < 1e-3 * max(1, abs(want))


def test_lm_learns_from_all_training_rows(spark, monkeypatch):
    """Words follow one another in a fixed order, which counts can't tell; and the tasks' weights are averaged in several steps."""
    monkeypatch.setattr(lm_score, "FAN", 2)
    rng = random.Random(1)
    texts = [" ".join(f"w{(a + k) % 12}" for k in range(60)) for a in (rng.randrange(12) for _ in range(600))]
    got = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).filter("held_out").collect()
    assert len(got) > 50 and sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)


def test_lm_weights_travel_in_small_rows(spark, monkeypatch):
    """No row or group of the averaging holds all weights of a task, and their mean is that of whole tables, by their tokens."""
    monkeypatch.setattr(lm_score, "FAN", 2)
    monkeypatch.setattr(lm_score, "PIECE", 100)
    tables, kept, written = np.random.default_rng(4).standard_normal((5, 1030)).astype(np.float32), lm_score.stored, []

    def noted(df, name):
        out = kept(df, name)
        written.append(out.selectExpr("max(octet_length(weights))").first()[0])
        return out

    monkeypatch.setattr(lm_score, "stored", noted)
    rows = [r for k, w in enumerate(tables) for b in lm_score.pieces(3 * k, k + 1, w) for r in b.to_pylist()]
    got = lm_score.averaged(noted(spark.createDataFrame([tuple(r.values()) for r in rows], lm_score.WEIGHTS), "lm-weights"))
    assert np.allclose(got, np.average(tables, axis=0, weights=range(1, 6)), atol=1e-6)
    assert max(written) == 400 and len(written) > 2
    assert len(lm_score.averaged(noted(spark.createDataFrame([], lm_score.WEIGHTS), "lm-weights"))) == 0


def test_lm_predicts_every_word(spark):
    """600 words in two languages of 300, all about as frequent: only its other words tell which language a text is in."""
    rng = random.Random(2)
    texts = [" ".join(f"{a}{rng.randrange(300)}" for _ in range(200)) for a in (rng.choice("xy") for _ in range(600))]
    got = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).filter("held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in got) > 0.15 * sum(r["n_tokens"] for r in got)


def test_lm_classes_of_other_words():
    m = lm_score.Gru(np.array([9.0, 5, 3, 2, 1]), np.array([4, 0, 2]), hidden=6, n_classes=3)
    m.fit([np.array([1, 2, 5, 7, 6, 0] * 8)] * 3, streams=2, window=4, updates=1, passes=2)
    state = np.random.default_rng(1).standard_normal((2, 6)).astype(np.float32)
    assert np.allclose(sum(np.exp(m.log_prob(state, np.array([w, w]))) for w in range(8)), 1, atol=1e-5)
    many = np.random.default_rng(2).standard_normal((3000, 6)).astype(np.float32)
    y = np.random.default_rng(3).integers(0, 8, 3000)
    assert np.allclose(m.log_prob(many, y), [m.log_prob(many[i : i + 1], y[i : i + 1])[0] for i in range(3000)], atol=1e-4)


def test_lm_without_training_rows(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = lm_score.lm_scores(spark.createDataFrame([(held[0], "a b"), (held[1], None), (held[2], "a")], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_lm_gradients():
    m = lm_score.Gru(np.array([9.0, 5, 3, 2, 1]), 4, hidden=5, n_classes=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, h = np.array([[1, 2, 0, 5], [3, 4, 5, 1]]), np.random.default_rng(0).standard_normal((2, 5))
    grads, _ = m._window(x, h, end=0)

    def loss():
        s, total = h, 0.0
        for t in range(4):
            total -= m.log_prob(s, x[:, t]).sum()
            s = m.step(x[:, t], s)[0] * (x[:, t] != 0)[:, None]
        return total / x.size

    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6 + 1e-4 * abs(g[at]), k


def test_licenses(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x", "plain text"), (3, "a/y", "plain"), (4, "a/b/z", "Licensed under the Apache License, Version 2.0.\n" + "many other words stand here and " * 5),
        (5, None, "Licensed under CC BY-NC 4.0."), (6, "q", None), (7, "a/b/c/x", ""), (8, "a/LICENSE", "this license is not known to anybody at all, sorry about that"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["licence"], r["how"], r["from_dir"]) for r in licenses.scan(d.withColumn("_dir", F.lit(1))).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a/b"), 3: (None, None, None), 4: ("Apache-2.0", "own", None), 5: ("CC-BY-NC-4.0", "own", None), 6: (None, None, None), 7: ("MIT", "inherited", "a/b"), 8: (None, None, None)}
    assert licenses.scan(d.limit(0)).count() == 0


def test_row_ids_hold_over_shuffles(spark, docs, none):
    from lattica.llm import common

    assert common.repeatable(docs) is docs
    shuffled = docs.repartition(5, "key").unionByName(docs.groupBy(*docs.columns).count().drop("count"))
    assert common.repeatable(shuffled) is not shuffled
    assert linededup.dedup(shuffled).count() == len(ROWS) + len(set(ROWS))
