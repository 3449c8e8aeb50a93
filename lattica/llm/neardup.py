"""SimHash near-duplicates by similarity: texts whose word shingles have a Jaccard similarity of LEAST or more are linked, and nothing else.

Texts of one shingle set are one node. A node's fingerprint has as many 64-bit words as the plan needs, each by a hash of its own. Two sets of
similarity s differ in a bit with probability acos(2s / (1 + s)) / pi at most, 0.15 at 0.8: the ten bits of 64 that this means are too many for a
guarantee by the pigeonhole principle (every part would be probed for most of its values), so parts and thresholds are chosen for their recall. The bits
of each word are grouped into parts, correlated bits together; each part has a threshold -1 (not probed), 0 or 1, a hit probability and a cost (probes and
estimated candidates); dynamic programming finds the cheapest thresholds by which a pair at LEAST is missed with probability MISS at most, a closer one
less. Nodes that agree on a probed part are candidates; the first CHECKED words of their fingerprints are compared, all words in large buckets, then the words of their texts.

Buckets of up to HOT nodes are compared pair by pair, a larger one first by stars: all its nodes to its middle, the node nearest to what most fingerprints
have in each bit, as copies are nearer to what they were made from than to one another; then in each round up to ROUNDS all its nodes outside its largest component
to CENTRES of that component's, others in each bucket. What comes after, all pairs of small buckets and those
outside a large bucket's largest component with all of it (a very large bucket dealt into several tasks), passes over nodes that are in one component already. So a large group of
near copies takes linear work though most of its pairs may be below LEAST, and no candidate that could join two components is left out; a large bucket of
texts that are alike, but never LEAST, takes the comparison of all its fingerprints' words. Of those that pass it in a large bucket, only such pairs meet with their texts as
can be LEAST alike by what each has in common with the bucket's middle and has beside it: two sets have no more in common than the lesser share of the
middle and the shingles that both have beside it. So copies with edits of their own, each too many for a link, aren't read pair by pair.

Defined cases: words are as in simhash; a text of fewer words than a shingle is one shingle; a null or empty text has no shingle, and such
rows are copies of one another; rows that repeat a doc_id are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import others, packed, stored, unpacked, without
from lattica.llm.components import components
from lattica.llm.simhash import fixing, grouped_bits

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Probability that a pair at LEAST isn't found.
MISS = 0.005
#: Words of the fingerprint that are compared before the texts, and how many standard deviations beyond the mean of a pair at LEAST still pass.
CHECKED, DEVIATIONS = 2, 3.5
#: Evenly spread nodes of a bucket; a probe costs as much as so many comparisons.
OCCUPANCY, PROBE = 32, 50
#: Nodes that a bucket compares pair by pair; rounds of stars in a larger one, and centres of each.
HOT, ROUNDS, CENTRES = 128, 3, 8
#: Nodes of a larger bucket that a task gets, and tasks at most.
DEALT, SALTS = 512, 16
#: Tasks that the text of a centre goes to.
COPIES = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def shingles(text: str | None, shingle: int = SHINGLE) -> set[tuple[bytes, ...]]:
    w = words(text)
    if len(w) < shingle:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(shingle)), strict=False))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    import xxhash

    w = words(text)
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in w], dtype=np.uint64)
    if not w:
        return h
    n = max(1, len(w) - shingle + 1)
    out = np.full(n, len(w) if len(w) < shingle else shingle, dtype=np.uint64)
    for k in range(min(shingle, len(w))):
        out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


def fingerprint(h: np.ndarray, n_words: int) -> np.ndarray:
    """Words of 64 bits: a bit is set if it is set in over half of the shingles' hashes, each word by a hash of its own."""
    counts = np.zeros(n_words * 64, dtype=np.int64)
    own = (np.arange(1, n_words + 1, dtype=np.uint64) * _MIX)[None, :]
    for at in range(0, len(h), 255):  # as many as a byte can count
        bits = np.unpackbits(_mixed(h[at : at + 255, None] ^ own).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)


def differing(least: float) -> float:
    """The share of bits in which the fingerprints of two sets differ, at most, if their Jaccard similarity is `least`."""
    return math.acos(2 * least / (1 + least)) / math.pi


def words_needed(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Words of a fingerprint for n nodes, and the number of parts in each at which evenly filled buckets hold OCCUPANCY nodes."""
    width = min(32.0, max(6.4, math.log2(max(n, 2) / OCCUPANCY)))
    per = max(2, round(64 / width))
    hit = (1 - differing(least)) ** (64 / per)
    return max(CHECKED + 1, math.ceil(1.15 * math.log(miss) / math.log(1 - hit) / per)), per


def signed(docs: DataFrame, n_words: int) -> DataFrame:
    """_rid, _set (16 bytes that stand for the shingle set), _w (the fingerprint) of rows with _rid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets, prints = [], []
            for t in b.column("text"):
                h = hashes(t.as_py())
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                prints.append(fingerprint(h, n_words))
            own = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n_words), pa.array(np.concatenate([*prints, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("_rid"), pa.array(sets, pa.binary()), own], names=["_rid", "_set", "_w"])

    return docs.select("_rid", "text").mapInArrow(run, "_rid long, _set binary, _w array<long>")


def _grams(nodes: DataFrame, n_words: int) -> np.ndarray:
    """For each word, 64 x 64: in how many fingerprints both bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_words, 64, 64))
        for b in batches:
            w = b.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, n_words)
            for k in range(n_words):
                bits = np.unpackbits(np.ascontiguousarray(w[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += bits.T @ bits
        upper = total[:, *np.triu_indices(64)].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper))), pa.array(upper)], names=["cell", "n"])

    got = nodes.select("_w").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2080 rows a word
    flat = np.zeros(n_words * 2080)
    flat[got["cell"].to_numpy()] = got["n"].to_numpy()
    out = np.zeros((n_words, 64, 64))
    for k in range(n_words):
        out[k][np.triu_indices(64)] = flat[k * 2080 : (k + 1) * 2080]
        out[k] = np.maximum(out[k], out[k].T)
    return out


def allocated(costs: list[dict[int, tuple[float, float]]], need: float, steps: int = 256) -> tuple[float, list[int]]:
    """The cheapest thresholds whose gains add up to `need`, by dynamic programming over the parts. costs: for each part, threshold to
    (cost, gain). Gains are rounded down to `steps` parts of the need, so the need is met."""
    unit = need / steps
    best: list[tuple[float, tuple]] = [(0.0, ())] + [(math.inf, ())] * steps
    for options in costs:
        new = [(math.inf, ())] * (steps + 1)
        for t, (cost, gain) in options.items():
            g = int(gain / unit)
            for s, (c, chain) in enumerate(best):
                to = min(steps, s + g)
                if c + cost < new[to][0]:
                    new[to] = (c + cost, (t, chain))
        best = new
    total, chain = best[steps]
    out: list[int] = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return total, out[::-1]


def plan(grams: np.ndarray, n: int, per: int, least: float = LEAST, miss: float = MISS) -> list[tuple[int, int]]:
    """(word, mask) of each probe: a part's bits, or those but one at threshold 1."""
    apart, need = differing(least), -math.log(miss)
    p = np.einsum("kii->ki", grams) / max(n, 1)
    agree = np.log2(p**2 + (1 - p) ** 2)
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for parts in range(max(1, per - 1), per + 2):
        of = [(k, g) for k in range(len(grams)) for g in grouped_bits(grams[k], n, parts)]
        costs = []
        for k, g in of:
            options = {-1: (0.0, 0.0)}
            for t in (0, 1):
                hit = sum(math.comb(len(g), j) * apart**j * (1 - apart) ** (len(g) - j) for j in range(t + 1))
                pairs = n * (n - 1) / 2 * 2.0 ** float(agree[k, g].sum() * (len(g) - t) / len(g))
                options[t] = (math.comb(len(g), t) * (PROBE * n + pairs), -math.log(1 - hit))
            costs.append(options)
        total, ts = allocated(costs, need)
        if total < best[0]:
            best = (total, [(k, m) for (k, g), t in zip(of, ts, strict=True) if t >= 0 for m in fixing(g, t)])
    if not best[1]:
        raise ValueError(f"{len(grams)} words don't do for a miss of {miss}")
    return best[1]


@F.arrow_udf(T.BooleanType())
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    out, last, own = [], None, set()
    for x, y in zip(a, b, strict=True):
        x = x.as_py()
        if x != last or last is None:
            last, own = x, shingles(x)
        out.append(jaccard(own, shingles(y.as_py())) >= LEAST)
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.StructType().add("_i", T.IntegerType()).add("_z", T.IntegerType()).add("_d", T.ArrayType(T.LongType())))
def _beside(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of each b: how many of its shingles a has; how many it has itself; the hashes of those that a lacks."""
    out, last, own = [], None, np.zeros(0, np.uint64)
    for x, y in zip(a, b, strict=True):
        x = x.as_py()
        if x != last or last is None:
            last, own = x, hashes(x)
        h = hashes(y.as_py())
        d = np.setdiff1d(h, own, assume_unique=True)
        out.append((len(h) - len(d), len(h), d.view(np.int64)))
    ends = np.concatenate([[0], np.cumsum([len(d) for *_, d in out], dtype=np.int64)]).astype(np.int32)
    d = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*(d for *_, d in out), np.zeros(0, np.int64)])))
    return pa.StructArray.from_arrays([pa.array([i for i, *_ in out], pa.int32()), pa.array([z for _, z, _ in out], pa.int32()), d], names=["_i", "_z", "_d"])


#: Whether two nodes of a bucket can be LEAST alike, by _beside of its middle.
_POSSIBLE = f"(least(_ia, _ib) + size(array_intersect(_da, _db))) * {1 + LEAST} >= {LEAST} * (_za + _zb) - 0.000001"


def _verified(pairs: DataFrame, docs: DataFrame, copies: int = 1) -> DataFrame:
    """Those of `pairs` (a, b: _rid of `docs`) that are at least LEAST alike. With `copies`, an `a` of many pairs meets them in so many tasks."""
    return stored(_with_texts(pairs, docs, copies).filter(_alike("_a", "_b")).select("a", "b"), "near-links")


def _with_texts(pairs: DataFrame, docs: DataFrame, copies: int) -> DataFrame:
    """`pairs` with their texts _a and _b."""
    pairs = stored(pairs.distinct().withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(copies)).cast("int")), "near-pairs")
    met = stored(pairs.select(F.explode(F.array("a", "b")).alias("_rid")).distinct(), "near-met")
    texts = stored(docs.select("_rid", "text").join(met, "_rid", "left_semi"), "near-texts")
    left = texts.join(pairs.select(F.col("a").alias("_rid")).distinct(), "_rid", "left_semi") if copies > 1 else texts
    left = left.select(F.col("_rid").alias("a"), F.col("text").alias("_a"), F.explode(F.array(*[F.lit(k) for k in range(copies)])).alias("_salt"))
    return pairs.join(texts.select(F.col("_rid").alias("b"), F.col("text").alias("_b")), "b").join(left, ["a", "_salt"])


def clusters(docs: DataFrame) -> DataFrame:
    """_rid, _group (the _rid of a row that stands for the component) of rows with _rid and text."""
    n_words, per = words_needed(docs.count())
    rows = stored(signed(docs, n_words), "near-rows")
    nodes = stored(rows.groupBy("_set").agg(F.min_by(F.struct("_rid", "_w"), "_rid").alias("_x")).select("_set", F.col("_x._rid").alias("_n"), "_x._w"), "near-nodes")
    probes = plan(_grams(nodes, n_words), nodes.count(), per)
    checked, every = ([f"_w{k}" for k in range(n)] for n in (CHECKED, n_words))
    keys = F.array(*[F.xxhash64(F.lit(k), F.get("_w", F.lit(w)).bitwiseAND(F.lit(m))) for k, (w, m) in enumerate(probes)])
    share = differing(LEAST)

    def near(x: DataFrame, y: DataFrame, on: list[str], also: str, checked: list[str] = every) -> DataFrame:
        """a, b: nodes (_n, checked words, component _of or null) of one bucket whose checked words are near, but for those in one component."""
        bits = 64 * len(checked)
        most = int(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))
        left, right = (t.select(*on, *[F.col(c).alias(f"{c}{end}") for c in (*checked, "_of")], F.col("_n").alias(end), *[F.col(c).alias(f"{c}{end}") for c in ("_i", "_z", "_d") if c in t.columns], *[c for c in t.columns if c == "_most" and end == "b"]) for t, end in ((x, "a"), (y, "b")))
        apart = sum(F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in checked)
        return left.join(right, on).filter((apart <= most) & F.expr("_ofa is null or _ofb is null or _ofa <> _ofb") & F.expr(also)).select("a", "b")

    def placed(nodes: DataFrame, of: DataFrame | None, checked: list[str]) -> DataFrame:
        """The nodes by bucket, with their components; null where a node is one by itself, as nulls shuffle small."""
        own = nodes.withColumn("component", F.lit(None).cast("long")) if of is None else nodes.join(of.select(F.col("node").alias("_n"), "component"), "_n", "left")
        return own.select("_n", F.col("component").alias("_of"), *[F.get("_w", F.lit(k)).alias(c) for k, c in enumerate(checked)], F.explode(keys).alias("_k"))

    def with_most(hot: DataFrame) -> DataFrame:
        """`hot` with _most, the largest component of each bucket."""
        hot = hot.withColumn("_of", F.coalesce("_of", "_n"))
        sizes = hot.groupBy("_k", "_of").agg(F.count("*").alias("_c"))
        return hot.join(sizes.groupBy("_k").agg(F.max_by("_of", F.struct("_c", "_of")).alias("_most"), F.sum("_c").alias("_size")), "_k")

    def middles(hot: DataFrame) -> DataFrame:
        """A node of each bucket: the nearest in the first CHECKED words to the bits that most nodes have."""
        sums = [F.sum(F.shiftrightunsigned(c, b).bitwiseAND(F.lit(1))).alias(f"{c}_{b}") for c in checked for b in range(64)]
        set_ = lambda c: reduce(F.Column.bitwiseOR, [F.when(F.col(f"{c}_{b}") * 2 > F.col("_c"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)])
        usual = stored(hot.groupBy("_k").agg(F.count("*").alias("_c"), *sums).select("_k", *[set_(c).alias(f"{c}m") for c in checked]), "near-usual")
        apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}m"))) for c in checked)
        return hot.join(usual, "_k").groupBy("_k").agg(F.min_by(F.struct("_n", "_of", *every), F.struct(apart, "_n")).alias("_x")).select("_k", "_x.*")

    keyed, of, found = placed(nodes, None, checked), None, []
    big = stored(keyed.groupBy("_k").agg(F.count("*").alias("_c")).filter(F.col("_c") > HOT).select("_k"), "near-big")
    any_big = bool(big.take(1))
    if any_big:  # the rounds read only nodes that large buckets have
        crowded = stored(nodes.join(keyed.join(big, "_k", "left_semi").select("_n").distinct(), "_n", "left_semi"), "near-crowded")
    for turn in range(ROUNDS * any_big):
        hot = stored(placed(crowded, of, every).join(big, "_k", "left_semi"), "near-hot")
        if turn:
            hot = stored(with_most(hot), "near-placed")
        picks = [F.min_by(F.struct("_n", "_of", *every), F.xxhash64("_n", "_k", F.lit(turn * CENTRES + c))) for c in range(CENTRES)]
        own = hot.filter(F.col("_of") == F.col("_most")) if turn else hot  # all nodes are components of their own at first
        if not turn:
            centre = stored(middles(hot), "near-middles")
        centres = centre if not turn else own.groupBy("_k").agg(F.array_distinct(F.array(*picks)).alias("_x")).select("_k", F.explode("_x").alias("_x")).select("_k", "_x.*")
        outside = hot.filter("_of <> _most").drop("_most", "_size") if turn else hot
        new = _verified(near(centres, outside, ["_k"], "a <> b"), docs, COPIES)
        if not new.take(1):
            break
        found.append(new)
        of = stored(components(reduce(DataFrame.unionByName, found)), "near-components")
    keyed = placed(nodes, of, checked)
    small = keyed.join(big, "_k", "left_anti") if any_big else keyed
    pairs = near(small, small, ["_k"], "a < b", checked)
    if any_big:
        hot = stored(placed(crowded, of, every).join(big, "_k", "left_semi"), "near-hot")
        salts = F.least(F.lit(SALTS), F.ceil(F.col("_size") / DEALT)).cast("int")
        hot = stored(with_most(hot).join(centre.select("_k", F.col("_n").alias("_m")), "_k"), "near-placed")
        hot = hot.join(hot.filter("_of <> _most").select("_k").distinct(), "_k", "left_semi")  # the others' nodes are all linked
        met = _with_texts(hot.select(F.col("_m").alias("a"), F.col("_n").alias("b")), docs, COPIES)
        met = stored(met.select(F.col("a").alias("_m"), F.col("b").alias("_n"), _beside("_a", "_b").alias("_x")).select("_m", "_n", "_x.*"), "near-beside")
        hot = stored(hot.join(met, ["_m", "_n"]).drop("_m").withColumn("_salt", F.pmod(F.xxhash64("_n"), salts).cast("int")), "near-placed")
        outside = hot.filter("_of <> _most").drop("_salt", "_most").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        pairs = pairs.unionByName(near(outside, hot, ["_k", "_salt"], f"(_ofb = _most or a < b) and {_POSSIBLE}"))
    found.append(_verified(pairs, docs))
    of = stored(components(reduce(DataFrame.unionByName, found)), "near-components")
    group = nodes.select("_set", "_n").join(of.select(F.col("node").alias("_n"), "component"), "_n", "left").select("_set", F.coalesce("component", "_n").alias("_group"))
    return rows.select("_rid", "_set").join(group, "_set").select("_rid", "_group")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (then the first such row)."""
    rid = packed(docs)
    c = stored(clusters(rid.select("_rid", "text")), "near-clusters")
    return unpacked(without(rid, others(rid.select("_rid", "doc_id").join(c, "_rid"))), docs.columns)
