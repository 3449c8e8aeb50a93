"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of whole texts; equal fingerprints are one node. The 64 bits are grouped into parts, correlated bits
together, and each part i gets a threshold t_i >= -1 with sum(t_i) = bits - parts + 1: two fingerprints within `bits`
then agree up to t_i bits on some part with t_i >= 0. Dynamic programming over the parts picks the thresholds with the fewest
estimated candidates, for one to four parts; the estimates come from histograms over all fingerprints. Fingerprints
share a bucket if they agree on a part but for t_i of its bits; Hamming distances are verified.

A bucket of more than `HOT` fingerprints is divided by the pigeonhole principle over the bits that it doesn't fix, until at most `bits` are free; all
hot buckets of a round in one job, whatever part they come from. So no task gets an unbounded bucket, and no link is lost.

Defined cases: a null or empty text has fingerprint zero, linked like any other; rows that repeat a doc_id are judged each by itself; a null
doc_id takes part but names no component unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import hex_digits, others, packed, released, stored, table, unpacked, with_rid, without
from lattica.llm.components import components

BITS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints that a bucket compares pair by pair.
HOT = 48
#: Masks that a hot bucket is divided by at most, all but `bits` of its free bits fixed; with more free bits it is divided by the pigeonhole principle.
MASKS = 200


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_rid, doc_id, _fp (a signed long) of rows with _rid, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), pa.array(fp)], names=["_rid", "doc_id", "_fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("_rid", "doc_id", "text").mapInArrow(run, f"_rid long, doc_id {kind}, _fp long")


def _gram(nodes: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are set. Each task sends 4096 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(4096)
    for r in nodes.select("_fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def grouped_bits(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits dealt into parts of near equal width, correlated bits together."""
    p = np.diag(gram) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(gram / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        seed = min(left, key=lambda b: (sd[b], b))  # the least varied bit first
        part = [seed]
        left.discard(seed)
        while len(part) < width:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        out.append(sorted(part))
    return out


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def fixing(part: list[int], t: int) -> list[int]:
    """Masks of a part's bits but for `t` of them: values within `t` flips agree under one of the masks."""
    return [_mask(sorted(set(part) - set(c))) for c in itertools.combinations(part, t)]


def _equal_pairs(nodes: DataFrame, parts: list[list[int]]) -> list[float]:
    """For each part, the number of ordered pairs of fingerprints that agree on it, themselves included."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("_fp").bitwiseAND(F.lit(_mask(p))).alias("v")) for k, p in enumerate(parts)]))
    counts = nodes.select(values.alias("x")).groupBy("x.part", "x.v").agg(F.count("*").cast("double").alias("c"))
    got = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("n")).collect()}
    return [got.get(k, 0.0) for k in range(len(parts))]


def _cost(width: int, t: int, n: int, same: float, alike: float) -> float:
    """Probes and expected candidates of a part with threshold t. Of the pairs that agree on the part, each bit let go lets in 1 / `alike` times as
    many, where `alike` is the share of pairs that agree on a bit; evenly filled buckets are the least."""
    if t < 0:
        return 0.0
    pairs = max((same - n) / 2 / alike**t, (t > 0) * n * n / 2.0 ** (width - t + 1))
    return math.comb(width, t) * (n + pairs)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in cost.items():
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best[total]


def plan(nodes: DataFrame, n: int, bits: int = BITS) -> list[tuple[list[int], int]]:
    """(bits of the part, threshold) for each part that is probed."""
    gram = _gram(nodes)
    dealt = [grouped_bits(gram, n, parts) for parts in range(1, bits + 3)]
    same = iter(_equal_pairs(nodes, [g for groups in dealt for g in groups]))
    p = np.diag(gram) / max(n, 1)
    alike = float(np.exp(np.log(p**2 + (1 - p) ** 2).mean()))
    choices = []
    for groups in dealt:
        costs = [{t: _cost(len(g), t, n, s, alike) for t in range(-1, bits + 1)} for g, s in [(g, next(same)) for g in groups]]
        choices.append((*allocate(costs, bits - len(groups) + 1), groups))
    _, ts, groups = min(choices, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]


def _divided(mask: int, bits: int) -> list[int]:
    """Masks of more bits than `mask` has, one of which two values within `bits` flips still agree under if they do under `mask`."""
    free = [b for b in range(64) if not mask >> b & 1]
    if math.comb(len(free), bits) <= MASKS:
        return [_mask([b for b in range(64) if mask >> b & 1 or b in free and b not in c]) for c in itertools.combinations(free, bits)]
    return [_mask([b for b in range(64) if mask >> b & 1 or b in free[k :: bits + 1]]) for k in range(bits + 1)]


def links(nodes: DataFrame, bits: int = BITS, n: int | None = None) -> DataFrame:
    """a, b: pairs of the distinct `_fp` of `nodes` within `bits`, enough of them to connect what such pairs connect.

    One job finds the buckets of all masks; each further one those of the masks that divide what was hot."""
    masks = [m for part, t in plan(nodes, nodes.count() if n is None else n, bits) for m in fixing(part, t)]
    rows = nodes.select("_fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("m"))
    found, before = [], None
    while True:
        rows = rows.select("m", F.col("_fp").bitwiseAND(F.col("m")).alias("k"), "_fp")
        sizes = rows.groupBy("m", "k").agg(F.count("*").alias("n"), F.min("_fp").alias("least")).filter("n > 1")
        met = stored(rows.join(sizes, ["m", "k"]), "simhash-buckets")  # buckets of one are gone
        if before is not None:
            released(before)
        before = met
        all_near = F.lit(64) - F.bit_count("m") <= bits
        small = met.filter((F.col("n") <= HOT) & ~all_near).select("m", "k", "_fp")
        pairs = small.withColumnRenamed("_fp", "a").join(small.withColumnRenamed("_fp", "b"), ["m", "k"]).filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        stars = met.filter(all_near).filter("least < _fp").select(F.col("least").alias("a"), F.col("_fp").alias("b"))
        found.append(stored(pairs.select("a", "b").unionByName(stars).distinct(), "simhash-pairs"))
        hot = met.filter((F.col("n") > HOT) & ~all_near)
        again = [(r["m"], d) for r in hot.select("m").distinct().collect() for d in _divided(r["m"], bits)]  # as many as there are masks
        if not again:
            return reduce(DataFrame.unionByName, found).distinct()
        further = nodes.sparkSession.createDataFrame(again, "m long, d long")
        rows = hot.select("m", "_fp").join(F.broadcast(further), "m").select("_fp", F.col("d").alias("m")).distinct()


def clusters(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """_rid, doc_id, _fp, _group (a fingerprint that stands for the component) of rows with _rid, doc_id and text."""
    fps = stored(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = stored(fps.select("_fp").distinct(), "simhash-nodes")
    n = nodes.count()
    if n == 0:
        return fps.withColumn("_group", F.col("_fp"))
    found = components(stored(links(nodes, bits, n), "simhash-links"))
    return fps.join(found.select(F.col("node").alias("_fp"), "component"), "_fp", "left").select("_rid", "doc_id", "_fp", F.coalesce("component", "_fp").alias("_group"))


def report(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    c = stored(clusters(with_rid(docs.select("doc_id", "text")), bits, shingle), "simhash-clusters")
    # Stored, so that the join below deals its rows by itself and a large group can be split.
    least = stored(c.groupBy("_group").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    return c.join(least, "_group").select("doc_id", hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (then the first such row). `neardup` does so by the similarity of the texts."""
    rid = packed(docs)
    c = stored(clusters(rid.select("_rid", "doc_id", "text"), bits, shingle), "simhash-clusters")
    return unpacked(without(rid, others(c)), docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
