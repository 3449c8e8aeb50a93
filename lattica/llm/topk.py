"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows is an index: the bits of each dimension, offset to be non-negative, as
bitmaps over the rows. A query adds the slices, weighted by the signed binary digits of its components, in carry-save
form: every column of weight 2^w is reduced by full adders (bitmap arithmetic). That leaves one bitmap for each bit of
all rows' scores. The best rows are picked from the most significant slice downward: rows that have the bit replace those
that don't while there are at least k. Only the high bits of each attribute are indexed; what the low ones can add is
bounded by the query, rows within that bound of the k-th best stay candidates, and their exact integer scores decide, ties by smaller id.

A block's index is built once and written. Queries and blocks meet in a grid of cells, each cell one task's work; no block grows with the data.

Defined cases: a vector that is null or empty, or holds null or non-finite components, takes no part, nor does one with components so large that scores could leave
a long (|256 c| of sqrt(2^62 / length) or more); a query meets rows of its own length only; null ids take no part; rows that repeat a
vec_id are all scored, none of them meets a query of that id, and each of them that is a query has a list of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored, table

K, SCALE, EVERY = 5, 256, 50
#: Rows and queries of one cell.
ROWS, QUERIES = 16384, 512
#: High bits of each attribute that are indexed.
INDEXED = 6


def digits(q: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (exponent, +1 or -1) with as few terms as can be."""
    out, e = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((e, d))
            q -= d
        q >>= 1
        e += 1
    return out


class BitSliced:
    """Rows of one block, n x d integers."""

    def __init__(self, x: np.ndarray, indexed: int = INDEXED) -> None:
        self.x, self.n = x, len(x)
        self.most = int(np.abs(x).max(initial=0))
        self.low = x.min(axis=0)
        span = int((x - self.low).max()) if self.n else 0
        self.drop = max(0, span.bit_length() - indexed)
        coarse = (x - self.low) >> self.drop
        words = -(-self.n // 64)
        self.slices = []
        for d in range(x.shape[1]):
            per = []
            for j in range(int(coarse[:, d].max()).bit_length() if self.n else 0):
                bits = np.zeros(words * 8, dtype=np.uint8)
                packed = np.packbits(((coarse[:, d] >> j) & 1).astype(np.uint8), bitorder="little")
                bits[: len(packed)] = packed
                per.append(bits.view(np.uint64))
            self.slices.append(per)
        self.full = np.zeros(words * 64, dtype=np.uint8)
        self.full[: self.n] = 1
        self.full = np.packbits(self.full, bitorder="little").view(np.uint64)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the coarse scores, least significant first: sum of q_d * coarse_d, with the constant that makes
        it non-negative left in."""
        columns: list[list[np.ndarray]] = []
        for per, qd in zip(self.slices, q.tolist(), strict=True):
            for e, sign in digits(qd):
                for j, s in enumerate(per):
                    while len(columns) <= e + j:
                        columns.append([])
                    columns[e + j].append(s if sign > 0 else ~s)  # -s = ~s - 1, a constant less
        w, out = 0, []
        while w < len(columns):
            col = columns[w]
            if w + 1 == len(columns) and len(col) > 1:
                columns.append([])
            while len(col) > 1:
                a, b = col.pop(), col.pop()
                half = a ^ b
                if col:
                    c = col.pop()
                    columns[w + 1].append((a & b) | (c & half))
                    col.insert(0, half ^ c)
                else:
                    columns[w + 1].append(a & b)
                    col.append(half)
            out.append(col[0] if col else np.zeros_like(self.full))
            w += 1
        return out

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: from the top slice down, rows that surely beat the rest and rows tied so
        far; a row is let go only if k rows lie above it by more than the unindexed bits can make up for."""
        # x = low + (coarse << drop) + rest, 0 <= rest < 1 << drop: the rest adds between neg and pos to a score.
        slack = int(np.abs(q).sum()) * ((1 << self.drop) - 1)
        slices = self.scores(q)
        unit = -(-slack // (1 << self.drop))  # in units of the coarse score
        kth = self._kth(slices, k)
        least = kth - unit
        if least <= 0:
            return np.arange(self.n)
        # Rows with a coarse score of `least` or more, compared bit by bit.
        more, tied = np.zeros_like(self.full), self.full.copy()
        for w in range(len(slices) - 1, -1, -1):
            if (least >> w) & 1:
                tied &= slices[w]
            else:
                more |= tied & slices[w]
                tied &= ~slices[w]
        return np.flatnonzero(np.unpackbits((more | tied).view(np.uint8), bitorder="little")[: self.n])

    def _kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th best coarse score."""
        tied, need, value = self.full.copy(), min(k, self.n), 0
        for w in range(len(slices) - 1, -1, -1):
            with_bit = tied & slices[w]
            n = int(np.bitwise_count(with_bit).sum())
            if n >= need:
                tied, value = with_bit, value | (1 << w)
            else:
                need -= n
                tied &= ~slices[w]
        return value


def best(ids: np.ndarray, q: np.ndarray, qid: int, index: BitSliced, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the k best rows for a query, its own id left out."""
    own = int((ids == qid).sum())
    rows = index.candidates(q, k + own)
    rows = rows[ids[rows] != qid]
    near = index.x[rows]
    if index.most * int(np.abs(q).sum()) < 1 << 53:  # BLAS, and exact
        score = (near.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    else:
        score = near @ q
    if len(rows) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[score >= kth], score[score >= kth]
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][order], score[order]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, _x (array of long): floor(scale * component as double), of complete vectors."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good)
    v = v.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("_x"))
    fits = F.forall("_x", lambda c: F.abs(c) < F.sqrt(F.lit(2.0**62) / F.size("_x")))
    return v.filter(fits).select("vec_id", F.col("_x").cast("array<long>").alias("_x"))


def search(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for each row of `vectors` for which `is_query` holds."""
    v = stored(quantised(vectors, scale).withColumn("_dim", F.size("_x")), "topk-vectors")
    sizes = v.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).first()
    blocks, chunks = max(1, -(-sizes["n"] // ROWS)), max(1, -(-(sizes["q"] or 0) // QUERIES))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")

    def build(r: pd.DataFrame) -> pd.DataFrame:
        index = BitSliced(np.stack(r["_x"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"_dim": [r["_dim"].iloc[0]], "_block": [r["_block"].iloc[0]], "_index": [pickle.dumps((r["vec_id"].to_numpy(), index.__dict__))]})

    numbered = v.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select("vec_id", "_x", "_dim", of(blocks, "_row", 1).alias("_block"))
    index = stored(rows.groupBy("_dim", "_block").applyInPandas(build, "_dim int, _block int, _index binary"), "topk-index")
    asks = stored(numbered.filter(is_query), "topk-queries").select("_row", "vec_id", "_x", "_dim", of(chunks, "_row", 2).alias("_chunk"), grid(blocks).alias("_block"))

    def cell(key: tuple, i: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})]
        if len(i) and len(a):
            ids, state = pickle.loads(i["_index"].iloc[0])
            own = BitSliced.__new__(BitSliced)
            own.__dict__ = state
            for row, q, qid in zip(a["_row"], np.stack(a["_x"].to_numpy()).astype(np.int64), a["vec_id"].tolist(), strict=True):
                got, score = best(ids, q, qid, own, k)
                out.append(pd.DataFrame({"_row": row, "query_id": qid, "vec_id": got, "score": score}))
        return pd.concat(out)

    cells = index.withColumn("_chunk", grid(chunks)).groupBy("_dim", "_block", "_chunk")
    near = cells.cogroup(asks.groupBy("_dim", "_block", "_chunk")).applyInPandas(cell, "_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
