"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of hashed byte 2-grams and 4-grams of the whole text, case and punctuation included. The
indicators are scaled by the log-count ratio of the two classes, and a linear hinge-loss model is fitted on them by dual
coordinate descent; Platt's logistic turns margins into scores.

The model is fitted on at most `sample` labelled rows: those of the `sample` labels whose ids have the smallest hashes, and of these rows the first by
doc_id, label and features, so the choice depends neither on tasks nor on order. Each is one bitmap of FEATURES / 8 bytes; one task gets them, 32 MB
in all, and the driver gets the model. Every document is scored, over its whole text, in one scan without shuffle.

Defined cases: null and empty texts have no features and get the score of the bias; a null label is no label; an id labelled
more than once counts once for each label; without labels of both classes every score is 0.5; a null doc_id is never held out; an empty table
gives an empty result; other columns are ignored (`filtered` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import packed, table, unpacked

FEATURES = 1 << 16
SAMPLE = 4096
THRESHOLD = 0.7
FOLD = 2
#: Prior count, cost of a violated margin, passes.
PRIOR, COST, PASSES = 1.0, 1.0, 12


def features(text: str | None) -> np.ndarray:
    """The feature numbers of a text, each once."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(FEATURES, dtype=bool)
    if len(b) >= 2:
        two = (b[:-1] << 8) | b[1:]
        seen[(two * np.uint32(0x9E3779B1)) >> 18] = True  # the lower quarter of the table
        if len(b) >= 4:
            four = (two[:-2] << 16) | two[2:]
            seen[FEATURES // 4 + ((four * np.uint32(0x85EBCA6B)) >> 16) % (FEATURES * 3 // 4)] = True
    return np.flatnonzero(seen)


class Model:
    """weights by feature (with the ratios multiplied in), bias, and Platt's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margin(self, f: np.ndarray) -> float:
        return self.bias + (float(self.weights[f].sum()) / np.sqrt(len(f)) if len(f) else 0.0)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """rows: feature numbers; labels: 1 and 0."""
    y = np.where(labels == 1, 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(FEATURES), 0.0, 0.0, 0.0)
    counts = {s: np.full(FEATURES, PRIOR) for s in (1.0, -1.0)}
    for f, s in zip(rows, y, strict=True):
        counts[s][f] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    scaled = lambda f: ratio[f] / np.sqrt(max(len(f), 1))
    norms = np.array([float((scaled(f) ** 2).sum()) + 1.0 for f in rows])
    # Dual coordinate descent for the hinge loss; violations of the rarer class cost as much in all.
    cost = COST * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(y)):
            f, v = rows[i], scaled(rows[i])
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    m = np.array([float(w[f] @ scaled(f)) + bias for f in rows])
    return Model(w * ratio, bias, *_platt(m, y))


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic, with Platt's smoothed targets, by Newton's method."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, p = np.stack([m, np.ones_like(m)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (q - t)
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p = p - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == FOLD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality from rows that aren't held out."""
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("_label")).filter(~held_out()).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for t in b.column("text"):
                seen = np.zeros(FEATURES, dtype=np.uint8)
                seen[features(t.as_py())] = 1
                maps.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array(maps, pa.binary())], names=["doc_id", "label", "bitmap"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("_label").cast("int").alias("_label"), "text")  # at most `sample` rows are broadcast
    kind = dict(docs.dtypes)["doc_id"]
    got = rows.mapInArrow(bitmap, f"doc_id {kind}, label int, bitmap binary").orderBy("doc_id", "label", "bitmap").limit(sample)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, marks = [], []
        for b in batches:
            sets += [np.flatnonzero(np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8))).astype(np.int32) for x in b.column("bitmap")]
            marks += b.column("label").to_pylist()
        m = fit(sets, np.array(marks))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.offset))], names=["weights", "bias", "slope", "offset"])

    m = got.repartition(1).sortWithinPartitions("doc_id", "label", "bitmap").mapInArrow(fitted, "weights binary, bias double, slope double, offset double").first()  # `sample` rows at most
    if m is None:  # no rows, no task
        return fit([], np.array([]))
    return Model(np.frombuffer(m["weights"]), m["bias"], m["slope"], m["offset"])


def scored(docs: DataFrame, model: Model) -> Column:
    """The score of `text` as a column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(F.col("text"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    model = train(docs, labels, sample)
    out = docs.select("doc_id", held_out().alias("held_out"), scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filtered(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that the classifier rejects."""
    model = train(docs, labels, sample)
    kept = packed(docs).withColumn("_score", scored(docs, model)).filter(F.col("_score") >= threshold)
    return unpacked(kept, docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
