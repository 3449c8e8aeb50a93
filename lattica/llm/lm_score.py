"""Language-model scores of whole texts: an add-one unigram base, and a gated recurrent model (see gru).

Counts are taken over all rows, training rows apart: each task sums its words, a shuffle sums the tasks. The HEAD words that are most frequent in all rows
travel to the executors; rarer words of a document meet their counts in a shuffle join, so the vocabulary may be of any size. No word of
that join is frequent: beyond the head none has more than 1/HEAD of the tokens.

The recurrent model lists every word of the head that training rows have, each with an input and an output of its own; its classes and output biases come from
these counts. Its weights are fitted on all training rows, once: in each of ROUNDS rounds every task goes over its part of the round's rows from the common
weights, by truncated backpropagation, and the tasks' weights are averaged by their tokens, FAN tasks at a time and PIECE weights to a row, so that no process
but the trainers and the driver ever holds all weights. Words beyond the head fall into
OTHERS classes by their hash, which the model reads and predicts too; within a class a word has (c + 1) / (tokens + words + 1) by the counts, so the
probabilities of all texts, unknown words of a class counted as one, sum to one.

Defined cases: a null or empty text is the end token alone; a null doc_id isn't held out; rows that repeat a doc_id are scored each by itself; without
training rows every token is off the list and unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import released, stored, table, with_rid
from lattica.llm.gru import Gru, Trainer

FOLDS, HELD = 7, 2
#: Words that travel to the executors, all of which the recurrent model lists; classes of the other words; its state.
HEAD, OTHERS, HIDDEN = 50_000, 16, 16
#: Rounds of training; tasks whose weights are averaged together; weights in a row; tokens that a task trains on at once.
ROUNDS, FAN, PIECE, FED = 3, 64, 8192, 1_000_000
#: Distinct words that a task sums before it hands them on; documents scored together.
SUMMED, TOGETHER = 400_000, 2000
END = b""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def other(word: bytes) -> int:
    """The class of a word that isn't listed; in SQL crc32(word) % OTHERS."""
    return zlib.crc32(word) % OTHERS


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """_word, _c (in rows that aren't `held_out`), _a (in all) over the texts of `docs`, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            seen = learnt | held  # whichever has it
            c = [learnt[w] for w in seen]
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(c, pa.int64()), pa.array([n + held[w] for n, w in zip(c, seen, strict=True)], pa.int64())], names=["_word", "_c", "_a"])
            learnt.clear()
            held.clear()
            return b

        for b in batches:
            for t, h in zip(b.column("text"), b.column("held_out").to_pylist(), strict=True):
                to = held if h else learnt
                to.update(words(t.as_py()))
                to[END] += 1
                if len(learnt) + len(held) > SUMMED:
                    yield out()
        yield out()

    return docs.select("text", "held_out").mapInArrow(run, "_word binary, _c long, _a long").groupBy("_word").agg(F.sum("_c").alias("_c"), F.sum("_a").alias("_a"))


#: The weights of a task: tokens that it was trained on, and a row for each PIECE of the weights.
WEIGHTS = "part long, tokens double, piece int, weights binary"


def pieces(part: int, tokens: float, flat: np.ndarray, together: int = 32) -> Iterator[pa.RecordBatch]:
    """The rows of `flat`, `together` of them in a batch."""
    cuts = [flat[at : at + PIECE].astype(np.float32).tobytes() for at in range(0, len(flat), PIECE)]
    for at in range(0, len(cuts), together):
        n = len(cuts[at : at + together])
        columns = [pa.array([part] * n, pa.int64()), pa.array([float(tokens)] * n), pa.array(range(at, at + n), pa.int32()), pa.array(cuts[at : at + n], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "tokens", "piece", "weights"])


def averaged(sums: DataFrame) -> np.ndarray:
    """The mean of the weights of the tasks in `sums` (a stored table), each counted by its tokens; empty if there are none. Releases `sums`."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n, total = rows["tokens"].sum(), 0.0
        for w, x in zip(rows["weights"], rows["tokens"], strict=True):
            total += np.frombuffer(w, np.float32) * (x / n)
        return rows.iloc[:1].assign(tokens=n, weights=[total.astype(np.float32).tobytes()])

    while sums.filter("piece = 0").count() > 1:
        last, sums = sums, stored(sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "piece").applyInPandas(mean, WEIGHTS), "lm-weights")
        released(last)
    got = sums.select("piece", "weights").toArrow().sort_by("piece")
    released(sums)
    return np.frombuffer(b"".join(got["weights"].to_pylist()), np.float32)


def trained(learn: DataFrame, model: Gru, ids: dict[bytes, int], tokens: int, rounds: int = ROUNDS) -> Gru:
    """`model` fitted on the texts of `learn` (_rid, text), each once; ids: of the listed words, the end's being 0. Other words have the ids that follow, by their class.
    As each task writes all weights, partitions of few of the `tokens` are taken together."""
    tasks = max(learn.sparkSession.sparkContext.defaultParallelism, -(-tokens // (2 * FED)))
    spark, names, shapes = learn.sparkSession, list(model.p), {k: w.shape for k, w in model.p.items()}

    def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(shapes[k])) for k in names])
        return {k: part.reshape(shapes[k]) for k, part in zip(names, np.split(flat, ends[:-1]), strict=True)}

    for r in range(rounds):
        shared = spark.sparkContext.broadcast((ids, model.__dict__))

        def run(batches: Iterator[pa.RecordBatch], r: int = r, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            get, state = shared.value[0].get, shared.value[1]
            own = Gru.__new__(Gru)
            own.__dict__ = state | {"p": {k: w.copy() for k, w in state["p"].items()}}
            trainer, docs, waiting, tokens = Trainer(own, end=0), [], 0, 0
            for b in batches:
                for t in b.column("text"):
                    docs.append(np.array([own.k + other(w) if (i := get(w)) is None else i for w in words(t.as_py())] + [0], dtype=np.int64))
                    waiting += len(docs[-1])
                    if waiting >= FED:
                        trainer.feed(docs, r / rounds)
                        tokens, waiting, docs = tokens + waiting, 0, []
            trainer.feed(docs, r / rounds)
            tokens += waiting
            if tokens:
                yield from pieces(TaskContext.get().partitionId(), tokens, np.concatenate([own.p[k].ravel() for k in names]))

        turn = learn.filter(F.pmod(F.xxhash64("_rid"), F.lit(rounds)) == r)
        flat = averaged(stored(turn.select("text").coalesce(tasks).mapInArrow(run, WEIGHTS), "lm-weights"))
        shared.destroy()
        if len(flat):
            model.p = unpacked(flat)
    return model


def lm_scores(docs: DataFrame, head: int = HEAD, listed: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`. listed: words of the head that the recurrent model lists, if not all."""
    rid = with_rid(docs.select("doc_id", "text")).withColumn("held_out", held_out())
    counts = stored(word_counts(rid), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count_if(F.col("_c") > 0)).first()
    # The end comes first, so it is always listed; then the words by their counts.
    is_end = F.octet_length("_word") == 0
    rows = [(r["_word"], r["_c"]) for r in counts.filter(is_end).collect()]  # one row or none
    top = counts.filter(~is_end).orderBy(F.desc("_a"), "_word").limit(head).toArrow()
    rows += sorted(zip(top["_word"].to_pylist(), top["_c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    known = {bytes(w): i for i, (w, _) in enumerate(rows)}
    c = np.array([x for _, x in rows], dtype=np.int64)
    k = min(len(rows) if listed is None else max(1, listed), int((c > 0).sum())) if n else 0
    tokens, kinds = np.zeros((2, OTHERS))
    for r in counts.filter("_c > 0").groupBy(F.pmod(F.crc32("_word"), F.lit(OTHERS)).cast("int").alias("j")).agg(F.sum("_c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["j"]], kinds[r["j"]] = r["c"], r["v"]
    for (w, x), _ in zip(rows, range(k), strict=False):
        tokens[other(w)] -= x
        kinds[other(w)] -= 1
    model = Gru(c[:k].astype(float), tokens, HIDDEN, max(1, round(k**0.5)))
    if k:
        trained(rid.filter(~F.col("held_out")), model, {w: i for w, i in known.items() if i < k}, n)

    # What holds for every token: base = log10((c + 1) / (N + V + 1)); in a class of others, (c + 1) / (its N + its V + 1).
    base_less = float(np.log10(n + v + 1))
    less = np.log10(tokens + kinds + 1)
    shared = docs.sparkSession.sparkContext.broadcast((known, np.log10(c + 1.0), c > 0, model.__dict__))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, logs, learnt, state = shared.value
        gru = Gru.__new__(Gru)
        gru.__dict__ = state
        get = ids_of.get
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                seqs, n_tokens, n_known, base, score, off = [], [], [], [], [], []
                for t in part.column("text"):
                    ws = words(t.as_py())
                    ws.append(END)
                    ids = np.array([get(w, -1) for w in ws], dtype=np.int64)
                    there = ids >= 0
                    n_tokens.append(len(ws))
                    n_known.append(int(learnt[ids[there]].sum()))
                    base.append(float(logs[ids[there]].sum()))
                    off.append([ws[i] for i in np.flatnonzero(~there)])
                    rest = np.flatnonzero(~there | (ids >= k))
                    cls = np.array([other(ws[i]) for i in rest], dtype=np.int64)
                    score.append(float(logs[ids[ids >= k]].sum()) - float(less[cls].sum()))
                    ids[rest] = k + cls
                    seqs.append(ids)
                if k:
                    score = np.array(score) + gru.score(seqs) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in ("_rid", "doc_id", "held_out")), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(off, pa.list_(pa.binary()))],
                    names=["_rid", "doc_id", "held_out", "n_tokens", "_known", "_base", "_score", "_off"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    scored = stored(rid.select("_rid", "doc_id", "held_out", "text").mapInArrow(run, f"_rid long, doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _score double, _off array<binary>"), "lm-rows")
    shared.destroy()
    rare = scored.select("_rid", F.explode("_off").alias("_word")).join(counts.filter("_c > 0").select("_word", "_c"), "_word")
    rare = rare.groupBy("_rid").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("_c") + 1)).alias("_add"))
    out = scored.drop("_off").join(rare, "_rid", "left")
    add = F.coalesce("_add", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("_base") + add - F.col("n_tokens") * base_less).alias("base_score"), (F.col("_score") + add).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
