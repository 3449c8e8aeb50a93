"""Benchmark decontamination: windows of benchmark words, found in whole documents.

A window is `n` consecutive words of an item; an item of fewer words, but not none, is one window. Each document's
word positions get one 64-bit key for each window length that occurs; a broadcast hash join finds the keys that some
item has, and every match is verified word by word. Only DataFrame functions run here.

A window that several items share is one row; which items hold it stands in a table of its own, joined after the matches of a document are brought
together. The windows are broadcast in blocks of at most `block` rows or so, so what is broadcast doesn't grow with the benchmark;
a larger benchmark means more blocks, each probed by its own scan.

Defined cases: a null or wordless text has no words and no hits; an item without words has no window; rows that repeat
a doc_id are judged each by itself; items of one item_id count as one; an item without id marks words but isn't listed;
an empty table gives an empty result; columns other than those named here are ignored (`clean` keeps them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import BETWEEN, UPPER, packed, stored, table, unpacked, with_rid, word_array

WINDOW = 10
#: Rows of windows in one broadcast, at some 200 bytes each.
BLOCK = 500_000


def _key(words: Column, start: Column | int, n: int) -> Column:
    """The key of the n-gram at `start`: its length and up to four of its words, first and last among them. The rest
    is left to the verification; hashing all ten words takes three times the time."""
    return F.xxhash64(F.lit(n), *[words[start + k] for k in sorted({0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1})])


def _keys(words: Column, n: int) -> Column:
    """A key for each run of `n` words, or none."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _key(words, i, n))


def _by_len(values: dict[int, Column]) -> Column:
    """The value for `_len`; one flat CASE, as nested ones take time exponential in their depth to analyse."""
    return reduce(lambda case, kv: case.when(F.col("_len") == kv[0], kv[1]), values.items(), F.when(F.lit(False), F.lit(None)))


def windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """_key, _len, _words, _win: each window once; and _win, _item: the items that hold it."""
    items = benchmark.select(F.col("item_id").alias("_item"), word_array(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    items = items.withColumn("_len", F.least(F.lit(n), F.size("_w")))
    runs = items.select("_item", "_len", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_len") + 1), lambda i: F.slice(F.col("_w"), i, F.col("_len")))).alias("_words"))
    runs = stored(runs.distinct(), "benchmark-runs")
    key = _by_len({k: _key(F.col("_words"), 0, k) for k in range(1, n + 1)})
    wins = stored(runs.select("_len", "_words").distinct().select(key.alias("_key"), "_len", "_words", F.monotonically_increasing_id().alias("_win")), "benchmark-windows")
    return wins, runs.join(wins.drop("_key"), ["_len", "_words"]).select("_win", "_item")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs` (with `_rid`, doc_id and text): _rid, doc_id, n_words, _runs (starts and lengths
    of hit windows, in words from 0), _items (the item_ids)."""
    wins, holders = windows(benchmark, n)
    rows = stored(matches(docs, wins, n, block), "benchmark-hits")
    met = rows.select("_rid", F.explode("_wins").alias("_win")).join(stored(holders, "benchmark-items"), "_win")
    items = met.groupBy("_rid").agg(F.collect_set("_item").alias("_items"))  # of one document: what is to be returned
    none = F.array().cast(f"array<{dict(holders.dtypes)['_item']}>")
    return rows.drop("_wins").join(items, "_rid", "left").withColumn("_items", F.coalesce("_items", none))


def matches(docs: DataFrame, wins: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """_rid, doc_id, n_words, _runs, _wins (the windows found) for each row of `docs`."""
    sizes = {r["_len"]: r["n"] for r in wins.groupBy("_len").agg(F.count("*").alias("n")).collect()}  # n rows at most
    lens = sorted(sizes)
    blocks = max(1, -(-sum(sizes.values()) // block))

    base = docs.select("_rid", "doc_id", word_array(F.col("text")).alias("_w"))
    n_words = F.size("_w")
    count_of = {k: F.greatest(n_words - (k - 1), F.lit(0)) for k in lens}
    before = {k: reduce(lambda a, b: a + b, [count_of[j] for j in lens if j < k], F.lit(0)) for k in lens}
    total = reduce(lambda a, b: a + b, count_of.values(), F.lit(0))
    start = F.col("_pos") - F.coalesce(_by_len(before), F.lit(0))

    found = []
    for b in range(blocks):
        part = wins if blocks == 1 else wins.filter(F.pmod(F.xxhash64("_win"), F.lit(blocks)) == b)
        keys = F.concat(*[_keys(F.col("_w"), k) for k in lens], F.array(F.lit(0).cast("long")))
        # The last key of a document, 0, stands for the document itself and meets the row of length 0.
        own = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("_key"), F.lit(0).alias("_len"), F.array().cast("array<string>").alias("_words"), F.lit(None).cast("long").alias("_win"))
        # Apart from the generator, so that the explosion and the probe compile into one loop; outer, as the optimiser
        # would else infer a filter, push it below and split the text anew for each word. There is always a key.
        probe = base.withColumn("_keys", keys).select("_rid", "doc_id", "_w", F.posexplode_outer("_keys").alias("_pos", "_key"))
        met = probe.join(F.broadcast(part.unionByName(own)), "_key")
        real = F.when(F.col("_len") == 0, F.col("_pos") == total).otherwise((start >= 0) & (start < n_words) & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.col("_len")) == F.col("_words")))
        found.append(met.filter(real).select("_rid", "doc_id", n_words.cast("long").alias("_n"), F.when(F.col("_len") > 0, F.struct(start.alias("start"), F.col("_len").alias("len"))).alias("_run"), "_win"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("_rid").agg(F.first("doc_id").alias("doc_id"), F.max("_n").alias("n_words"), F.array_sort(F.collect_set("_run")).alias("_runs"), F.collect_set("_win").alias("_wins"))


def _covered(runs: Column) -> Column:
    """Words that lie in any of the sorted runs."""
    end = lambda x: x["start"] + x["len"]
    step = lambda acc, x: F.struct(F.greatest(acc["end"], end(x)).alias("end"), (acc["n"] + F.greatest(F.lit(0), end(x) - F.greatest(acc["end"], x["start"]))).alias("n"))
    return F.aggregate(runs, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`."""
    h = hits(with_rid(docs.select("doc_id", "text")), benchmark, n).withColumn("n_hit", _covered(F.col("_runs")).cast("long"))
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return h.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "mixed") -> DataFrame:
    """`docs` without what the benchmark holds, other columns kept.

    mode "documents" drops every document with a hit; "spans" cuts the hit words, with the separators before them, out
    of the text; "mixed" drops documents that hold a whole window of `n` words and cuts the spans that only items of
    fewer words have.
    """
    if mode not in ("documents", "spans", "mixed"):
        raise ValueError(f"no such mode: {mode}")
    rid = packed(docs)
    h = matches(rid.select("_rid", "doc_id", "text"), windows(benchmark, n)[0], n).filter(F.size("_runs") > 0).select("_rid", "_runs")
    # Written first, so that few rows are broadcast and the texts stay where they are.
    out = rid.select("_rid", "_row").join(stored(h, "benchmark-runs-of"), "_rid", "left").withColumn("text", F.col("_row.text"))
    if mode == "documents":
        return unpacked(out.filter(F.col("_runs").isNull()), docs.columns)
    if mode == "mixed":
        out = out.filter(F.coalesce(~F.exists("_runs", lambda r: r["len"] >= n), F.lit(True)))
    word = BETWEEN.replace("[", "[^", 1)
    gaps, words = F.split("text", word, -1), F.regexp_extract_all("text", F.lit(word), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1))))
    kept = F.transform(words, lambda w, i: F.when(F.array_contains(F.col("_hit"), i), F.lit("")).otherwise(F.concat(F.get(gaps, i), w)))
    cut = F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))
    return unpacked(out.withColumn("_hit", hit), docs.columns, F.when(F.col("_runs").isNotNull(), cut).otherwise(F.col("text")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, p, p + least({WINDOW}, len(w)) - 1) AS g
        FROM i, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS k FROM win),
dw AS (SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS g FROM d, lens, unnest(range(1, len(w) - k + 2)) AS t(p)),
hit AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM hit, unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
