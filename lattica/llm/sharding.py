"""Sharding by longest processing time: groups of equal texts, largest first, each to the least loaded shard.

The heap's order is worked out on the driver over (group size, number of groups), not over groups. Groups of one size go to the shards in the order of
the loads that these would come to, (load + k * size, shard) for k = 0, 1, ...: from level to level of `size` bytes the shards take turns in one order,
and a shard comes in at the level of its load. So a size has at most as many runs as there are shards, however uneven the loads are (one group may
outweigh a shard), and a run is its first rank and its order. Sizes are streamed, largest first, and runs written as a table, PART rows at a time; the driver
keeps the shards' loads only. Which group of a size goes where follows from its gapless number among those of its size, by a join on the size.

Defined cases: a null text has size 1 and is one group with the empty text; rows that repeat a doc_id are placed each by itself (by text);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import stored, table, with_rid
from lattica.llm.ranking import ranked

SHARDS = 8
#: Runs that are written together; groups of one size that a task numbers.
PART, NUMBERED = 200_000, 100_000
_LAST = (1 << 63) - 1


def lpt_runs(sizes: Iterable[tuple[int, int]], shards: int = SHARDS) -> Iterator[tuple[int, int, int, list[int]]]:
    """size, first rank, rank after the last (or _LAST), shards in turn: for each run. sizes: (size, number of groups), largest first."""
    loads = [0] * shards
    for size, count in sizes:
        levels = sorted({load // size for load in loads})
        at = 0
        for level, above in zip(levels, [*levels[1:], None], strict=True):
            turn = [s for _, s in sorted((loads[s] % size, s) for s in range(shards) if loads[s] // size <= level)]
            stop = count if above is None else min(count, at + (above - level) * len(turn))
            yield size, at, _LAST if above is None else stop, turn
            rounds, more = divmod(stop - at, len(turn))
            for k, s in enumerate(turn):
                loads[s] += (rounds + (k < more)) * size
            at = stop
            if at == count:
                break


def digests(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, size (UTF-8 bytes plus 1), text_crc32, _text (a digest that stands for the text)."""
    text = F.coalesce("text", F.lit(""))
    return with_rid(docs.select("doc_id", "text")).select("_rid", "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_text"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) for each row of `docs`."""
    rows = stored(digests(docs), "shard-digests")
    groups = stored(rows.groupBy("_text").agg(F.sum("size").alias("_bytes")), "shard-groups")
    sizes = stored(groups.groupBy("_bytes").agg(F.count("*").alias("n")), "shard-sizes")
    spark, runs = docs.sparkSession, None
    dealt = lpt_runs(((r["_bytes"], r["n"]) for r in sizes.orderBy(F.desc("_bytes")).toLocalIterator()), shards)
    while part := list(itertools.islice(dealt, PART)):
        some = stored(spark.createDataFrame(part, "_bytes long, _from long, _to long, _turn array<int>"), "shard-runs")
        runs = some if runs is None else runs.unionByName(some)
    if runs is None:
        runs = spark.createDataFrame([], "_bytes long, _from long, _to long, _turn array<int>")
    most = sizes.agg(F.max("n")).first()[0] or 0
    numbered = ranked(groups, ["_bytes"], F.col("_text"), [F.col("_text")], "_rank", slices=max(64, -(-most // NUMBERED)))
    here = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    turn = F.get("_turn", ((F.col("_rank") - F.col("_from")) % F.size("_turn")).cast("int"))
    placed = numbered.join(runs, "_bytes").filter(here).select("_text", turn.alias("shard"))
    out = stored(rows.join(placed, "_text").drop("_text"), "shard-placed")
    out = ranked(out, ["shard"], F.col("_rid"), [F.col("_rid")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
