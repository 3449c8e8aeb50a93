"""Connected components of an undirected graph: by union-find in one task where the edges fit it, else by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import released, stored

#: Edges that one task may hold, at some 300 bytes each.
SMALL = 500_000


def components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node, component (the smallest node reachable) for each node of `edges` (a, b: longs); nodes without edges aren't
    there. Null ends and self-loops link nothing."""
    e = stored(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    return _in_task(e) if e.count() <= small else _by_stars(e, most_rounds)


def _in_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := above.setdefault(top, top)) != top:
                top = up
            while x != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(n) for n in part], pa.int64())], names=["node", "component"])

    return e.coalesce(1).mapInArrow(run, "node long, component long")


def _by_stars(e: DataFrame, most_rounds: int) -> DataFrame:
    """Each round is a written table. Stars keep the number of edges, and the groups are only reduced to minima, never gathered."""
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large-star: neighbours beyond a node join the node's least neighbour.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: neighbours up to a node, and the node, join the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = stored(small, "components")
        # Done when every node hangs on a root: no end of an edge has an edge of its own.
        left = new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1).count()
        several = new.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        released(e)
        e = new
        if not left and not several:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
