"""Graph operators over nodes (id, ...) and edges (src, dst, ...).

Walks and components have two ways. A graph of at most SMALL edges, counted first, fits a task, where a queue
gives every node's hop and its exact place in breadth-first order: the edges go to the tasks, the origins are dealt among them. A larger one is walked
level by level with joins, each level a written table, so no task holds the graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.storage import once, released, stored

#: Edges that one task may hold, at some 100 bytes each.
SMALL = 1_000_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, dependents: distinct sources that point at each node."""
    n = distinct_edges(edges).groupBy("dst").agg(F.count("*").alias("dependents"))
    return nodes.select("id").join(n.withColumnRenamed("dst", "id"), "id", "left").select("id", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, incoming, outgoing: edge rows, repeats counted."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points at and that aren't entry points (`is_entry_point`)."""
    return nodes.filter(~F.col("is_entry_point")).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reverse(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges turned round, those to unknown nodes dropped."""
    known = known_edges(distinct_edges(edges), nodes)
    return known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (id)."""
    ends = members.select("id").distinct()
    return edges.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def _is_small(edges: DataFrame, small: int) -> bool:
    return edges.limit(small + 1).count() <= small


def reach(edges: DataFrame, seeds: DataFrame, together: bool = False, small: int = SMALL, order: str = "dst", ranked: bool = False) -> DataFrame:
    """origin, id, hop, rank: what each seed (id) reaches along distinct edges, itself left out unless `together`.

    With `together` all seeds are one origin (null) at hop 0, and hop is the distance to the nearest. rank, null unless `ranked`, is the place in breadth-first
    order: by the rank of the parent that finds a node first, then by `order` of the edge (dst, or a column of `edges`).
    """
    cols = ["src", "dst"] + ([order] if order != "dst" else [])
    e = edges.select(*cols).groupBy("src", "dst").agg(F.min(order).alias("_ord")) if order != "dst" else distinct_edges(edges).withColumn("_ord", F.col("dst"))
    e = stored(e, "walk-edges")
    seeds = seeds.select("id").distinct()
    out = _reach_in_tasks(e, seeds, together) if _is_small(e, small) else _reach_by_joins(e, seeds, together, ranked)
    return out if ranked else out.withColumn("rank", F.lit(None).cast("long"))


def _reach_in_tasks(e: DataFrame, seeds: DataFrame, together: bool) -> DataFrame:
    kind = dict(e.dtypes)["src"]
    graph = e.sparkSession.sparkContext.broadcast(e.orderBy("src", "_ord", "dst").select("src", "dst").toArrow())  # SMALL rows at most

    def walk(starts: list, after: dict, origin: object) -> list[tuple]:
        hop = dict.fromkeys(starts, 0)
        rows = [(None, x, 0, k) for k, x in enumerate(starts)] if together else []
        todo, rank = deque(starts), len(rows) - 1 if together else 0
        while todo:
            a = todo.popleft()
            for b in after.get(a, ()):
                if b not in hop:
                    hop[b] = hop[a] + 1
                    rank += 1
                    rows.append((origin, b, hop[b], rank))
                    todo.append(b)
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: dict = {}
        for b in batches:
            if not after and len(b):
                for x, y in zip(graph.value["src"].to_pylist(), graph.value["dst"].to_pylist(), strict=True):
                    after.setdefault(x, []).append(y)
            ids = sorted(b["id"])
            for origin, starts in [(None, ids)] if together and ids else [(x, [x]) for x in ids]:
                yield pd.DataFrame(walk(starts, after, origin), columns=["origin", "id", "hop", "rank"])

    if together:  # the seeds of one walk are one batch: their number is bounded by the edges and themselves
        seeds = seeds.groupBy().agg(F.array_sort(F.collect_list("id")).alias("_all")).select("_all")

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from run(pd.DataFrame({"id": list(x)}) for b in batches for x in b["_all"])

        return seeds.mapInPandas(whole, f"origin {kind}, id {kind}, hop long, rank long")
    return seeds.mapInPandas(run, f"origin {kind}, id {kind}, hop long, rank long")


def _reach_by_joins(e: DataFrame, seeds: DataFrame, together: bool, ranked: bool) -> DataFrame:
    kind = dict(seeds.dtypes)["id"]
    none = F.lit(None).cast("long")
    start = seeds.select((F.lit(None).cast(kind) if together else F.col("id")).alias("origin"), "id", F.lit(0).cast("long").alias("hop"))
    first = F.row_number().over(Window.orderBy("id")) - 1 if together else F.lit(0)  # of the seeds of one walk
    front = stored(start.withColumn("rank", first.cast("long") if ranked else none), "reach")
    levels = [front]  # written once each; several are brought together now and then, so that plans stay short
    for hop in range(1, 1 << 30):
        seen = reduce(DataFrame.unionByName, levels)
        met = front.join(e, front["id"] == e["src"])
        met = met.groupBy("origin", F.col("dst").alias("id")).agg(F.min(F.struct("rank", "_ord")).alias("_by")) if ranked else met.select("origin", F.col("dst").alias("id")).distinct()
        new = met.join(seen.select(F.col("origin").alias("o"), F.col("id").alias("i")), F.col("origin").eqNullSafe(F.col("o")) & (F.col("id") == F.col("i")), "left_anti")
        if ranked:
            order = Window.partitionBy("origin").orderBy("_by", "id")
            base = seen.groupBy("origin").agg(F.max("rank").alias("_base"))
            new = new.join(base.withColumnRenamed("origin", "o"), F.col("origin").eqNullSafe(F.col("o"))).withColumn("rank", F.col("_base") + F.row_number().over(order))
        front = stored(new.select("origin", "id", F.lit(hop).cast("long").alias("hop"), F.col("rank") if ranked else none.alias("rank")), "reach")
        if not front.take(1):
            return seen if together else seen.filter("hop > 0")
        levels.append(front)
        if len(levels) > 16:
            merged = stored(reduce(DataFrame.unionByName, levels), "reach")
            released(*levels[:-1])
            levels = [merged]
    raise AssertionError


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id, scc_id (the smallest member) for each end of an edge."""
    e = stored(distinct_edges(edges), "scc-edges")
    kind = dict(edges.dtypes)["src"]
    if not _is_small(e, small):
        return _strong_by_joins(e)

    def tarjan(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for a, b in g[["src", "dst"]].itertuples(index=False):
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
        index: dict = {}
        low: dict = {}
        on: set = set()
        stack: list = []
        rows: list = []
        for root in sorted(after):
            if root in index:
                continue
            todo = [(root, iter(after[root]))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while todo:
                a, rest = todo[-1]
                for b in rest:
                    if b not in index:
                        index[b] = low[b] = len(index)
                        stack.append(b)
                        on.add(b)
                        todo.append((b, iter(after[b])))
                        break
                    if b in on:
                        low[a] = min(low[a], index[b])
                else:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[a])
                    if low[a] == index[a]:
                        members = []
                        while not members or members[-1] != a:
                            members.append(stack.pop())
                            on.discard(members[-1])
                        least = min(members)
                        rows += [(m, least) for m in members]
        return pd.DataFrame(rows, columns=["id", "scc_id"])

    return e.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(tarjan, f"id {kind}, scc_id {kind}")


def _strong_by_joins(e: DataFrame) -> DataFrame:
    """Trim, spread the least label forward, sweep back from each label's root within the label, remove, repeat."""
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    done = None
    e = stored(e.filter("src <> dst"), "scc")
    while True:
        # Trim: a node without an edge in or out is a component of its own.
        while True:
            core = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            less = stored(induced(e, core), "scc")
            if less.count() == e.count():
                break
            e = less
        if not e.take(1):
            break
        label = stored(e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "scc")
        while True:
            came = e.join(label.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
            new = stored(label.unionByName(came).groupBy("id").agg(F.min("label").alias("label")), "scc")
            moved = new.join(label.withColumnRenamed("label", "old"), "id").filter("label <> old").take(1)
            label = new
            if not moved:
                break
        inside = e.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst", F.col("a").alias("label"))
        found = label.filter("id = label")
        front = found
        while front.take(1):
            back = inside.join(front.select(F.col("id").alias("dst"), F.col("label").alias("l")), "dst").filter("label = l").select(F.col("src").alias("id"), "label").distinct()
            front = stored(back.join(found, ["id", "label"], "left_anti"), "scc")
            found = stored(found.unionByName(front), "scc")
        done = found if done is None else stored(done.unionByName(found), "scc")
        gone = found.select("id")
        e = stored(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc")
    if done is None:
        return ids.withColumn("scc_id", F.col("id"))
    return ids.join(done, "id", "left").select("id", F.coalesce("label", "id").alias("scc_id"))


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """scc_id, id: members of components of two nodes or more, and of single nodes with an edge to themselves."""
    c = strong_components(edges, small)
    several = c.groupBy("scc_id").agg(F.count("*").alias("n")).filter("n > 1").select("scc_id")
    selves = edges.filter("src = dst").select(F.col("src").alias("scc_id")).distinct()
    return c.join(several.union(selves).distinct(), "scc_id", "left_semi").select("scc_id", "id")


def cycle_paths(edges: DataFrame, small: int = SMALL, order: str = "dst") -> DataFrame:
    """scc_id, path: one closed walk for each cycle. From the smallest member the walk goes on along the edges inside the component, edges of a node to itself
    left out. Where one leads back to the walk, the first that does closes it, and the path is the part between; else the first is
    taken. Edges of a node come in the order of their dst, or of a column of `edges`."""
    kind = dict(edges.dtypes)["src"]
    edges = once(edges, "cycle-edges")
    member = cycles(edges, small)
    first = edges.groupBy("src", "dst").agg(F.min(order).alias("_ord")) if order != "dst" else distinct_edges(edges).withColumn("_ord", F.col("dst"))
    within = first.join(member.select("scc_id", F.col("id").alias("src")), "src").join(member.select(F.col("scc_id").alias("_other"), F.col("id").alias("dst")), "dst").filter("scc_id = _other").select("scc_id", "src", "dst", "_ord")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        scc, after = g["scc_id"].iloc[0], {}
        for a, b in g.sort_values(["src", "_ord", "dst"])[["src", "dst"]].itertuples(index=False):
            if a != b:
                after.setdefault(a, []).append(b)
        path, place, closed = [scc], {scc: 0}, 0
        while path[-1] in after:
            ways = after[path[-1]]
            back = next((b for b in ways if b in place), None)
            if back is not None:
                closed = place[back]
                break
            place[ways[0]] = len(path)
            path.append(ways[0])
        return pd.DataFrame({"scc_id": [scc], "path": [path[closed:]]})

    return within.groupBy("scc_id").applyInPandas(walk, f"scc_id {kind}, path array<{kind}>")
