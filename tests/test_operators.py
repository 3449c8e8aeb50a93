"""Graph and analysis operators on small graphs, both ways of walking, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import storage
from lattica.functions import classify
from lattica.operators import analytics, graph, resolve
from lattica.operators.ranking import placed
from lattica.plans import derived, registry, report

E_SCHEMA = "src long, dst long"


def walk(edges, start):
    hop, todo = {start: 0}, [start]
    order = []
    while todo:
        a = todo.pop(0)
        for b in sorted({y for x, y in edges if x == a}):
            if b not in hop:
                hop[b] = hop[a] + 1
                order.append(b)
                todo.append(b)
    return order, hop


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_reach_and_components(spark, small):
    random.seed(small)
    edges = [(random.randrange(14), random.randrange(14)) for _ in range(17)] + [(3, 3), (1, 2), (1, 2)]
    e = spark.createDataFrame(edges, E_SCHEMA)
    got = graph.reach(e, spark.createDataFrame([(1,), (5,)], "id long"), small=small, ranked=True).orderBy("origin", "rank").collect()
    for s in (1, 5):
        order, hop = walk(edges, s)
        assert [(r["id"], r["hop"]) for r in got if r["origin"] == s] == [(x, hop[x]) for x in order]
    assert {(r["origin"], r["id"], r["hop"]) for r in graph.reach(e, spark.createDataFrame([(1,), (5,)], "id long"), small=small).collect()} == {(r["origin"], r["id"], r["hop"]) for r in got}
    near = {r["id"]: r["hop"] for r in graph.reach(e, spark.createDataFrame([(1,), (5,)], "id long"), together=True, small=small).collect()}
    a, b = walk(edges, 1)[1], walk(edges, 5)[1]
    assert near == {x: min(a.get(x, 99), b.get(x, 99)) for x in a.keys() | b.keys()}
    reach = {x: set(walk(edges, x)[0]) | {x} for x in {v for p in edges for v in p}}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
    assert {r["id"]: r["scc_id"] for r in graph.strong_components(e, small=small).collect()} == want
    groups = [[x for x in want if want[x] == g] for g in set(want.values())]
    cyc = {r["id"] for r in graph.cycles(e, small=small).collect()}
    assert cyc == {x for g in groups for x in g if len(g) > 1 or (x, x) in edges}


def test_cycle_path_is_a_closed_walk(spark):
    edges = [(1, 2), (2, 3), (3, 2), (3, 1), (7, 7), (8, 9)]
    got = {r["scc_id"]: r["path"] for r in graph.cycle_paths(spark.createDataFrame(edges, E_SCHEMA)).collect()}
    assert got[7] == [7] and set(got) == {1, 7}
    for p in got.values():
        assert all(x in edges for x in zip(p, p[1:] + p[:1], strict=True))


def test_cycle_path_closes_at_the_first_edge_back(spark):
    edges = [(1, 5), (5, 6), (6, 2), (6, 5), (2, 1)]
    assert graph.cycle_paths(spark.createDataFrame(edges, E_SCHEMA)).first()["path"] == [5, 6]
    ordered = spark.createDataFrame([(1, 2, 9), (1, 3, 1), (3, 4, 0), (4, 3, 5), (4, 1, 2), (2, 1, 0)], "src long, dst long, ord long")
    assert graph.cycle_paths(ordered, order="ord").first()["path"] == [1, 3, 4]


def test_long_walks_by_joins(spark):
    """More levels than are kept apart."""
    e = spark.createDataFrame([(k, k + 1) for k in range(20)], E_SCHEMA)
    got = graph.reach(e, spark.createDataFrame([(0,)], "id long"), small=0).collect()
    assert sorted((r["id"], r["hop"]) for r in got) == [(k, k) for k in range(1, 21)]


@pytest.mark.parametrize(("length", "small"), [(200, 1_000_000), (20, 0)])
def test_exports_close_however_long_the_chain(spark, length, small):
    own = spark.createDataFrame([("f0", "x", "s"), ("f0", "y", "t")], "file string, name string, symbol string")
    stars = spark.createDataFrame([(f"f{k + 1}", f"f{k}") for k in range(length)] + [("f0", f"f{length}")], "file string, from_file string")
    named = spark.createDataFrame([("g0", "z0", f"f{length}", "x")] + [(f"g{k + 1}", f"z{k + 1}", f"g{k}", f"z{k}") for k in range(length // 4)], "file string, name string, from_file string, from_name string")
    got = {(r["file"], r["name"], r["symbol"]) for r in resolve.export_closure(own, named, stars, small).collect()}
    assert got == {(f"f{k}", n, s) for k in range(length + 1) for n, s in (("x", "s"), ("y", "t"))} | {(f"g{k}", f"z{k}", "s") for k in range(length // 4 + 1)}


def test_places_in_order_within_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abbbbb"), k) for k in rng.sample(range(10_000), 800)] + [(None, 3)]
    got = {(r["g"], r["k"]): (r["at"], r["_size"]) for r in placed(spark.createDataFrame(rows, "g string, k long").repartition(6), "g", "k", "at").collect()}
    for g in {g for g, _ in rows}:
        own = sorted(k for h, k in rows if h == g)
        assert [got[g, k] for k in own] == [(n, len(own)) for n in range(len(own))]


def test_stored_tables_are_released(spark):
    from pathlib import Path

    t = storage.stored(spark.range(3), "test")
    path = Path(t._stored_at.removeprefix("file://"))
    assert path.exists() and storage.once(t, "x") is t
    storage.released(t)
    assert not path.exists()


def test_degrees_orphans_and_empty_graphs(spark):
    nodes = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "id long, is_entry_point boolean")
    e = spark.createDataFrame([(1, 2), (1, 2), (4, 4), (1, 99)], E_SCHEMA)
    assert {r["id"]: r["dependents"] for r in graph.in_degrees(nodes, e).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert {r["id"]: (r["incoming"], r["outgoing"]) for r in graph.edge_counts(nodes, e).collect()} == {1: (0, 3), 2: (2, 0), 3: (0, 0), 4: (1, 1)}
    assert [r["id"] for r in graph.orphans(nodes, e).collect()] == [1]
    assert graph.reverse(e, nodes).count() == 2
    none = e.limit(0)
    assert graph.cycles(none).count() == 0 and graph.strong_components(none).count() == 0 and graph.reach(none, nodes.select("id")).count() == 0


def test_classification(spark):
    cases = {
        "src/billing/x.ts": ("billing", False, "Other"), "pages/x.ts": ("pages", True, "Presentation"), "src/x.ts": ("(root)", False, "Other"), "app/a/page.tsx": ("app", True, "Presentation"), "app/a/layout.jsx": ("app", False, "Presentation"),
        "src/services/db/q.ts": ("services", False, "Data"), "a/hooks/h.ts": ("a", False, "Application"), "x/clients/c.ts": ("x", False, "Services"), "config/c.ts": ("config", False, "Infrastructure"),
    }
    p = F.col("path")
    d = spark.createDataFrame([(x,) for x in cases], "path string").select(p, classify.module_name(p).alias("m"), classify.is_route(p).alias("r"), classify.layer(p, F.lit("utility")).alias("l"))
    assert {r["path"]: (r["m"], r["r"], r["l"]) for r in d.collect()} == cases
    entries = {"a.test.ts": True, "x/__tests__/a.ts": True, "b.stories.mjs": True, "vite.config.ts": True, "x/vite.config.ts": False, "middleware.js": True, "c.ts": False}
    d = spark.createDataFrame([(x,) for x in entries], "path string").select(p, classify.is_entry_by_path(p).alias("e"))
    assert {r["path"]: r["e"] for r in d.collect()} == entries


def test_resolution(spark):
    files = spark.createDataFrame([("x/a.ts",), ("x/b/index.js",), ("x/c",), ("x/c.ts",)], "path string")
    asked = spark.createDataFrame([(1, "x/a"), (2, "x/b"), (3, "x/c"), (4, "x/d")], "k int, p string").select("k", resolve.candidates(F.col("p")).alias("candidates"))
    assert {r["k"]: r["path"] for r in resolve.first_match(asked, files, ["k"]).collect()} == {1: "x/a.ts", 2: "x/b/index.js", 3: "x/c"}
    own = spark.createDataFrame([("a", "x", "ax"), ("b", "x", "bx"), ("a", "default", "ad"), ("c", "y", "cy")], "file string, name string, symbol string")
    named = spark.createDataFrame([("d", "z", "e", "z"), ("e", "z", "d", "z"), ("f", "w", "c", "y")], "file string, name string, from_file string, from_name string")
    stars = spark.createDataFrame([("c", "a"), ("g", "c"), ("c", "g"), ("h", "a"), ("h", "b")], "file string, from_file string")
    for small in (1_000_000, 0):
        got = {(r["file"], r["name"]): r["symbol"] for r in resolve.export_closure(own, named, stars, small).collect()}
        assert got == {("a", "x"): "ax", ("b", "x"): "bx", ("a", "default"): "ad", ("c", "y"): "cy", ("c", "x"): "ax", ("g", "x"): "ax", ("g", "y"): "cy", ("f", "w"): "cy"}


def test_paths_of_files_are_never_broadcast(spark, tmp_path):
    spark.range(100).select(F.concat(F.lit("m"), "id", F.lit(".ts")).alias("path")).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    asked = spark.range(110).select("id", resolve.candidates(F.concat(F.lit("m"), "id")).alias("candidates"))
    got = resolve.first_match(asked, files, ["id"])
    assert sorted(map(tuple, got.collect())) == [(k, f"m{k}.ts") for k in range(100)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_times_round_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    at = [-61_500_000, -60_499_999, -1_500_000, -1, 0, 499_999, 500_000, 1_500_000, 60_600_000, 61_600_000, 4_600_000_500_000]
    duckdb.sql(f"COPY (SELECT i AS event_id, make_timestamp(x) AS ts, i % 2 AS user_id FROM (SELECT unnest({at}) AS x, unnest({[24 * k for k in range(len(at))]}) AS i) UNION ALL SELECT 999, NULL, 1) TO '{tmp_path}/events.parquet'")
    events = derived.table(spark, str(tmp_path), "events")
    want = dict(duckdb.sql(f"SELECT event_id, epoch(ts)::BIGINT FROM '{tmp_path}/events.parquet'").fetchall())
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {r[0]: r[1] for r in events.select("event_id", derived.nearest_second(events, "ts")).collect()} == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r[0]: r[1] for r in zoned.select("event_id", derived.nearest_second(zoned, "ts")).collect()} == want
    sql = registry.ORACLE_SQL["nearest_enclosing"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    assert sorted(map(tuple, registry.QUERIES["nearest_enclosing"](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())


def test_text():
    assert report.bar(5, 10) == "█████░░░░░" and report.bar(1, 0) == "░" * 10 and report.fixed(1.45) == "1.4" and report.fixed(2.5) == "2.5"
    assert report.rows([("a", 1), ("long", 1234)]) == ["a          1", "long    1234"]
    assert report.relative("/r/a/b", "/r/") == "a/b" and report.relative("/rx/a", "/r") == "/rx/a"


def test_every_query_has_its_names(spark):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert analytics.find_symbols(spark.createDataFrame([(1, "a_b"), (2, "axb")], "id int, name string"), "A_B").count() == 1
