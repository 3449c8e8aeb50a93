"""The registered queries over the driver's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import analytics, graph, resolve
from lattica.plans.derived import EVENT_SQL, EXPORT_SQL, FK_SQL, SQL, event_usages, key_edges, key_exports, key_nodes, nearest_second, part_edges, part_files, table, virtual_sources
from lattica.plans.project import read_facts, resolved
from lattica.sources.project_files import Resolver
from lattica.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TARGET, CHANGED = 1, (1, 7, 42)
ASKED = "P1"


def query(sql: str | None, recursive: bool = False, base: str = SQL) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{base.strip()}{sql}"
        return f

    return register


def ids(spark: SparkSession, values: tuple[int, ...]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias("id"))


_CYCLES_SQL = """, r AS (SELECT src AS a, dst AS b FROM p UNION SELECT r.a, p.dst FROM r JOIN p ON p.src = r.b),
m AS (SELECT x.a AS id, least(min(x.b), x.a) AS scc_id FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""
_MODULES_SQL = """, xp AS (SELECT a.module AS ma, b.module AS mb FROM p JOIN f a ON a.id = p.src JOIN f b ON b.id = p.dst WHERE a.module <> b.module),
mm AS (SELECT module, count(*) AS file_count, sum(import_count)::BIGINT AS dependency_count, (SELECT count(*) FROM xp WHERE mb = module) AS ca, (SELECT count(*) FROM xp WHERE ma = module) AS ce,
  (SELECT count(*) FROM xp WHERE ma = module OR mb = module) AS coupling, sum(complexity_total)::DOUBLE / count(*) AS complexity_average FROM f GROUP BY module)"""
_KIND = "CASE WHEN is_entry_point THEN 'entry' WHEN has_component THEN 'component' WHEN has_class THEN 'class' WHEN regexp_matches(path, '(?i)/(services|api|clients)/') THEN 'service' ELSE 'utility' END"
_LAYER = """CASE WHEN regexp_matches(lower(path), '(^|/)(models?|db|database|repositories|schema|prisma|migrations)(/|$)') THEN 'Data'
  WHEN regexp_matches(lower(path), '(^|/)(config|infra|infrastructure|middleware)(/|$)') THEN 'Infrastructure'
  WHEN regexp_matches(lower(path), '(^|/)(services|api|clients)(/|$)') THEN 'Services'
  WHEN regexp_matches(lower(path), '(^|/)(components|pages|app|views|screens)(/|$)') OR file_kind = 'component' THEN 'Presentation'
  WHEN regexp_matches(lower(path), '(^|/)(hooks|store|state|context|reducers|lib|core)(/|$)') THEN 'Application' ELSE 'Other' END"""
_CLASSIFIED_SQL = f", c0 AS (SELECT *, {_KIND} AS file_kind FROM f), c AS (SELECT *, {_LAYER} AS layer FROM c0)"
_IMPACT_SQL = ", r AS (SELECT {0} AS origin, {0} AS id UNION SELECT r.origin, p.src FROM r JOIN p ON p.dst = r.id)"
_CHANGED_SQL = f", ch AS (SELECT unnest([{', '.join(map(str, CHANGED))}])::BIGINT AS id), r AS (SELECT id AS origin, id FROM ch UNION SELECT r.origin, p.src FROM r JOIN p ON p.dst = r.id)"


@query("SELECT id, path, dependents FROM (SELECT dst, count(*) AS dependents FROM p GROUP BY dst) JOIN f ON f.id = dst ORDER BY dependents DESC, path COLLATE NOCASE LIMIT 10")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hotspots(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query("SELECT id, (SELECT count(*) FROM p WHERE dst = f.id) AS dependents FROM f")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degrees(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query("SELECT id, (SELECT count(*) FROM pe WHERE dst = f.id) AS incoming, (SELECT count(*) FROM pe WHERE src = f.id) AS outgoing FROM f")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_counts(part_files(spark, sf_dir), part_edges(spark, sf_dir)).select("id", F.col("incoming").cast("long"), F.col("outgoing").cast("long"))


@query("SELECT id, path FROM f WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM pe)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(part_files(spark, sf_dir), part_edges(spark, sf_dir)).select("id", "path")


@query("SELECT DISTINCT dst AS src, src AS dst FROM pe WHERE dst IN (SELECT id FROM f)")
def reversed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse(part_edges(spark, sf_dir), part_files(spark, sf_dir))


@query(_CYCLES_SQL + """ SELECT count(*) AS files, sum(component_count)::BIGINT AS components, sum(function_count)::BIGINT AS functions, sum(class_count)::BIGINT AS classes, sum(import_count)::BIGINT AS imports,
 sum(export_count)::BIGINT AS exports, sum(complexity_total)::BIGINT AS complexity, (SELECT count(DISTINCT scc_id) FROM m) AS circular_deps, (SELECT count(*) FROM f WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM pe)) AS orphan_files FROM f""", recursive=True)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.summary(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query(_MODULES_SQL + " SELECT * FROM mm")
def module_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.module_metrics(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query(_MODULES_SQL + " SELECT module, coupling FROM mm WHERE coupling > 0 ORDER BY coupling DESC, module LIMIT 3")
def top_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_coupled(module_metrics(spark, sf_dir)).select("module", "coupling")


@query(_MODULES_SQL + f" SELECT coalesce(bool_or(coupling > 0 AND coupling >= (SELECT avg(coupling) FROM mm)), false) AS high_coupling FROM f JOIN mm USING (module) WHERE id IN {CHANGED}")
def coupling_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.risky(part_files(spark, sf_dir), part_edges(spark, sf_dir), ids(spark, CHANGED))


@query(_CYCLES_SQL + " SELECT id, scc_id FROM m WHERE id <> scc_id OR scc_id IN (SELECT scc_id FROM m GROUP BY scc_id HAVING count(*) > 1) OR id IN (SELECT src FROM p WHERE src = dst)", recursive=True)
def cycle_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(part_edges(spark, sf_dir)).select("id", "scc_id")


@query(_CYCLES_SQL + ", n AS (SELECT src AS id FROM p UNION SELECT dst FROM p) SELECT n.id, coalesce(m.scc_id, n.id) AS scc_id FROM n LEFT JOIN m USING (id)", recursive=True)
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(part_edges(spark, sf_dir))


#: The walk of each cycle as it grows; _c: what closes it.
_WALK_SQL = _CYCLES_SQL + """, cy AS (SELECT id, scc_id FROM m WHERE scc_id IN (SELECT scc_id FROM m GROUP BY scc_id HAVING count(*) > 1) OR id IN (SELECT src FROM p WHERE src = dst)),
inside AS (SELECT a.scc_id, p.src, p.dst FROM p JOIN cy a ON a.id = p.src JOIN cy b ON b.id = p.dst AND b.scc_id = a.scc_id WHERE p.src <> p.dst),
w AS (SELECT DISTINCT scc_id, [scc_id] AS path, NULL::BIGINT AS back FROM cy
      UNION ALL SELECT w.scc_id, CASE WHEN count(*) FILTER (list_contains(w.path, i.dst)) > 0 THEN w.path ELSE list_append(w.path, min(i.dst)) END, min(i.dst) FILTER (list_contains(w.path, i.dst))
      FROM w JOIN inside i ON i.scc_id = w.scc_id AND i.src = w.path[len(w.path)] WHERE w.back IS NULL GROUP BY w.scc_id, w.path),
paths AS (SELECT scc_id, CASE WHEN back IS NULL THEN path ELSE path[list_position(path, back):] END AS path FROM w WHERE back IS NOT NULL OR scc_id NOT IN (SELECT scc_id FROM inside))"""


@query(_WALK_SQL + " SELECT scc_id, array_to_string(path, ' ') AS path FROM paths", recursive=True)
def cycle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_paths(part_edges(spark, sf_dir)).select("scc_id", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query(_IMPACT_SQL.format(f"{TARGET}::BIGINT") + f" SELECT r.id, path, is_route FROM r JOIN f USING (id) WHERE r.id <> {TARGET}", recursive=True)
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_files(spark, sf_dir)
    return analytics.impact(f, part_edges(spark, sf_dir), ids(spark, (TARGET,))).join(f.select("id", "path"), "id").select("id", "path", "is_route")


@query(f", r(id, hop) USING KEY (id) AS (SELECT {TARGET}::BIGINT AS id, 0 AS hop UNION SELECT p.src, min(r.hop) + 1 FROM r JOIN p ON p.dst = r.id WHERE p.src NOT IN (SELECT id FROM recurring.r) GROUP BY p.src) SELECT id, hop::BIGINT AS hop FROM r WHERE id <> {TARGET}", recursive=True)
def impact_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.impact(part_files(spark, sf_dir), part_edges(spark, sf_dir), ids(spark, (TARGET,))).select("id", "hop")


@query(_IMPACT_SQL.format(f"{TARGET}::BIGINT") + f" SELECT r.id FROM r JOIN f USING (id) WHERE r.id <> {TARGET} AND is_route", recursive=True)
def impact_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.impact(part_files(spark, sf_dir), part_edges(spark, sf_dir), ids(spark, (TARGET,))).filter("is_route").select("id")


@query(_CHANGED_SQL + " SELECT DISTINCT id, is_route FROM r JOIN f USING (id) WHERE id NOT IN (SELECT id FROM ch)", recursive=True)
def diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.diff_impact(part_files(spark, sf_dir), part_edges(spark, sf_dir), ids(spark, CHANGED)).select("id", "is_route").distinct()


@query(_CHANGED_SQL + " SELECT ch.id, (SELECT count(*) FROM r WHERE r.origin = ch.id AND r.id NOT IN (SELECT id FROM ch)) AS impacted_count FROM ch JOIN f USING (id)", recursive=True)
def diff_impact_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.diff_counts(part_files(spark, sf_dir), part_edges(spark, sf_dir), ids(spark, CHANGED))


_HOPS_SQL = f", r(id, hop) USING KEY (id) AS (SELECT unnest([{', '.join(map(str, CHANGED))}])::BIGINT AS id, 0 AS hop UNION SELECT p.src, min(r.hop) + 1 FROM r JOIN p ON p.dst = r.id WHERE p.src NOT IN (SELECT id FROM recurring.r) GROUP BY p.src), h AS (SELECT id, hop::BIGINT AS hop FROM r)"


@query(_HOPS_SQL + " SELECT id, hop FROM h", recursive=True)
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hop_distances(part_edges(spark, sf_dir), part_files(spark, sf_dir), ids(spark, CHANGED))


@query(_HOPS_SQL + " SELECT coalesce(hop, 1)::BIGINT AS hop, count(*) AS files FROM f LEFT JOIN h USING (id) GROUP BY 1", recursive=True)
def hop_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_files(spark, sf_dir)
    return analytics.hop_rings(analytics.hop_distances(part_edges(spark, sf_dir), f, ids(spark, CHANGED)), f)


@query(f", r AS (SELECT {TARGET}::BIGINT AS id UNION SELECT p.dst FROM r JOIN p ON p.src = r.id) SELECT id FROM r WHERE id <> {TARGET}", recursive=True)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(part_edges(spark, sf_dir), ids(spark, (TARGET,))).select("id")


@query(f", r AS (SELECT 'n:5' AS id UNION SELECT k.src FROM r JOIN k ON k.dst = r.id) SELECT id FROM r WHERE id <> 'n:5'", recursive=True, base=FK_SQL)
def key_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = key_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(e, spark.range(1).select(F.lit("n:5").alias("id"))).select("id")


_START = "click#3"


@query(f", r AS (SELECT '{_START}' AS id UNION SELECT to_symbol FROM r JOIN u ON u.from_symbol = r.id) SELECT DISTINCT kind, from_symbol, to_symbol FROM u WHERE from_symbol IN (SELECT id FROM r) AND to_symbol IN (SELECT id FROM r)", recursive=True, base=EVENT_SQL)
def call_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = event_usages(spark, sf_dir).distinct()
    start = spark.range(1).select(F.lit(_START).alias("id"))
    e = u.select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst"), "kind")
    members = graph.reach(e, start).select("id").union(start)
    return graph.induced(e, members).select("kind", F.col("src").alias("from_symbol"), F.col("dst").alias("to_symbol"))


@query(" SELECT DISTINCT from_symbol, to_symbol, kind FROM u WHERE split_part(from_symbol, '#', 2)::INT = 3 OR split_part(to_symbol, '#', 2)::INT = 3", base=EVENT_SQL)
def symbol_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = event_usages(spark, sf_dir)
    s = u.select(F.col("from_symbol").alias("symbol_id")).union(u.select("to_symbol")).distinct().withColumn("file_id", F.substring_index("symbol_id", "#", -1).cast("int"))
    return analytics.neighbourhood(s, u, F.lit(3))


@query(f" SELECT DISTINCT 'dependsOn' AS direction, dst AS id FROM p WHERE src = {TARGET} UNION SELECT 'dependents', src FROM p WHERE dst = {TARGET}")
def direct_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.direct(part_files(spark, sf_dir), part_edges(spark, sf_dir), F.lit(TARGET))


@query(_CLASSIFIED_SQL + " SELECT id, path, module, is_route, is_entry_point, file_kind, layer FROM c")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.classified(part_files(spark, sf_dir)).select("id", "path", "module", "is_route", "is_entry_point", "file_kind", "layer")


@query(_CLASSIFIED_SQL + " SELECT layer, count(*) AS files, list_position(['Presentation', 'Application', 'Services', 'Data', 'Infrastructure', 'Other'], layer)::BIGINT AS ord FROM c GROUP BY layer")
def blueprint_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.layer_sizes(analytics.classified(part_files(spark, sf_dir)))


@query(_CLASSIFIED_SQL + " SELECT a.layer AS from_layer, b.layer AS to_layer, count(*) AS edges FROM pe JOIN c a ON a.id = pe.src JOIN c b ON b.id = pe.dst WHERE a.layer <> b.layer GROUP BY 1, 2")
def blueprint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.layer_edges(analytics.classified(part_files(spark, sf_dir)), part_edges(spark, sf_dir)).select("from_layer", "to_layer", "edges")


@query(_CLASSIFIED_SQL + ", g AS (SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 AS i FROM c) SELECT id, layer, i % 5 AS col, i // 5 AS row FROM g")
def layer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.layer_grid(analytics.classified(part_files(spark, sf_dir)))


@query(_CYCLES_SQL + _MODULES_SQL + """, x AS (SELECT sum(function_count)::BIGINT AS functions, sum(complexity_total) AS total, (SELECT count(DISTINCT scc_id) FROM m) AS cycles, (SELECT count(*) FROM f WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM pe)) AS orphans,
 (SELECT count(*) FROM mm WHERE coupling > 0 AND coupling >= (SELECT avg(coupling) FROM mm)) AS coupled_modules FROM f),
y AS (SELECT *, total::DOUBLE / functions AS average_complexity, greatest(0, least(100, 100 - 15 * cycles - 5 * coupled_modules))::BIGINT AS modularity, greatest(0, least(100, 100 - 4 * orphans))::BIGINT AS dependency_health FROM x),
z AS (SELECT *, CASE WHEN average_complexity > 10 THEN greatest(0, least(100, floor(100 - 5 * (average_complexity - 10) + 0.5)))::BIGINT ELSE 100 END AS complexity FROM y),
o AS (SELECT *, floor((modularity + dependency_health + complexity) / 3.0 + 0.5)::BIGINT AS overall FROM z)
SELECT functions, cycles, orphans, coupled_modules, average_complexity, modularity, dependency_health, complexity, overall, CASE WHEN overall >= 80 THEN 'good' WHEN overall >= 50 THEN 'warn' ELSE 'bad' END AS band FROM o""", recursive=True)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.health(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query(_CYCLES_SQL + _MODULES_SQL + """ SELECT 1 AS section, scc_id::VARCHAR AS item, count(*) AS value FROM m GROUP BY scc_id
 UNION ALL SELECT 2, path, 0 FROM f WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM pe)
 UNION ALL SELECT * FROM (SELECT 3, module, coupling FROM mm WHERE coupling > 0 ORDER BY coupling DESC, module LIMIT 3)""", recursive=True)
def attention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.attention(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'wid')")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.find_symbols(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "WID")


@query("SELECT * FROM (SELECT 'file' AS kind, id, path AS label FROM f WHERE contains(lower(path), 'p1') ORDER BY id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'symbol', p_partkey, p_name FROM part WHERE contains(lower(p_name), 'p1') ORDER BY 2 LIMIT 8)")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.palette(part_files(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ASKED)


@query(""", t AS (SELECT string_split(path, '/') AS s FROM f)
SELECT DISTINCT array_to_string(s[1:n], '/') AS path, array_to_string(s[1:n-1], '/') AS parent, s[n] AS name, n < len(s) AS is_dir, (n - 1)::BIGINT AS depth FROM t, unnest(range(1, len(s) + 1)) AS u(n)""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.file_tree(part_files(spark, sf_dir))


@query("SELECT DISTINCT src, dst FROM pe")
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_edges(part_edges(spark, sf_dir))


@query("SELECT src, dst, kind FROM pe WHERE kind <> 'reExport'")
def hide_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).filter("kind <> 'reExport'")


@query("""c AS (SELECT p_partkey AS id, p_partkey + p_size AS of, unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mts', '.cts', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mts', '/index.cts', '/index.mjs', '/index.cjs']) AS x, unnest(range(17)) AS pos FROM part),
d AS (SELECT 'm' || p_partkey || (['.ts', '.tsx', '.js', '/index.ts', '/index.js'])[p_partkey % 5 + 1] AS path FROM part UNION SELECT 'm' || p_partkey || (['.cjs', '.jsx', '/index.mts'])[p_partkey % 3 + 1] FROM part)
SELECT id, min_by(path, pos) AS path FROM (SELECT c.id, c.pos, 'm' || c.of || c.x AS path FROM c) JOIN d USING (path) GROUP BY id""", base="")
def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    with_one = lambda *x: F.concat(F.lit("m"), F.col("id"), F.element_at(F.array(*[F.lit(e) for e in x]), (F.col("id") % len(x)).cast("int") + 1)).alias("path")
    there = k.select(with_one(".ts", ".tsx", ".js", "/index.ts", "/index.js")).union(k.select(with_one(".cjs", ".jsx", "/index.mts")))
    asked = k.select("id", resolve.candidates(F.concat(F.lit("m"), F.col("id") + F.col("p_size"))).alias("candidates"))
    return resolve.first_match(asked, there, ["id"])


@query(""", r AS (SELECT file, name, symbol FROM own
  UNION (SELECT n.file, n.name, r.symbol FROM r JOIN named n ON n.from_file = r.file AND n.from_name = r.name
         UNION ALL SELECT s.file, r.name, r.symbol FROM r JOIN stars s ON s.from_file = r.file WHERE r.name <> 'default' AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.file = s.file AND h.name = r.name)))
SELECT file, name, min(symbol) AS symbol FROM r GROUP BY file, name HAVING count(DISTINCT symbol) = 1""", recursive=True, base=EXPORT_SQL)
def export_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.export_closure(*key_exports(spark, sf_dir))


@query("""ev AS (SELECT event_id, user_id AS scope, epoch(ts)::BIGINT AS at_ FROM events),
rg AS (SELECT event_id AS range_id, scope, at_ - 60 AS start, at_ + 3600 * (1 + event_id % 24) AS end_ FROM ev)
SELECT e.event_id AS site_id, max_by(r.range_id, (r.start, r.range_id)) AS range_id FROM ev e JOIN rg r ON r.scope = e.scope AND r.start <= e.at_ AND e.at_ < r.end_ GROUP BY e.event_id""", base="")
def nearest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    e = ev.select(F.col("event_id").alias("site_id"), F.col("user_id").alias("scope"), nearest_second(ev, "ts").alias("at"))
    r = e.select("scope", F.col("site_id").alias("range_id"), (F.col("at") - 60).alias("start"), (F.col("at") + 3600 * (1 + F.col("site_id") % 24)).alias("end"))
    return resolve.nearest_enclosing(e, r, "scope")


@query("SELECT '/v/p' || src || '.ts' AS src, '/v/p' || dst || '.ts' AS dst, kind, count(*) AS edges FROM pe GROUP BY src, dst, kind")
def parse_virtual_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stored(read_facts(virtual_sources(spark, sf_dir), Resolver()), "facts")
    return resolved(facts).groupBy(F.col("path").alias("src"), F.col("to").alias("dst"), "kind").agg(F.count("*").alias("edges"))


@query("SELECT id, path, complexity_total FROM f WHERE complexity_total > 10")
def complex_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.complex_files(part_files(spark, sf_dir)).select("id", "path", F.col("complexity_total").cast("int"))


@query("SELECT id, contains(lower(path), 'brand1/') AS matches FROM f")
def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.highlighted(part_files(spark, sf_dir), " Brand1/ ")


@query("SELECT id, least(40, greatest(10, 10 + 3 * (SELECT count(*) FROM pe WHERE dst = f.id)))::BIGINT AS size FROM f")
def node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.nodes_drawn(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query(_CYCLES_SQL + """ SELECT count(*) AS files, sum(component_count)::BIGINT AS components, sum(function_count)::BIGINT AS functions, sum(class_count)::BIGINT AS classes, sum(import_count)::BIGINT AS imports, sum(export_count)::BIGINT AS exports, sum(complexity_total)::BIGINT AS complexity,
 (SELECT count(DISTINCT scc_id) FROM m) AS circular_deps, (SELECT count(*) FROM f WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM pe)) AS orphan_files, (SELECT count(*) FROM pe) AS edges, count(*) FILTER (is_entry_point) AS entry_points FROM f""", recursive=True)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overview(part_files(spark, sf_dir), part_edges(spark, sf_dir))


@query(_WALK_SQL + " SELECT DISTINCT id FROM (SELECT unnest(path) AS id FROM paths) JOIN f USING (id)", recursive=True)
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.in_cycle_path(part_files(spark, sf_dir), part_edges(spark, sf_dir)).select("id")


@query(None)
def ring_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ring_places(hop_distance(spark, sf_dir))


# The graphs of keys and of events are sparse: most keys have few edges, and each user's events form components of their own.

_KEY_NODES_SQL = """, kn AS (SELECT 'o:' || o_orderkey AS id, o_orderstatus = 'O' AS is_entry_point FROM orders UNION ALL SELECT 'c:' || c_custkey, false FROM customer UNION ALL SELECT 's:' || s_suppkey, false FROM supplier
 UNION ALL SELECT 'p:' || p_partkey, false FROM part UNION ALL SELECT 'n:' || n_nationkey, false FROM nation UNION ALL SELECT 'r:' || r_regionkey, false FROM region)"""


@query(_KEY_NODES_SQL + " SELECT id FROM kn WHERE NOT is_entry_point AND id NOT IN (SELECT dst FROM k)", base=FK_SQL)
def key_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(key_nodes(spark, sf_dir), key_edges(spark, sf_dir)).select("id")


@query(_KEY_NODES_SQL + " SELECT id, (SELECT count(*) FROM k WHERE dst = kn.id) AS dependents FROM kn", base=FK_SQL)
def key_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degrees(key_nodes(spark, sf_dir), key_edges(spark, sf_dir))


_SYMBOL_P_SQL = EVENT_SQL.rstrip() + ", p AS (SELECT DISTINCT from_symbol AS src, to_symbol AS dst FROM u)"


def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_usages(spark, sf_dir).select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst"))


@query(_CYCLES_SQL + ", n AS (SELECT src AS id FROM p UNION SELECT dst FROM p) SELECT n.id, coalesce(m.scc_id, n.id) AS scc_id FROM n LEFT JOIN m USING (id)", recursive=True, base=_SYMBOL_P_SQL)
def symbol_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(symbol_edges(spark, sf_dir))


@query(_WALK_SQL.replace("BIGINT", "VARCHAR") + " SELECT scc_id, array_to_string(path, ' ') AS path FROM paths", recursive=True, base=_SYMBOL_P_SQL)
def symbol_cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_paths(symbol_edges(spark, sf_dir)).select("scc_id", F.array_join("path", " ").alias("path"))


@query(f", r(origin, id, hop) USING KEY (origin, id) AS (SELECT id AS origin, id, 0 AS hop FROM (SELECT DISTINCT src AS id FROM p WHERE src LIKE '{_START.split('#')[0]}#%') UNION SELECT r.origin, p.dst, min(r.hop) + 1 FROM r JOIN p ON p.src = r.id"
       " WHERE NOT EXISTS (SELECT 1 FROM recurring.r z WHERE z.origin = r.origin AND z.id = p.dst) GROUP BY r.origin, p.dst) SELECT origin, id, hop::BIGINT AS hop FROM r WHERE id <> origin", recursive=True, base=_SYMBOL_P_SQL)  # fmt: skip
def symbol_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every symbol of one kind reaches, each by itself."""
    e = symbol_edges(spark, sf_dir)
    starts = e.select(F.col("src").alias("id")).filter(F.col("id").startswith(_START.split("#")[0] + "#"))
    return graph.reach(e, starts).select("origin", "id", "hop")
