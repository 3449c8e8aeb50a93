"""Analyses of a code graph: files (id, path, rel_path, counters, is_entry_point) and edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import classify
from lattica.operators import graph
from lattica.operators.ranking import placed
from lattica.storage import once

TOP_HOTSPOTS, TOP_COUPLED, TOP_FOUND = 10, 3, 8
#: Fixed values of the health score.
CYCLE_PENALTY, COUPLING_PENALTY, ORPHAN_PENALTY, COMPLEXITY_LIMIT, COMPLEXITY_PENALTY = 15, 5, 4, 10, 5


def locale(c: Column) -> Column:
    """Sorts as people do rather than by bytes."""
    return F.collate(c, "UNICODE")


def hotspots(files: DataFrame, edges: DataFrame, top: int = TOP_HOTSPOTS) -> DataFrame:
    """id, path, dependents of the files that most files point at; ties by path."""
    n = graph.in_degrees(files, edges).filter("dependents > 0")
    return n.join(files.select("id", "path"), "id").orderBy(F.desc("dependents"), locale(F.col("path"))).limit(top).select("id", "path", "dependents")


def summary(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, with the numbers of cycles and orphans."""
    edges = once(edges, "edges")
    return totals(files, edges, graph.cycles(edges))


def totals(files: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """summary(), with the cycles given."""
    n = files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("components", "component_count"), ("functions", "function_count"), ("classes", "class_count"), ("imports", "import_count"), ("exports", "export_count"), ("complexity", "complexity_total"))])
    cyc = cycles.agg(F.countDistinct("scc_id").alias("circular_deps"))
    orp = graph.orphans(files, edges).agg(F.count("*").alias("orphan_files"))
    return n.crossJoin(cyc).crossJoin(orp)  # single rows


def module_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """module, file_count, dependency_count, ca, ce, coupling, complexity_average."""
    f = files.withColumn("module", classify.module_name(F.col("rel_path")))
    m = f.select("id", "module")
    pairs = graph.distinct_edges(edges).join(m.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst").filter("a <> b")
    ends = pairs.select(F.col("a").alias("module"), F.lit(0).alias("ca"), F.lit(1).alias("ce")).unionAll(pairs.select(F.col("b").alias("module"), F.lit(1).alias("ca"), F.lit(0).alias("ce")))
    cross = ends.groupBy("module").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    own = f.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("import_count").cast("long").alias("dependency_count"), F.sum("complexity_total").alias("_complexity"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return own.join(cross, "module", "left").select("module", "file_count", "dependency_count", zero(F.col("ca")).alias("ca"), zero(F.col("ce")).alias("ce"), (zero(F.col("ca")) + zero(F.col("ce"))).alias("coupling"), (F.col("_complexity") / F.col("file_count")).alias("complexity_average"))


def mean_coupling(modules: DataFrame) -> DataFrame:
    return modules.agg(F.coalesce(F.avg("coupling"), F.lit(0.0)).alias("mean_coupling"))


def high_coupling(modules: DataFrame) -> DataFrame:
    """Modules with a coupling above 0 that isn't below the mean."""
    return modules.crossJoin(mean_coupling(modules)).filter("coupling > 0 and coupling >= mean_coupling")


def top_coupled(modules: DataFrame, top: int = TOP_COUPLED) -> DataFrame:
    return modules.filter("coupling > 0").orderBy(F.desc("coupling"), locale(F.col("module"))).limit(top)


def risky(files: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """high_coupling: whether any target (id) lies in a module of high coupling."""
    hot = high_coupling(module_metrics(files, edges)).select("module", F.lit(True).alias("_hot"))
    t = files.join(targets.select("id"), "id", "left_semi").withColumn("module", classify.module_name(F.col("rel_path")))
    return t.join(hot, "module", "left").agg(F.coalesce(F.bool_or(F.coalesce("_hot", F.lit(False))), F.lit(False)).alias("high_coupling"))


def classified(files: DataFrame) -> DataFrame:
    """`files` with module, is_route, file_kind and layer; has_component and has_class tell of their symbols."""
    kind = classify.file_kind(F.col("path"), F.col("is_entry_point"), F.col("has_component"), F.col("has_class"))
    f = files.withColumn("module", classify.module_name(F.col("rel_path"))).withColumn("is_route", classify.is_route(F.col("rel_path"))).withColumn("file_kind", kind)
    return f.withColumn("layer", classify.layer(F.col("path"), F.col("file_kind")))


def layer_sizes(files: DataFrame) -> DataFrame:
    """layer, files, ord (fixed order) of the layers that have files; `files` has `layer`."""
    order = F.array_position(F.array(*[F.lit(x) for x in classify.LAYER_ORDER]), F.col("layer"))
    return files.groupBy("layer").agg(F.count("*").alias("files")).withColumn("ord", order.cast("long"))


def layer_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """from_layer, to_layer, edges (rows, repeats counted) between different layers, with an arrow's width and span."""
    f = files.select("id", "layer")
    e = edges.join(f.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src").join(f.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst").filter("from_layer <> to_layer")
    order = F.array(*[F.lit(x) for x in classify.LAYER_ORDER])
    at = lambda c: F.array_position(order, F.col(c))
    return e.groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges")).withColumn("width", F.least(F.lit(5.0), 1.5 + F.log2(F.col("edges") + 1))).withColumn("span", F.abs(at("from_layer") - at("to_layer")).cast("long"))


def layer_grid(files: DataFrame, per_row: int = 5) -> DataFrame:
    """id, layer, col, row: places in a grid of each layer, in order of id."""
    d = placed(files.select("id", "layer"), "layer", "id", "_i")
    return d.select("id", "layer", (F.col("_i") % per_row).cast("long").alias("col"), F.floor(F.col("_i") / per_row).alias("row"))


def health(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity, dependency_health, complexity, overall, and what went into them."""
    edges = once(edges, "edges")
    n = files.agg(F.coalesce(F.sum("function_count"), F.lit(0)).alias("functions"), F.coalesce(F.sum("complexity_total"), F.lit(0)).alias("total"))
    cyc = graph.cycles(edges).agg(F.countDistinct("scc_id").alias("cycles"))
    orp = graph.orphans(files, edges).agg(F.count("*").alias("orphans"))
    hot = high_coupling(module_metrics(files, edges)).agg(F.count("*").alias("coupled_modules"))
    row = n.crossJoin(cyc).crossJoin(orp).crossJoin(hot)  # single rows
    avg = F.when(F.col("functions") > 0, F.col("total") / F.col("functions")).otherwise(0.0)
    row = row.withColumn("average_complexity", avg)
    row = row.withColumn("modularity", classify.clamp_score(100 - F.col("cycles") * CYCLE_PENALTY - F.col("coupled_modules") * COUPLING_PENALTY))
    row = row.withColumn("dependency_health", classify.clamp_score(100 - F.col("orphans") * ORPHAN_PENALTY))
    over = (F.col("average_complexity") - COMPLEXITY_LIMIT) * COMPLEXITY_PENALTY
    row = row.withColumn("complexity", F.when(F.col("average_complexity") > COMPLEXITY_LIMIT, classify.clamp_score(100 - over)).otherwise(F.lit(100).cast("long")))
    row = row.withColumn("overall", classify.clamp_score((F.col("modularity") + F.col("dependency_health") + F.col("complexity")) / 3))
    return row.withColumn("band", classify.score_band(F.col("overall"))).drop("total")


def health_reasons(files: DataFrame, edges: DataFrame, score: DataFrame, root: str = "") -> DataFrame:
    """score, ord, penalty, reason: what each of the three scores of health() lost points for, or that there was nothing; never empty."""
    edges = once(edges, "edges")
    name = lambda c: classify.relative(c, root)
    steps = graph.cycle_paths(edges, order="ord" if "ord" in edges.columns else "dst").select("scc_id", F.posexplode("path").alias("at", "id")).join(files.select("id", name(F.col("path")).alias("n")), "id")
    ring = steps.groupBy("scc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("ns"))  # of one path
    said = lambda a, b, c: F.concat(F.lit(f"-{a}: {b}"), c)
    cyc = ring.select(F.lit("modularity").alias("score"), F.lpad(F.col("scc_id").cast("string"), 20, "0").alias("key"), F.lit(1).alias("kind"), F.lit(CYCLE_PENALTY).alias("penalty"), said(CYCLE_PENALTY, "cycle ", F.array_join(F.concat("ns", F.slice("ns", 1, 1)), " → ")).alias("reason"))
    hot = high_coupling(module_metrics(files, edges))
    hot = hot.select(F.lit("modularity"), "module", F.lit(2), F.lit(COUPLING_PENALTY), said(COUPLING_PENALTY, "coupling of module ", F.concat("module", F.lit(" is "), F.col("coupling"), F.lit(", not below the mean"))))
    orp = graph.orphans(files, edges).select(F.lit("dependency_health"), F.col("path"), F.lit(1), F.lit(ORPHAN_PENALTY), said(ORPHAN_PENALTY, "nothing uses ", name(F.col("path"))))
    mean = F.format_number("average_complexity", 1)
    over = F.floor((F.col("average_complexity") - COMPLEXITY_LIMIT) * COMPLEXITY_PENALTY + 0.5).cast("int")
    cpx = score.select(
        F.lit("complexity"), F.lit(""), F.lit(1), F.when((F.col("functions") > 0) & (F.col("average_complexity") > COMPLEXITY_LIMIT), over).otherwise(0),
        F.when(F.col("functions") == 0, "no functions to measure")
        .when(F.col("average_complexity") > COMPLEXITY_LIMIT, F.concat(F.lit("-"), over, F.lit(": mean complexity "), mean, F.lit(f" is above {COMPLEXITY_LIMIT}")))
        .otherwise(F.concat(F.lit("mean complexity "), mean, F.lit(f" is within {COMPLEXITY_LIMIT}"))),
    )
    none = score.select(F.explode(F.array(F.struct(F.lit("modularity").alias("score"), F.lit("no cycles and no modules of high coupling").alias("reason")), F.struct(F.lit("dependency_health").alias("score"), F.lit("no orphan files").alias("reason")))).alias("x")).select("x.score", F.lit("").alias("key"), F.lit(0).alias("kind"), F.lit(0).alias("penalty"), "x.reason")
    lost = once(cyc.unionAll(hot).unionAll(orp).unionAll(cpx), "reasons")
    return lost.unionByName(none.join(lost, "score", "left_anti")).select("score", "kind", "key", "penalty", "reason")


def highlight(report: dict) -> dict:
    """label, targets, impacted, routes: what a drawing of the graph marks, for the report of one file's impact or of all changes'."""
    one = "target" in report
    return {"label": "BLAST RADIUS" if one else "DIFF IMPACT", "targets": [report["target"]] if one else report["changed"], "impacted": report["files"], "routes": report["routes"]}


def attention(files: DataFrame, edges: DataFrame) -> DataFrame:
    """section (1 cycles, 2 orphans, 3 coupled modules), item, value: what needs a look."""
    edges = once(edges, "edges")
    c = graph.cycles(edges).groupBy("scc_id").agg(F.count("*").alias("value")).select(F.lit(1).alias("section"), F.col("scc_id").cast("string").alias("item"), "value")
    o = graph.orphans(files, edges).select(F.lit(2).alias("section"), F.col("path").alias("item"), F.lit(0).cast("long").alias("value"))
    m = top_coupled(module_metrics(files, edges)).select(F.lit(3).alias("section"), F.col("module").alias("item"), F.col("coupling").alias("value"))
    return c.unionAll(o).unionAll(m)


def find_symbols(symbols: DataFrame, asked: str) -> DataFrame:
    """Symbols whose name holds `asked`, whatever the case; % and _ stand for themselves."""
    return symbols.filter(F.lower("name").contains(asked.lower()))


def palette(files: DataFrame, symbols: DataFrame, asked: str, top: int = TOP_FOUND) -> DataFrame:
    """kind, id, label: the first files and symbols that hold `asked`, in order of id; a blank one is in all."""
    q = asked.strip().lower()
    f = files.filter(F.lower("rel_path").contains(q)).orderBy("id").limit(top).select(F.lit("file").alias("kind"), "id", F.col("rel_path").alias("label"))
    s = symbols.filter(F.lower("name").contains(q)).orderBy("id").limit(top).select(F.lit("symbol").alias("kind"), "id", F.col("name").alias("label"))
    return f.unionAll(s)


def file_tree(files: DataFrame) -> DataFrame:
    """path, parent, name, is_dir, depth for each directory and file, once."""
    parts = F.filter(F.split("rel_path", "/"), lambda x: x != "")
    steps = files.select(parts.alias("p")).filter(F.size("p") > 0).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    join = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    return steps.select(join(F.col("n")).alias("path"), join(F.col("n") - 1).alias("parent"), F.get("p", F.col("n") - 1).alias("name"), (F.col("n") < F.size("p")).alias("is_dir"), (F.col("n") - 1).cast("long").alias("depth")).distinct()


def direct(files: DataFrame, edges: DataFrame, target: Column) -> DataFrame:
    """direction ("dependsOn" or "dependents"), id: the target's neighbours."""
    on = edges.filter(F.col("src") == target).select(F.lit("dependsOn").alias("direction"), F.col("dst").alias("id"))
    by = edges.filter(F.col("dst") == target).select(F.lit("dependents").alias("direction"), F.col("src").alias("id"))
    return on.unionAll(by).distinct()


def impact(files: DataFrame, edges: DataFrame, targets: DataFrame, small: int = graph.SMALL, ranked: bool = False) -> DataFrame:
    """origin, id, hop, rank, is_route: what depends on each target, however far."""
    back = graph.reach(graph.reverse(edges, files), targets, small=small, ranked=ranked)
    return back.join(files.select("id", classify.is_route(F.col("rel_path")).alias("is_route")), "id").select("origin", "id", "hop", "rank", "is_route")


def diff_impact(files: DataFrame, edges: DataFrame, changed: DataFrame, small: int = graph.SMALL) -> DataFrame:
    """origin, id, is_route: as impact(), without the changed files themselves; unknown ones are dropped."""
    known = changed.select("id").distinct().join(files.select("id"), "id", "left_semi")
    return impact(files, edges, known, small).join(known, "id", "left_anti").select("origin", "id", "is_route")


def diff_counts(files: DataFrame, edges: DataFrame, changed: DataFrame, small: int = graph.SMALL) -> DataFrame:
    """id, impacted_count for each changed file that is known."""
    known = changed.select("id").distinct().join(files.select("id"), "id", "left_semi")
    n = diff_impact(files, edges, changed, small).groupBy(F.col("origin").alias("id")).agg(F.count("*").alias("n"))
    return known.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("impacted_count"))


def hop_distances(edges: DataFrame, nodes: DataFrame, targets: DataFrame, small: int = graph.SMALL) -> DataFrame:
    """id, hop: distance to the nearest target against the edges; targets have 0."""
    return graph.reach(graph.reverse(edges, nodes), targets, together=True, small=small).select("id", "hop")


def hop_rings(distances: DataFrame, members: DataFrame) -> DataFrame:
    """hop, files: how many members lie in each ring; those without a distance count in the first."""
    return members.select("id").join(distances, "id", "left").groupBy(F.coalesce("hop", F.lit(1)).cast("long").alias("hop")).agg(F.count("*").alias("files"))


def neighbourhood(symbols: DataFrame, usages: DataFrame, file_id: Column) -> DataFrame:
    """Usages (from_symbol, to_symbol) that touch a file's symbols on either side."""
    own = symbols.filter(F.col("file_id") == file_id).select(F.col("symbol_id").alias("_s"))
    a = usages.join(own, F.col("from_symbol") == F.col("_s"), "left_semi")
    b = usages.join(own, F.col("to_symbol") == F.col("_s"), "left_semi")
    return a.union(b).distinct()


def complex_files(files: DataFrame, limit: int = COMPLEXITY_LIMIT) -> DataFrame:
    """Files whose total complexity is above the limit."""
    return files.filter(F.col("complexity_total") > limit)


def highlighted(files: DataFrame, asked: str) -> DataFrame:
    """id, matches: whether a file's relative path holds `asked`; a blank one marks nothing."""
    q = asked.strip().lower()
    return files.select("id", (F.lower("rel_path").contains(q) if q else F.lit(False)).alias("matches"))


def in_cycle_path(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that lie on one of the cycles' paths, which may be fewer than their components' members."""
    on = graph.cycle_paths(edges).select(F.explode("path").alias("id")).distinct()
    return files.join(on, "id", "left_semi")


def ring_places(distances: DataFrame, radius: int = 90) -> DataFrame:
    """id, x, y: on a ring for each hop, at even angles in order of id."""
    d = placed(distances.select("id", "hop"), "hop", "id", "_i")
    angle = 2 * F.pi() * F.col("_i") / F.col("_size")
    return d.select("id", (F.col("hop") * radius * F.cos(angle)).alias("x"), (F.col("hop") * radius * F.sin(angle)).alias("y"))


def nodes_drawn(files: DataFrame, edges: DataFrame) -> DataFrame:
    """id, size: grows with the edges that come in."""
    return graph.edge_counts(files, edges).select("id", classify.node_size(F.col("incoming")).cast("long").alias("size"))


def overview(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, with the number of edge rows and of entry points."""
    edges = once(edges, "edges")
    n = edges.agg(F.count("*").alias("edges"))
    e = files.agg(F.count_if("is_entry_point").alias("entry_points"))
    return summary(files, edges).crossJoin(n).crossJoin(e)  # single rows
