"""Code graphs derived from relational tables, so that the operators run, and can be checked, on any data.

P: parts are files, consecutive parts of an order are edges. FK: rows are nodes, foreign keys are edges. E: a user's consecutive events are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest_second(rows: DataFrame, name: str) -> F.Column:
    """Seconds from 1970 to the time `name` of `rows`, rounded with halves to even, as epoch(x)::BIGINT is. Times without a zone are read by their fields, whatever the session's zone is."""
    ts = F.col(name)
    if dict(rows.dtypes)[name] == "timestamp":
        return F.rint(F.unix_micros(ts) / 1e6).cast("long")
    whole = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.rint((whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")) / 1e6).cast("long")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind; repeats kept."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    e = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.when(F.col("l_returnflag") == "R", "reExport").when(F.col("l_returnflag") == "A", "require").otherwise("import").alias("kind"))
    return e.filter("dst is not null").select("src", "dst", "kind")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with virtual paths and counters; id is the scan order."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (k % len(FOLDERS)).cast("int") + 1)
    name = F.when(k % 11 == 0, F.concat(F.lit("p"), k, F.lit("/page"))).when(k % 13 == 0, F.concat(F.lit("p"), k, F.lit(".test"))).otherwise(F.concat(F.lit("p"), k))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), folder, F.lit("/"), name, F.lit(".tsx"))
    n = lambda c: c.cast("long")
    files = p.select(k.alias("id"), path.alias("path"), path.alias("rel_path"), n(size % 5).alias("import_count"), n(size % 3).alias("export_count"), n(size % 7).alias("function_count"), n(size % 2).alias("class_count"), n(size % 4).alias("component_count"), n(size).alias("complexity_total"), (size % 4 == 3).alias("has_component"), (size % 6 == 1).alias("has_class"))
    from lattica.functions.classify import is_entry_by_path

    return files.withColumn("is_entry_point", is_entry_by_path(F.col("rel_path")))


#: Directories that virtual files stand in.
FOLDERS = ["components", "services", "pages", "db", "config", "hooks", "app", "misc"]


def virtual_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, content: a source text for each part, whose statements are the part's edges."""
    said = F.when(F.col("kind") == "import", F.concat(F.lit('import { x } from "./p'), F.col("dst"), F.lit('";'))).when(F.col("kind") == "reExport", F.concat(F.lit('export { x } from "./p'), F.col("dst"), F.lit('";'))).otherwise(F.concat(F.lit('const y = require("./p'), F.col("dst"), F.lit('");')))
    text = part_edges(spark, sf_dir).select("src", said.alias("said")).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("said")), "\n").alias("content"))
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return ids.join(text.withColumnRenamed("src", "id"), "id", "left").select("id", F.concat(F.lit("/v/p"), F.col("id"), F.lit(".ts")).alias("path"), F.concat(F.lit("// file\n"), F.coalesce("content", F.lit(""))).alias("content"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: rows as "table:key", from the row that refers to the one referred to."""
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c))
    pairs = [("orders", "o_orderkey", "o", "c", "o_custkey"), ("customer", "c_custkey", "c", "n", "c_nationkey"), ("supplier", "s_suppkey", "s", "n", "s_nationkey"), ("nation", "n_nationkey", "n", "r", "n_regionkey"), ("lineitem", "l_orderkey", "o", "p", "l_partkey"), ("lineitem", "l_orderkey", "o", "s", "l_suppkey")]
    out = None
    for name, key, kind, to, ref in pairs:
        e = t(name).select(tag(kind, key).alias("src"), tag(to, ref).alias("dst"))
        out = e if out is None else out.unionAll(e)
    return out.distinct()


def key_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, is_entry_point (open orders) of all rows that key_edges links."""
    out = None
    for name, key, kind in (("orders", "o_orderkey", "o"), ("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s"), ("part", "p_partkey", "p"), ("nation", "n_nationkey", "n"), ("region", "r_regionkey", "r")):
        n = table(spark, sf_dir, name).select(F.concat(F.lit(kind + ":"), F.col(key)).alias("id"), (F.col("o_orderstatus") == "O" if kind == "o" else F.lit(False)).alias("is_entry_point"))
        out = n if out is None else out.unionAll(n)
    return out


def event_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_symbol, to_symbol, kind: a user's event after the one before; symbols are "type#user"."""
    ev = table(spark, sf_dir, "events")
    symbol = F.concat("event_type", F.lit("#"), F.col("user_id"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.lag(symbol).over(order).alias("from_symbol"), symbol.alias("to_symbol"), F.when(F.col("event_type") == "click", "calls").otherwise("renders").alias("kind")).filter("from_symbol is not null")


def key_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own, named and stars (as resolve.export_closure takes them) of a barrel for each key: customers export their orders, their segment and a default, and nations, then
    regions, pass on all that their members export, as regions do to their nations; suppliers export each line of an order by a name of its own."""
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    c, o, line, n = t("customer"), t("orders"), t("lineitem"), t("nation")
    own = o.select(tag("c", "o_custkey").alias("file"), tag("o", "o_orderkey").alias("name"), tag("so", "o_orderkey").alias("symbol"))
    own = own.unionAll(c.select(tag("c", "c_custkey"), "c_mktsegment", tag("sc", "c_custkey"))).unionAll(c.select(tag("c", "c_custkey"), F.lit("default"), tag("sd", "c_custkey")))
    own = own.unionAll(n.select(tag("n", "n_nationkey"), F.lit("BUILDING"), tag("sn", "n_nationkey"))).unionAll(n.select(tag("n", "n_nationkey"), "n_name", tag("sn", "n_nationkey")))
    of = o.select("o_orderkey", tag("c", "o_custkey").alias("from_file"))
    named = line.join(of, line["l_orderkey"] == of["o_orderkey"]).select(tag("s", "l_suppkey").alias("file"), F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("name"), "from_file", tag("o", "o_orderkey").alias("from_name"))
    stars = c.select(tag("n", "c_nationkey").alias("file"), tag("c", "c_custkey").alias("from_file"))
    stars = stars.unionAll(n.select(tag("r", "n_regionkey"), tag("n", "n_nationkey"))).unionAll(n.select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
    return own, named, stars


SQL = """
pe AS (SELECT src, dst, kind FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst,
         CASE l_returnflag WHEN 'R' THEN 'reExport' WHEN 'A' THEN 'require' ELSE 'import' END AS kind FROM lineitem) WHERE dst IS NOT NULL),
p AS (SELECT DISTINCT src, dst FROM pe),
f0 AS (SELECT p_partkey AS id, 'src/' || lower(replace(p_brand, '#', '')) || '/' || (['components', 'services', 'pages', 'db', 'config', 'hooks', 'app', 'misc'])[p_partkey % 8 + 1] || '/' ||
       CASE WHEN p_partkey % 11 = 0 THEN 'p' || p_partkey || '/page' WHEN p_partkey % 13 = 0 THEN 'p' || p_partkey || '.test' ELSE 'p' || p_partkey END || '.tsx' AS path,
       p_size % 5 AS import_count, p_size % 3 AS export_count, p_size % 7 AS function_count, p_size % 2 AS class_count, p_size % 4 AS component_count, p_size AS complexity_total,
       p_size % 4 = 3 AS has_component, p_size % 6 = 1 AS has_class FROM part),
f1 AS (SELECT *, contains(path, '/pages/') OR (contains(path, '/app/') AND parse_filename(path) = 'page.tsx') AS is_route, split_part(path, '/', 2) AS module FROM f0),
f AS (SELECT *, is_route OR regexp_matches(path, '\\.(test|spec)\\.(js|jsx|ts|tsx)$') AS is_entry_point FROM f1)
"""
FK_SQL = """
k AS (SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders UNION SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
      UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
      UNION SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem UNION SELECT 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem)
"""
EVENT_SQL = """
u AS (SELECT * FROM (SELECT lag(event_type || '#' || user_id) OVER w AS from_symbol, event_type || '#' || user_id AS to_symbol,
      CASE WHEN event_type = 'click' THEN 'calls' ELSE 'renders' END AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_symbol IS NOT NULL)
"""
EXPORT_SQL = """
own AS (SELECT 'c' || o_custkey AS file, 'o' || o_orderkey AS name, 'so' || o_orderkey AS symbol FROM orders UNION SELECT 'c' || c_custkey, c_mktsegment, 'sc' || c_custkey FROM customer
        UNION SELECT 'c' || c_custkey, 'default', 'sd' || c_custkey FROM customer UNION SELECT 'n' || n_nationkey, 'BUILDING', 'sn' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey, n_name, 'sn' || n_nationkey FROM nation),
named AS (SELECT DISTINCT 's' || l_suppkey AS file, 'l' || l_orderkey || '_' || l_linenumber AS name, 'c' || o_custkey AS from_file, 'o' || o_orderkey AS from_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stars AS (SELECT DISTINCT 'n' || c_nationkey AS file, 'c' || c_custkey AS from_file FROM customer UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
hidden AS (SELECT file, name FROM own UNION SELECT file, name FROM named)
"""
