"""Secret scans with multipart credential linking. Only DataFrame functions run here.

Base kinds are patterns that count by themselves. Weak kinds (long mixed tokens that may be secret keys; endpoints) are
reported only if a complementary part lies within `scope` code points: a token needs an access identifier, an endpoint
needs an access identifier or an assignment. The parts are linked by an interval join: each weak part goes to the bins
that its scope touches, each complement to the bins that it covers.

Places come from the lengths of matches and of the gaps between them, summed by a window over the document's parts, so a text
of many matches costs linear time. A pattern runs only where a search finds it.

Defined cases: a null or empty text has no spans; rows that repeat a doc_id are scanned each by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored, table, with_rid

#: Kind, pattern, least characters of the group with that number. The first three are the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("token", r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    ("endpoint", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 8),
]
BASE = 3
SCOPE = 400
#: For each weak kind, the kinds of which one must be near.
NEEDS = {"token": ["access"], "endpoint": ["access", "assign"]}
_PARTS = "array<struct<kind:int,at:int,gap:int,len:int,good:boolean>>"


def _matches(text: Column, k: int) -> Column:
    """Matches of a kind in order: the length of the gap before, and their own."""
    name, rx, group, least = KINDS[k]
    gaps, found = F.split(text, rx, -1), F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rx), F.lit(group))

    def part(m: Column, i: Column) -> Column:
        good = F.char_length(F.get(judged, i)) >= least
        if name == "token":  # upper case, lower case and digits together
            good = good & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
        return F.struct(F.lit(k).alias("kind"), i.alias("at"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("len"), good.alias("good"))

    return F.when(text.rlike(rx), F.transform(found, part)).otherwise(F.array().cast(_PARTS))


def parts(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, kind, start, end: a row for each good match, and one with null kind for each document."""
    text = F.coalesce("text", F.lit(""))
    rows = with_rid(docs.select("doc_id", "text")).select("_rid", "doc_id", F.concat(F.array(F.lit(None).cast(_PARTS[6:-1])), *[_matches(text, k) for k in range(len(KINDS))]).alias("_p"))
    rows = rows.select("_rid", "doc_id", F.explode_outer("_p").alias("_p")).select("_rid", "doc_id", "_p.*")
    so_far = Window.partitionBy("_rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    rows = rows.withColumn("end", end).filter(F.col("kind").isNull() | F.col("good"))
    return rows.select("_rid", "doc_id", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of `found` that have a complementary part within `scope` code points."""
    number = {name: k for k, (name, *_) in enumerate(KINDS)}
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    out = None
    for weak, needs in NEEDS.items():
        w = found.filter(F.col("kind") == number[weak]).withColumn("_bin", bins(F.col("start") - scope, F.col("end") + scope))
        c = found.filter(F.col("kind").isin([number[x] for x in needs])).select(F.col("_rid"), F.col("start").alias("_s"), F.col("end").alias("_e"), bins(F.col("start"), F.col("end")).alias("_bin"))
        near = w.join(c, (w["_rid"] == c["_rid"]) & (w["_bin"] == c["_bin"]) & (c["_s"] <= w["end"] + scope) & (c["_e"] >= w["start"] - scope), "left_semi").drop("_bin").distinct()
        out = near if out is None else out.unionByName(near)
    return out


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for each row of `docs`."""
    found = stored(parts(docs), "secret-parts")
    all_parts = found.filter(F.col("kind").isNull() | (F.col("kind") < BASE)).unionByName(linked(found, scope))
    name = F.get(F.array(*[F.lit(n) for n, *_ in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("said")))
    of = lambda k: F.sum((F.coalesce(F.col("kind"), F.lit(-1)) == k).cast("long"))
    docs_ = all_parts.groupBy("_rid").agg(F.first("doc_id").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sum((F.coalesce(F.col("kind"), F.lit(-1)) >= BASE).cast("long")).alias("n_linked"), F.array_sort(F.collect_list(span)).alias("_s"))
    said = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    base = said(F.filter("_s", lambda x: x["kind"] < BASE))
    return docs_.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(F.col("_s")).alias("spans"), "n_linked")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    kinds = []
    for k, (name, rx, group, least) in enumerate(KINDS):
        rx = rx.replace("'", "''")
        mixed = " AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[0-9]')" if name == "token" else ""
        kinds.append(f"""
SELECT doc_id, {k} AS kind, '{name}' AS name, (list_sum([len(x) FOR x IN g[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i-1]]), 0))::BIGINT AS s, len(m[i]) AS n
FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{rx}') AS g, regexp_extract_all(coalesce(text, ''), '{rx}', 0) AS m,
      regexp_extract_all(coalesce(text, ''), '{rx}', {group}) AS j FROM documents), unnest(range(1, len(m) + 1)) AS t(i)
WHERE len(j[i]) >= {least}{mixed}""")
    needs = " OR ".join(f"(w.name = '{w}' AND c.name IN ({', '.join(repr(x) for x in n)}))" for w, n in NEEDS.items())
    return f"""
WITH p AS ({" UNION ALL ".join(kinds)}),
r AS (SELECT * FROM p WHERE kind < {BASE} UNION ALL
      SELECT * FROM p w WHERE kind >= {BASE} AND EXISTS (SELECT 1 FROM p c WHERE c.doc_id = w.doc_id AND ({needs})
        AND c.s <= w.s + w.n + {SCOPE} AND c.s + c.n >= w.s - {SCOPE})),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      count(*) FILTER (kind >= {BASE}) AS n_linked, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans,
      string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM documents LEFT JOIN a USING (doc_id)
"""


ORACLE = _sql()
