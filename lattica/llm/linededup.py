"""Line dedup by shared runs of lines.

A rolling hash over the hashes of two lines is taken at each line. Where it occurs more than once in the corpus, the two lines are a repeat, and a chunk
is a run of lines whose rolling hashes are all repeats: its boundaries are chosen by the content, so what surrounds a passage can't shift
them. (Chunks between boundaries set by single hashes, at some mean length, leave short passages in, as these seldom hold a whole chunk; README has figures.)
A line of LONG words or more is a repeat by itself. All occurrences of a repeat but the first (smallest doc_id, then place) are removed, after a
comparison of their bytes with it, each line once. Pairs of blank lines are no repeats; blank lines between removed ones go with them. Of two
overlapping occurrences in one text (three equal lines), the first keeps its lines.

Every removed line stands in an earlier occurrence of its pair, and is kept there or removed for one earlier still; so each line of the corpus is
left somewhere.

Only hashes are shuffled to find repeats; the bytes of repeats meet those of the first occurrence in a join in which the first
occurrence is one row, so a passage that a third of all documents share is split like any skewed join.

Defined cases: a null text stays null, an empty one empty; a text whose lines all go becomes empty; rows that repeat a doc_id are distinct documents, the
row read first coming first; an empty table gives an empty result; `dedup` keeps other columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import packed, stored, table, unpacked

LONG = 50


def chunks(text: str, long: int = LONG) -> list[tuple[list[str], bool]]:
    """(lines, whether they may be removed by themselves) in order, line by line; the lines joined by line feeds give the text again."""
    return [([x], len(x.split()) >= long) for x in text.split("\n")]


def _bytes(lines: list[str]) -> bytes:
    return "\n".join(lines).encode("utf-8", "surrogatepass")


def repeatable(text: str) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of what may be removed: long lines, and pairs of lines that aren't both blank."""
    own = [(_bytes(lines), alone, bool(lines[0].strip())) for lines, alone in chunks(text)]
    out = [(i, 1, x) for i, (x, alone, _) in enumerate(own) if alone]
    return out + [(i, 2, x + b"\n" + y) for i, ((x, _, some), (y, _, more)) in enumerate(zip(own, own[1:], strict=False)) if some or more]


@F.arrow_udf(T.ArrayType(T.StructType().add("at", T.IntegerType()).add("key", T.LongType())))
def _keys(texts: pa.Array) -> pa.Array:
    """The hash of each repeatable, by its size, and its place: twice the line, and one more for two lines."""
    import xxhash

    rows = []
    for t in texts:
        found = repeatable(t.as_py()) if t.is_valid else ()
        rows.append([{"at": 2 * i + n - 1, "key": xxhash.xxh64_intdigest(x, n) - (1 << 63)} for i, n, x in found])
    return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64())])))


@F.arrow_udf(T.ArrayType(T.StructType().add("key", T.LongType()).add("nth", T.IntegerType()).add("line", T.IntegerType()).add("head", T.BooleanType()).add("body", T.BinaryType())))
def _bodies(texts: pa.Array, occurrences: pa.Array) -> pa.Array:
    """The lines of first occurrences, and each line that may go, once, by one of the repeats that it stands in."""
    rows = []
    for t, found in zip(texts, occurrences, strict=True):
        own, may_go, out = t.as_py().split("\n"), {}, []
        for o in found.as_py():
            first, size = o["at"] // 2, 1 + o["at"] % 2
            for nth in range(0 if o["head"] else int(o["laps"]), size):
                line = {"key": o["key"], "nth": nth, "line": first + nth, "head": o["head"], "body": _bytes(own[first + nth : first + nth + 1])}
                if o["head"]:
                    out.append(line)
                else:
                    may_go.setdefault(line["line"], line)
        rows.append(out + list(may_go.values()))
    return pa.array(rows, pa.list_(pa.struct([("key", pa.int64()), ("nth", pa.int32()), ("line", pa.int32()), ("head", pa.bool_()), ("body", pa.binary())])))


def removed(lines: list[str], gone: list[int]) -> list[bool]:
    """Which lines go: those numbered in `gone`, and blank ones between two of them."""
    drop = [False] * len(lines)
    for i in gone:
        drop[i] = True
    last = None
    for i, x in enumerate(lines):
        if drop[i]:
            if last is not None:
                drop[last + 1 : i] = [True] * (i - last - 1)
            last = i
        elif x.strip():
            last = None
    return drop


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("lines", T.LongType()).add("removed_lines", T.LongType()).add("removed_chunks", T.LongType()))
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    rows = []
    for t, g in zip(texts, gone, strict=True):
        if not t.is_valid:
            rows.append({"text": None, "lines": 0, "removed_lines": 0, "removed_chunks": 0})
            continue
        text = t.as_py()
        own = text.split("\n")
        drop = removed(own, g.as_py() or [])
        kept = [x for x, d in zip(own, drop, strict=True) if not d]
        runs = sum(d and not before for d, before in zip(drop, [False, *drop], strict=False))
        rows.append({"text": "\n".join(kept), "lines": len(own), "removed_lines": len(own) - len(kept), "removed_chunks": runs})
    return pa.array(rows, pa.struct([("text", pa.string()), ("lines", pa.int64()), ("removed_lines", pa.int64()), ("removed_chunks", pa.int64())]))


def repeats(rid: DataFrame) -> DataFrame:
    """_rid, _gone (numbers of the lines to remove) for rows (_rid, doc_id, text) that lose any."""
    found = rid.select("_rid", "doc_id", F.explode(_keys("text")).alias("_k")).select("_rid", "doc_id", "_k.at", "_k.key")
    found = stored(found, "line-pairs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "_rid", "at")).alias("_first")
    shared = found.groupBy("key").agg(F.count("*").alias("_c"), first).filter("_c > 1").select("key", F.col("_first._rid").alias("_r"), F.col("_first.at").alias("_a"))
    head = (F.col("_rid") == F.col("_r")) & (F.col("at") == F.col("_a"))
    # An occurrence that begins on the second line of the first one leaves that line.
    laps = (F.col("_rid") == F.col("_r")) & (F.col("at") % 2 == 1) & (F.col("at") == F.col("_a") + 2)
    again = found.select("_rid", "at", "key").join(shared, "key").select("_rid", F.struct("at", "key", head.alias("head"), laps.alias("laps")).alias("_c"))
    per = again.groupBy("_rid").agg(F.collect_list("_c").alias("_c"))  # of one document
    # Both joins of texts are merged at every size: what a small table would broadcast, a large one couldn't.
    bodies = rid.select("_rid", "text").join(per.hint("merge"), "_rid").select("_rid", F.explode(_bodies("text", "_c")).alias("_z")).select("_rid", "_z.*")
    bodies = stored(bodies, "line-bodies")
    heads = bodies.filter("head").select("key", "nth", F.col("body").alias("_head"))
    same = bodies.filter("not head").join(heads, ["key", "nth"]).filter("body = _head")
    return same.groupBy("_rid").agg(F.collect_list("line").alias("_gone"))  # of one document


def _applied(rid: DataFrame) -> DataFrame:
    """_rid, _row (as from packed), _new: the text that is left, and counts."""
    gone = stored(repeats(rid.select("_rid", "doc_id", "text")), "line-gone")
    return rid.select("_rid", "_row").join(gone.hint("merge"), "_rid", "left").withColumn("_new", _without("_row.text", "_gone"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, lines, removed_lines, removed_chunks (runs of lines), text_crc32 (of the text that is left) for each row of `docs`."""
    out = _applied(packed(docs.select("doc_id", "text")))
    return out.select("_row.doc_id", "_new.lines", "_new.removed_lines", "_new.removed_chunks", F.crc32(F.coalesce("_new.text", F.lit(""))).alias("text_crc32"))


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated runs of lines cut out of `text`."""
    return unpacked(_applied(packed(docs)), docs.columns, F.col("_new.text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
