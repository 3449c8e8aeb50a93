"""Helpers that the training-data operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.storage import released, remove_stored, shared_dir, stored

__all__ = ["BETWEEN", "UPPER", "ascii_lower", "hex_digits", "others", "packed", "released", "remove_stored", "shared_dir", "stored", "table", "unpacked", "with_rid", "without", "word_array"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words of digits, ASCII letters and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does that for ASCII texts and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def word_array(c: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null. split() takes a seventh of regexp_extract_all()'s time."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(c), F.lit("")), BETWEEN), "")


def repeatable(df: DataFrame) -> DataFrame:
    """`df` if it only scans, projects and filters, so that its rows stand in the same partitions whenever it is read;
    else stored. Shuffles may be dealt differently each time, and with them the ids of rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(\w+)", line))}
    return df if nodes <= {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Range"} else stored(df, "rows")


def with_rid(df: DataFrame) -> DataFrame:
    """Adds `_rid`, an id of the row: doc_id may be null or repeated."""
    return repeatable(df).withColumn("_rid", F.monotonically_increasing_id())


def packed(df: DataFrame) -> DataFrame:
    """_rid, _row (all columns of a row), doc_id and text: whatever else a row holds can't clash with names used here."""
    return with_rid(df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))).select("_rid", "_row", "_row.doc_id", "_row.text")


def others(grouped: DataFrame) -> DataFrame:
    """_rid of the rows (_rid, doc_id, _group) that aren't the first of their group by doc_id, nulls last, then by _rid."""
    first = grouped.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("_first"))
    return grouped.select("_rid").join(first.select("_first._rid"), "_rid", "left_anti")


def without(rid: DataFrame, gone: DataFrame) -> DataFrame:
    """`rid` (as from packed) but for the rows `gone` (_rid). These are written first, so that few of them are broadcast and the texts stay where they are."""
    return rid.select("_rid", "_row").join(stored(gone, "gone"), "_rid", "left_anti")


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The `columns` of `_row` again, with `text` replaced if it is given."""
    return df.select(*[text.alias(c) if c == "text" and text is not None else F.col("_row").getField(c).alias(c) for c in columns])


def hex_digits(c: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


