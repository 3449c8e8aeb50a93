"""Gapless numbers within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of each group; a slice is what one task sorts.
SLICES = 1024


def ranked(df: DataFrame, group: list[str], slice_by: Column, order: list[Column], name: str, slices: int = SLICES) -> DataFrame:
    """`df` with a long `name`: 0, 1, 2 ... within each `group`. Rows go to slices by the hash of `slice_by`, are
    numbered there in `order`, and a table of the slices' counts (groups x slices rows) gives the offsets. `df` is read
    twice, so it should be a stored table."""
    d = df.withColumn("_slice", F.pmod(F.xxhash64(slice_by), F.lit(slices)).cast("int"))
    counts = d.groupBy(*group, "_slice").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = d.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)))
    return own.join(offsets, [*group, "_slice"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_slice", "_before", "_at")
