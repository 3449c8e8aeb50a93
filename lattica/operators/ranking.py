"""Places in order within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.storage import stored


def placed(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """`df` with a long `name`: 0, 1, 2 ... within each `group` in order of `order`, and _size, the group's rows.

    Rows are dealt by ranges of (group, order), so a group lies in neighbouring slices, numbered each by itself; a table of the
    slices' counts gives the offsets.
    """
    own = Window.partitionBy(group, "_slice").orderBy(order)
    d = stored(df.repartitionByRange(group, order).withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.row_number().over(own).cast("long")), "placed")
    counts = d.groupBy(group, "_slice").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_size"))
    out = d.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
    return out.withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_group", "_of", "_slice", "_before", "_at")
