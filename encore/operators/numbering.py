"""Positions of the rows of a frame of any size in a given order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.sources import fs

_BITS = 33  # a row's place in its partition, in the number that Spark gives it


def numbered(df: DataFrame, order: list[Column], out_col: str = "position") -> DataFrame:
    """``df`` with every row's position from 1 in ``order`` (ties in any order). Rows are dealt to tasks by
    ranges of the order and sorted there; a row's position is its place in its range and the sizes of
    the ranges before, from a table with one row per range. The sorted rows are written once to the shared
    folder, so that ranges and places are the same for both uses."""
    spark = df.sparkSession
    path = fs.temporary(spark, "numbered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    part = F.shiftright("_n", _BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))  # one row per range
    rows = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_n").bitwiseAND(F.lit((1 << _BITS) - 1))
    return rows.withColumn(out_col, F.col("_before") + place + 1).select(*df.columns, out_col)
