"""Row numbers over everything, or within groups of any size, without a task that sorts a whole group.

Rows are sorted into range partitions by group and order; a row's number is its place in its partition plus the group's rows in the
partitions before. A group that holds a third of all rows spans many partitions, small groups share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the row number (from 1) in ``order`` within the groups ``by``; with no groups, over all rows.

    The sorted partitions are written once and both uses read them, so that their bounds are the same. Rows equal in group and
    order are numbered in any order; NULL is a group of its own. An empty table stays empty.
    """
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    parts = materialise(parts, "ranked")
    sizes = parts.groupBy(*by, "_pid").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))  # a row per group and partition it lies in
    upto = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_pid").alias("_part"), "_first", "_before")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_pid") == F.col("_part"))
    out = parts.join(before if by else F.broadcast(before), same)  # without groups one row per partition
    return out.withColumn(name, F.col("_before") + F.col("_mono") - F.col("_first") + 1).select(*df.columns, name)
