"""Numbers within groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.tables import Scratch


def numbered(rows: DataFrame, group: list[str], order: list[str], into: str, scratch: Scratch | None, name: str = "numbered") -> DataFrame:
    """``rows`` with ``into``: their numbers from 1 within ``group`` by ``order``, as bigint.

    Rows are sorted over the cluster by group and order and written once; each partition then counts
    its rows of each group, and only those counts are summed along the partitions. So a group that
    holds a third of all rows is numbered in as many tasks as its share. Null keys are a group.
    Rows of equal order are numbered in some order, so ``order`` should tell them apart. Without
    ``scratch`` each group is numbered by one window, for groups that are known to be small.
    """
    if scratch is None:
        return rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    placed = scratch.save(placed, name)
    runs = placed.groupBy(*group, "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_p").alias("_rp"), "_first", before.alias("_before"))
    same = F.col("_p") == F.col("_rp")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(runs, same).select(*rows.columns, (F.col("_before") + F.col("_m") - F.col("_first") + 1).alias(into))
