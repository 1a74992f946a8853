"""Changes between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(
    rows: DataFrame, *, owner: Column, snapshot: Column, key: Column, version: Column, order: Column
) -> DataFrame:
    """Rows ``(snapshot_no, entity_id, change_kind)`` of what was added, removed or changed.

    A snapshot of an owner exists when it holds any row of that owner, and is compared with the
    owner's previous existing one; the first gives nothing. Of several rows of a key in one
    snapshot the one with the largest ``order`` counts (a null order is the smallest; among equal
    orders the largest version). The rows of both sides are taken from each other by EXCEPT ALL in both
    directions: one grouping counts each row's surplus on either side, so identical rows are gone
    before the full join by key. The table is read twice: its rows, and narrowly the numbers of each
    owner's snapshots. ``changed`` needs a non-null version on both sides. Rows with a null snapshot or key are left out; a null owner is an owner of its own.
    Other columns of the input are never looked at. An empty input gives an empty result.

    Hot keys are reduced by the map-side part of the aggregation; a hot owner is spread by the key.
    """
    latest = (
        rows.select(owner.alias("o"), snapshot.cast("int").alias("n"), key.alias("k"), order.alias("t"), version.alias("v"))
        .where("n is not null and k is not null")
        .groupBy("o", "n", "k")
        .agg(F.max(F.struct("t", "v"))["v"].alias("v"))
    )
    order_of = Window.partitionBy("so").orderBy("sn")
    steps = (
        rows.select(owner.alias("so"), snapshot.cast("int").alias("sn"), key.alias("sk"))
        .where("sn is not null and sk is not null")
        .groupBy("so", "sn").agg(F.count("*").alias("rows"))
        .select("so", "sn", F.lag("sn").over(order_of).alias("before"), F.lead("sn").over(order_of).alias("after"))
    )
    # Every row stands on the new side of its own step and on the old side of the next one.
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("before").isNotNull(), F.col("n")).alias("step"), F.lit(1).alias("side")),
            F.struct(F.col("after").alias("step"), F.lit(-1).alias("side")),
        ),
        lambda s: s["step"].isNotNull(),
    )
    placed = latest.join(steps, F.col("o").eqNullSafe(F.col("so")) & (F.col("n") == F.col("sn"))).select("o", "k", "v", F.inline(sides))
    residue = placed.groupBy("o", "step", "k", "v").agg(F.sum("side").alias("surplus")).where("surplus != 0")
    a = residue.where("surplus > 0").select(F.col("o").alias("ao"), F.col("step").alias("an"), F.col("k").alias("ak"), F.col("v").alias("av"), F.lit(1).alias("a"))
    b = residue.where("surplus < 0").select(F.col("o").alias("bo"), F.col("step").alias("bn"), F.col("k").alias("bk"), F.col("v").alias("bv"), F.lit(1).alias("b"))
    both = a.join(b, (F.col("an") == F.col("bn")) & (F.col("ak") == F.col("bk")) & F.col("ao").eqNullSafe(F.col("bo")), "full")
    kind = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("a").isNull(), "removed")
        .when(F.col("av").isNotNull() & F.col("bv").isNotNull() & (F.col("av") != F.col("bv")), "changed")
    )
    return both.select(
        F.coalesce("an", "bn").alias("snapshot_no"), F.coalesce("ak", "bk").alias("entity_id"), kind.alias("change_kind")
    ).where("change_kind is not null")
