"""References to records that are missing, deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_groups(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per ``(parent_table, scope, ref)`` that some child names and that fails to hold for
    at least one of them: no parent at all, a parent first seen after the earliest child, or a
    parent gone by the latest child.

    ``children``: parent_table, scope, ref, at (when the reference was made).
    ``parents``: parent_table, scope, ref, since, until (null: never ends).
    Both are tagged and laid out in long form, then grouped once; the map-side half of the
    aggregation folds a hot key before anything is shuffled. A null ``scope`` is a scope of its
    own; children with a null ``ref`` are no reference.
    """
    none = F.lit(None).cast("timestamp")
    long = children.where("ref is not null").select(
        "parent_table", "scope", "ref", F.lit(0).alias("is_parent"), F.lit(1).cast("bigint").alias("n"), "at", none.alias("since"), none.alias("until")
    ).unionByName(
        parents.where("ref is not null").select(
            "parent_table", "scope", "ref", F.lit(1).alias("is_parent"), F.lit(0).cast("bigint").alias("n"), none.alias("at"), "since", "until"
        )
    )
    return (
        long.groupBy("parent_table", "scope", "ref")
        .agg(
            F.max("is_parent").alias("has_parent"), F.sum("n").alias("n_refs"), F.min("at").alias("first_at"),
            F.max("at").alias("last_at"), F.min("since").alias("since"), F.max("until").alias("until"),
        )
        .where("n_refs > 0 and (has_parent = 0 or since > first_at or until <= last_at)")
    )


def broken_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` that do not hold, with ``reason``: ``missing``, ``late`` or ``deleted``.

    ``late``: the parent's first appearance is after the reference; ``deleted``: its end is not
    after the reference; a reference that is both gives two rows. Other columns of the children are
    kept, but for one named ``reason``. References without a time are
    only tested for existence. Only the failing groups, a small part of the keys, are joined back
    to the children; adaptive execution splits a hot key on the children's side.
    """
    own = children.columns
    groups = reference_groups(children, parents)
    bad = groups.select(*(F.col(c).alias(f"__{c}") for c in ("parent_table", "scope", "ref", "has_parent", "since", "until")))
    hit = children.join(
        bad, (F.col("parent_table") == F.col("__parent_table")) & F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("ref") == F.col("__ref"))
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("__has_parent") == 0, "missing"),
            F.when(F.col("__since") > F.col("at"), "late"),
            F.when(F.col("__until") <= F.col("at"), "deleted"),
        )
    )
    return hit.select(*(c for c in own if c != "reason"), F.explode(reasons).alias("reason"))
