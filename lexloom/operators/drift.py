"""What changed between two captures of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capture(sections: DataFrame, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``(*within, section_id, hash)``; of rows with one id the last in order counts."""
    return sections.groupBy(*within, "section_id").agg(F.max_by("hash", F.struct(order, "hash")).alias("hash"))


def diff(prior: DataFrame, current: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``(*within, section_id, change, prior_hash, current_hash)``; changed needs two non-empty hashes.
    Columns ``within`` (not null) tell captures apart that are compared at once."""
    a = prior.select(*(F.col(c).alias(f"a_{c}") for c in within), F.col("section_id").alias("a"), F.col("hash").alias("prior_hash"))
    b = current.select(*(F.col(c).alias(f"b_{c}") for c in within), F.col("section_id").alias("b"), F.col("hash").alias("current_hash"))
    same = F.col("a") == F.col("b")
    for c in within:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(
        (F.col("prior_hash") != "") & (F.col("current_hash") != "") & (F.col("prior_hash") != F.col("current_hash")), "changed"
    )
    return a.join(b, same, "full").select(*(F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in within), F.coalesce("b", "a").alias("section_id"), change.alias("change"), "prior_hash", "current_hash").where("change is not null")


def new_amendments(prior: DataFrame, current: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Amendment ids that are new; removed ones are no drift."""
    keys = [*within, "amendment_id"]
    return current.join(prior.select(*keys).distinct(), keys, "left_anti")
