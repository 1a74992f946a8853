"""Retrieval quality of a corpus against curated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least scores of the quality bar.
TOP3, SECTION_NUMBER, CROSS_REFERENCE = 0.9, 1.0, 0.95
#: Fixed value: sections and references that a quality run samples at most, first written first.
SAMPLE = 100


def top3_hits(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` of type retrieval with whether the expected record is among the ranked ones and
    what was found, in order."""
    found = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "did"))), lambda s: s["did"]).alias("top"))
    asked = queries.where("query_type = 'retrieval'")
    return asked.join(found, "query_id", "left").withColumn("hit", F.coalesce(F.array_contains("top", F.col("expected_atom_did")), F.lit(False)))


def score_per_tenant(hits: DataFrame, tenants: DataFrame) -> DataFrame:
    """Share of hits per tenant; 1 where a tenant has no query."""
    s = hits.groupBy("jurisdiction_tenant").agg(F.avg(F.col("hit").cast("double")).alias("top3_score"), F.count("*").alias("n_queries"))
    return tenants.join(s, "jurisdiction_tenant", "left").select(
        "jurisdiction_tenant", F.coalesce("top3_score", F.lit(1.0)).alias("top3_score"), F.coalesce("n_queries", F.lit(0)).alias("n_queries")
    )


def samples(atoms: DataFrame, n: int = SAMPLE) -> DataFrame:
    """First ``n`` (at most SAMPLE) records of each tenant and kind of ``atoms (jurisdiction_tenant,
    entity_type, did, seq, ...)``, in order of first writing; a sampling operator."""
    w = Window.partitionBy("jurisdiction_tenant", "entity_type").orderBy("seq", "did")
    return atoms.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, min(n, SAMPLE)))


def retrievable(candidates: DataFrame, sections: DataFrame) -> DataFrame:
    """``candidates (jurisdiction_tenant, section_number, did, ...)`` with ``retrievable``: whether a
    look-up of the number among the tenant's ``sections (jurisdiction_tenant, section_number, did)``
    finds the very record. Null and empty numbers find nothing."""
    held = sections.select(F.col("jurisdiction_tenant").alias("_t"), F.col("section_number").alias("_n"), F.col("did").alias("_d")).where("_n != ''").distinct()
    same = (F.col("jurisdiction_tenant") == F.col("_t")) & (F.col("section_number") == F.col("_n")) & (F.col("did") == F.col("_d"))
    return candidates.join(held, same, "left").withColumn("retrievable", F.col("_d").isNotNull()).drop("_t", "_n", "_d")


def passed(top3, number, xref):
    return (top3 >= TOP3) & (number >= SECTION_NUMBER) & (xref >= CROSS_REFERENCE)
