"""Composition of base sections with dated local amendments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an overlay's operation makes of a section.
RESOLUTION = {"modify": "modified", "replace": "replaced", "add": "added", "delete": "deleted"}


def overlays_of(amendments: DataFrame, tenant: str, base_id: str) -> DataFrame:
    """Overlays of one tenant on one section, by date, then order of writing."""
    return amendments.where(
        (F.col("amendment_scope") == "jurisdictional-overlay") & (F.col("jurisdiction_tenant") == tenant) & F.array_contains("affected_section_ids", base_id)
    ).orderBy("effective_date", "seq")


def effective_rules(bases: DataFrame, amendments: DataFrame) -> DataFrame:
    """Effective rule of every (tenant, base section) in one aggregation.

    ``bases``: jurisdiction_tenant, base_id, section_number, title, code_edition_id (all null but the
    first two where a tenant names a section that does not exist). ``amendments``:
    jurisdiction_tenant, affected_section_ids, effective_date, seq, overlay_operation, ordinance_id,
    amendment_scope. The latest overlay decides the resolution; the base text governs unless an
    overlay replaces or deletes it or the section is a local addition. Only counts, flags and the
    latest overlay are aggregated, so a section with very many overlays stays one small row.
    """
    o = amendments.where("amendment_scope = 'jurisdictional-overlay'").select(
        "jurisdiction_tenant", F.explode(F.array_distinct("affected_section_ids")).alias("base_id"), "effective_date", "seq", "overlay_operation", "ordinance_id"
    )
    last = F.struct("effective_date", "seq", "overlay_operation", "ordinance_id")
    per = o.groupBy("jurisdiction_tenant", "base_id").agg(F.count("*").alias("n_overlays"), F.max(last).alias("last"), F.bool_or(F.col("overlay_operation").isin("replace", "delete")).alias("gone"))
    x = bases.withColumn("_base", F.lit(True)).join(per, ["jurisdiction_tenant", "base_id"], "full")
    resolution = F.lit("base-only")
    for op, r in RESOLUTION.items():
        resolution = F.when(F.col("last.overlay_operation") == op, r).otherwise(resolution)
    exists = F.col("_base").isNotNull() & F.col("section_number").isNotNull()
    has = F.col("n_overlays").isNotNull()
    x = x.withColumn("resolution", resolution).withColumn("base_governs", exists & F.when(has, ~F.col("gone") & (F.col("resolution") != "added")).otherwise(True))
    base = F.when(exists, F.trim(F.concat(F.lit("§"), "section_number", F.lit(" "), "title"))).otherwise("(no base section)")
    plain = F.concat(base, F.lit(" adopted by "), "jurisdiction_tenant", F.lit(" without local amendment."))
    many = F.when(F.col("n_overlays") == 1, F.lit("1 overlay")).otherwise(F.concat(F.col("n_overlays").cast("string"), F.lit(" overlays")))
    changed = F.concat(
        base, F.lit(": "), "resolution", F.lit(" for "), "jurisdiction_tenant", F.lit(" by "), many, F.lit(" (latest: ordinance "), "last.ordinance_id",
        F.lit(", "), "last.overlay_operation", F.lit(", effective "), "last.effective_date", F.lit(")."),
    )
    return x.select(
        "jurisdiction_tenant", "base_id", "code_edition_id", "resolution", "base_governs", F.coalesce("n_overlays", F.lit(0)).alias("n_overlays"), F.when(has, changed).otherwise(plain).alias("note")
    )
