"""Prose summaries of records for an audience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _forms() -> dict[str, tuple[Column, Column, list[tuple[str, Column]]]]:
    """For each kind of record: full prose, compact prose, key metrics."""
    scope = F.when(F.col("amendment_scope") == "jurisdictional-overlay", F.concat(F.lit("jurisdictional overlay ("), _s("overlay_operation"), F.lit(")"))).otherwise("temporal amendment")
    until = F.when(F.col("effective_to").isNotNull(), F.concat(F.lit(" to "), "effective_to")).otherwise("")
    return {
        "code-section": (F.concat(_s("section_number"), F.lit(" "), _s("title"), F.lit(". "), _s("body_text")), F.concat(_s("section_number"), F.lit(" "), _s("title")), [("Section", _s("section_number")), ("Jurisdiction", _s("jurisdiction_tenant"))]),
        "code-definition": (F.concat(_s("term"), F.lit(" — "), _s("definition_text")), _s("term"), [("Term", _s("term"))]),
        "code-amendment": (
            F.concat(F.lit("Ordinance "), _s("ordinance_id"), F.lit(" — "), scope, F.lit(", effective "), _s("effective_date"), F.lit(", "), _s("authority"), F.lit(". "), _s("amendment_text")),
            F.concat(F.lit("Ordinance "), _s("ordinance_id"), F.lit(" ("), scope, F.lit(")")), [("Ordinance", _s("ordinance_id")), ("Scope", _s("amendment_scope"))],
        ),
        "code-cross-reference": (F.trim(F.concat(F.upper(_s("reference_type")), F.lit(": "), _s("reference_text"), F.lit(" "), _s("reference_context"))), _s("reference_text"), [("Reference", _s("reference_text"))]),
        "code-edition": (F.concat(_s("edition_label"), F.lit(" — "), _s("n_sections"), F.lit(" sections, effective from "), _s("effective_from"), until, F.lit(".")), _s("edition_label"), [("Edition", _s("edition_label")), ("Sections", _s("n_sections"))]),
        "jurisdiction-corpus": (
            F.concat(_s("jurisdiction_name"), F.lit(" — "), _s("n_editions"), F.lit(" editions, current: "), F.coalesce("current_edition_id", F.lit("none")), F.lit(". Quality bar: "), _s("quality_bar"), F.lit(".")),
            _s("jurisdiction_name"), [("Jurisdiction", _s("jurisdiction_name")), ("Quality", _s("quality_bar"))],
        ),
    }


def summarize(records: DataFrame, kind: str, audience: str = "ai", asked: DataFrame | None = None) -> DataFrame:
    """``(entity_id, prose, metrics, provenance, scope_filtered)``. The audience ``user`` gets the compact
    prose, every other one the full. Ids asked for that do not exist come out as not found."""
    full, compact, metrics = _forms()[kind]
    user = audience == "user"
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in metrics))
    x = records.select("entity_id", (compact if user else full).alias("prose"), pairs.alias("metrics"), F.concat("entity_id", F.lit("@"), "content_hash").alias("provenance"), F.lit(user).alias("scope_filtered"))
    if asked is None:
        return x
    return asked.select("entity_id").join(x, "entity_id", "left").select(
        "entity_id", F.coalesce("prose", F.concat(F.lit(f"Atom not found: {kind}/"), "entity_id")).alias("prose"), F.coalesce("metrics", F.array().cast("array<struct<label:string,value:string>>")).alias("metrics"),
        F.coalesce("provenance", F.lit("")).alias("provenance"), F.coalesce("scope_filtered", F.lit(False)).alias("scope_filtered"),
    )
