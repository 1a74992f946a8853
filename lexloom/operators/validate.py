"""Row validation: named rules, an array of those that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of record must hold.
REQUIRED = {
    "code-section": ("entity_id", "jurisdiction_tenant", "content_hash", "code_edition_id", "title"),
    "code-edition": ("entity_id", "jurisdiction_tenant", "edition_label", "effective_from", "content_hash"),
    "code-cross-reference": ("report_id", "jurisdiction_tenant", "reference_text"),
}
REFERENCE_TYPES = ("see", "notwithstanding", "subject-to", "as-defined-in", "amends", "supersedes", "unknown")


def filled(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def url(c: str) -> Column:
    """Null, or an absolute web address."""
    return F.col(c).isNull() | F.col(c).rlike(r"^https?://[^\s/]+")


def one_of(c: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def within(c: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(c).between(low, high), F.lit(False))


def rules_for(kind: str) -> dict[str, Column]:
    out = {f"{c} is empty": filled(c) for c in REQUIRED[kind]}
    if kind == "code-section":
        out |= {"source_url is no address": url("source_url"), "fetched_at is no time": F.col("fetched_at").try_cast("timestamp").isNotNull(), "deep link is no address": url("verbatim_text_deep_link")}
    if kind == "code-cross-reference":
        out |= {"reference_type is unknown": one_of("reference_type", REFERENCE_TYPES)}
    return out


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``errors``: names of the rules that do not hold, in their order."""
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(~ok, name) for name, ok in rules.items()))))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others for quarantine."""
    x = validate(rows, rules)
    return x.where(F.size("errors") == 0).drop("errors"), x.where(F.size("errors") > 0)


def missing_kinds(sections: Column, required: tuple[str, ...]) -> Column:
    """Required kinds that an array of structs with a field ``kind`` lacks."""
    return F.array_except(F.array(*(F.lit(r) for r in required)), F.transform(sections, lambda s: s["kind"]))
