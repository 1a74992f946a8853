"""Batch transformation of a legacy table into records, editions and corpora."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.references import sniff
from lexloom.operators.store import keep_first
from lexloom.tables import Scratch


def transform(rows: DataFrame, sources: DataFrame, adapters: dict[str, str] | None = None) -> DataFrame:
    """Section records of legacy rows with a number and a body. The source's name gives the adapter:
    a mapped one, or ``legacy/<name>``, with name ``unknown`` for a source that does not exist. The
    lookup table is joined without a hint: Spark broadcasts it while it is small."""
    kept = rows.where(~F.coalesce(I.trim_all(F.col("section_number")) == "", F.lit(True)) & ~F.coalesce(I.trim_all(F.col("body")) == "", F.lit(True)))
    names = sources.select(F.col("id").alias("_sid"), F.col("source_name"))
    name = F.coalesce("source_name", F.lit("unknown"))
    adapter = F.concat(F.lit("legacy/"), name)
    for k, v in (adapters or {}).items():
        adapter = F.when(name == k, v).otherwise(adapter)
    edition = F.concat("jurisdiction_key", F.lit("/"), I.slug(F.concat_ws("-", "code_book", "edition")))
    eid = I.section_id(edition, F.col("section_number"))
    title = F.coalesce("section_title", F.lit(""))
    return kept.join(names, F.col("source_id") == F.col("_sid"), "left").select(
        F.col("id").alias("legacy_id"), eid.alias("entity_id"), edition.alias("code_edition_id"), F.col("jurisdiction_key").alias("jurisdiction_tenant"), "section_number", title.alias("title"), F.col("body").alias("body_text"), "fetched_at",
        adapter.alias("source_adapter"), "source_url", I.content_hash(F.lit("code-section"), eid, F.col("section_number"), title, F.lit(""), F.col("body")).alias("content_hash"),
    )


def drop_counts(rows: DataFrame) -> DataFrame:
    """How many rows a batch drops, by reason; a row without number counts there only."""
    no_number = F.coalesce(I.trim_all(F.col("section_number")) == "", F.lit(True))
    no_body = F.coalesce(I.trim_all(F.col("body")) == "", F.lit(True))
    return rows.agg(F.count_if(no_number).alias("dropped_null_section"), F.count_if(~no_number & no_body).alias("dropped_empty_body"), F.count_if(~no_number & ~no_body).alias("kept"))


def edition_rollup(sections: DataFrame, order: list[Column], labels: Column | None = None) -> DataFrame:
    """Editions of section records: ids in order, first and last fetch, adapter of the first row. The
    edition's section ids are one array, as its record asks for; the counts beside it do not need
    it."""
    o = F.struct(*order)
    x = sections.groupBy("jurisdiction_tenant", "code_edition_id").agg(
        F.count("*").alias("n_sections"), F.min("fetched_at").alias("earliest"), F.max("fetched_at").alias("latest"), F.min_by("source_adapter", o).alias("source_adapter"), F.min_by("source_url", o).alias("source_url"),
        F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), "entity_id"))), lambda e: e["entity_id"]).alias("section_ids"), F.min(o).alias("first"),
    )
    label = labels if labels is not None else F.col("code_edition_id")
    return x.withColumn("edition_label", label).withColumn(
        "content_hash", I.content_hash(F.lit("code-edition"), F.col("code_edition_id"), F.col("edition_label"), F.array_join("section_ids", ""))
    )


def corpus_rollup(editions: DataFrame) -> DataFrame:
    """Corpora of editions: ids in first-seen order, the last of them current, adapter of the latest
    fetch (of equal ones the first)."""
    return editions.groupBy("jurisdiction_tenant").agg(
        F.count("*").alias("n_editions"), F.max_by("code_edition_id", "first").alias("current_edition_id"), F.max("latest").alias("last_refreshed_at"),
        F.min_by("source_adapter", F.struct((-F.unix_micros("latest")).alias("u"), "first")).alias("source_adapter"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "code_edition_id"))), lambda e: e["code_edition_id"]).alias("adopted_edition_ids"),
    )


def run(rows: DataFrame, sources: DataFrame, scratch: Scratch, books: list[str] | None = None) -> dict[str, DataFrame]:
    """A whole migration: ``sections`` (of writes with one id the earliest is kept), ``editions``,
    ``corpora``, ``references``, ``links``, ``status`` and a ``report`` of one row."""
    if books is not None:
        rows = rows.where(F.col("code_book").isin(books))
    written = scratch.save(transform(rows, sources), "written")
    order = [F.col("fetched_at"), F.col("legacy_id")]
    secs = scratch.save(keep_first(written, ["entity_id"], order), "sections")
    editions = scratch.save(edition_rollup(secs, order), "editions")
    corpora = scratch.save(corpus_rollup(editions), "corpora")
    refs, unresolved = sniff(secs.select("entity_id", "code_edition_id", "section_number", "body_text", F.unix_micros("fetched_at").alias("seq")), scratch)
    refs = scratch.save(refs, "references_found")
    link = lambda df, a, b, kind: df.select(F.lit(a[0]).alias("from_type"), a[1].alias("from_id"), F.lit(b[0]).alias("to_type"), b[1].alias("to_id"), kind.alias("link_type"))
    c = F.col
    links = (
        link(secs, ("code-edition", c("code_edition_id")), ("code-section", c("entity_id")), F.lit("contains"))
        .unionByName(link(editions, ("jurisdiction-corpus", c("jurisdiction_tenant")), ("code-edition", c("code_edition_id")), F.lit("contains")))
        .unionByName(link(refs, ("code-section", c("from_section_id")), ("code-section", c("to_section_id")), c("link_type")))
    )
    counted = secs.groupBy("jurisdiction_tenant").agg(F.count("*").alias("atom_count"))
    status = corpora.join(counted, "jurisdiction_tenant").select(
        "jurisdiction_tenant", I.did(F.lit("code-edition"), c("current_edition_id")).alias("current_edition_did"), F.lit("not-evaluated").alias("quality_bar"), "atom_count", "last_refreshed_at", F.lit("clean").alias("drift_status")
    )
    n = lambda df: df.agg(F.count("*").alias("n"))
    parts = {
        "sections_transformed": n(secs), "section_collisions": written.agg((F.count("*") - F.count_distinct("entity_id")).alias("n")), "editions_synthesized": n(editions), "corpora_synthesized": n(corpora),
        "cross_references_resolved": n(refs), "cross_references_unresolved_skipped": n(unresolved), "links_emitted": n(links),
    }
    named = reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(k).alias("k"), c("n").cast("bigint").alias("n")) for k, df in parts.items()))
    dropped = drop_counts(rows)
    named = named.unionByName(dropped.select(F.stack(F.lit(2), F.lit("sections_dropped_null_section"), "dropped_null_section", F.lit("sections_dropped_empty_body"), "dropped_empty_body").alias("k", "n")))
    names = [*parts, "sections_dropped_null_section", "sections_dropped_empty_body"]
    report = named.agg(*(F.max(F.when(c("k") == k, c("n"))).alias(k) for k in names))
    return {"sections": secs, "editions": editions, "corpora": corpora, "references": refs, "links": links, "status": status, "report": report}


def run_units(units: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the frames of ingest units, with ``unit_id``, and why others are missing. A unit that
    raises or gives no rows is left out and stops none of the others."""
    kept, skipped = [], {}
    for name, make in units.items():
        try:
            df = make()
            if df.isEmpty():
                skipped[name] = "no rows"
            else:
                kept.append(df.withColumn("unit_id", F.lit(name)))
        except Exception as e:
            skipped[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept) if kept else None), skipped


def page_range(c: Column) -> Column:
    """Struct (first, last) of ``a`` or ``a-b``; 1 to 3 where it is neither."""
    a, b = F.regexp_extract(c, r"^\s*(\d+)\s*(?:-\s*\d+\s*)?$", 1), F.regexp_extract(c, r"^\s*\d+\s*-\s*(\d+)\s*$", 1)
    first = F.coalesce(a.try_cast("int"), F.lit(1))
    return F.struct(first.alias("first"), F.coalesce(b.try_cast("int"), F.when(a != "", first).otherwise(3)).alias("last"))
