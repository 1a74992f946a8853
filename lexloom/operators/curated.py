"""Curated queries: compiled from drafts, or drafted from contents by a hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.numbering import numbered
from lexloom.tables import Scratch


def compile_drafts(drafts: DataFrame, order: list[str], scratch: Scratch | None, tenant: str | None = None, books: list[str] | None = None) -> DataFrame:
    """Query records of ``drafts (tenant, book, edition, section_number, query_text, query_type, ...)``.
    Ids count the drafts that are left after filtering, in ``order``; a null type is retrieval."""
    if tenant is not None:
        drafts = drafts.where(F.col("tenant") == tenant)
    if books is not None:
        drafts = drafts.where(F.col("book").isin(books))
    x = numbered(drafts.withColumn("_all", F.lit(0)), ["_all"], order, "n", scratch, "drafts")
    section = I.section_id(I.edition_id(F.col("tenant"), F.concat_ws("-", "book", "edition")), F.col("section_number"))
    return x.select(
        F.concat(F.lit("seed-"), "tenant", F.lit("-"), "book", F.lit("-"), F.col("n").cast("string")).alias("query_id"), F.col("tenant").alias("jurisdiction_tenant"), "query_text",
        I.did(F.lit("code-section"), section).alias("expected_atom_did"), F.coalesce("query_type", F.lit("retrieval")).alias("query_type"), F.lit("draft").alias("status"),
    )


def author(toc: DataFrame, generate: Callable[[pd.DataFrame], pd.DataFrame], review: bool, scratch: Scratch | None) -> DataFrame:
    """Query records that ``generate`` drafts from lines of ``toc (tenant, line_no, heading, ...)``: it
    gets Arrow batches of lines and returns ``tenant, line_no, query_text, query_type``. Records are
    numbered within their tenant; they await review, or are approved at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield generate(b)[["tenant", "line_no", "query_text", "query_type"]]

    drafts = toc.mapInPandas(run, "tenant string, line_no bigint, query_text string, query_type string")
    x = numbered(drafts, ["tenant"], ["line_no", "query_text"], "n", scratch, "authored")
    return x.select(
        F.concat("tenant", F.lit("-"), F.col("n").cast("string")).alias("query_id"), F.col("tenant").alias("jurisdiction_tenant"), "query_text", "query_type", F.lit("llm-generated").alias("authorship_source"),
        F.lit("draft" if review else "approved").alias("status"),
    )


def author_counts(records: DataFrame) -> DataFrame:
    """Records generated, stored (one for each id) and awaiting review, by tenant."""
    return records.groupBy("jurisdiction_tenant").agg(F.count("*").alias("generated"), F.count_distinct("query_id").alias("upserted"), F.count_if(F.col("status") == "draft").alias("awaiting_review"))
