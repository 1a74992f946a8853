"""Queries of the problems on texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.leakage import Leak, leaks
from lexloom.llm.neardup import NearDup, class_links, membership, near_duplicates, spelled_out
from lexloom.llm.quality import STATS, text_statistics
from lexloom.llm.scan import read_pages, repaired_text
from lexloom.llm.tokenizer import encode_table
from lexloom.llm.vectors import Similar, most_similar
from lexloom.plans import Registry
from lexloom.tables import Scratch, table

R = Registry()
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@R.query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "legacy_atoms").select("id", F.struct("fetched_at", F.col("embedding_model").alias("space"), F.col("embedding").alias("vec")).alias("r"))
    latest = rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.space", "r.vec")
    near = most_similar(latest, Scratch(spark, "similar"), Similar(k=10, least=0.8))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


SECTIONS = NearDup(similarity=0.6, shingle=3, min_words=40)


def _near_sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit("")))
    sections = table(spark, d, "code_sections").select(F.col("entity_id").alias("id"), text.alias("text"))
    return near_duplicates(sections, Scratch(spark, "neardup"), SECTIONS)


@R.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spelled_out(*_near_sections(spark, d), SECTIONS).select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


@R.query("p2_members")
def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return membership(*_near_sections(spark, d)).withColumnRenamed("id", "entity_id")


@R.query("p2_links")
def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return class_links(*_near_sections(spark, d))


@R.query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_table(table(spark, d, "documents"), VOCABULARY)


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "curated_queries").select(F.col("query_id").alias("item_id"), F.col("passage").alias("text"))
    found = leaks(table(spark, d, "documents"), items, Scratch(spark, "leakage"), Leak(window=16, edits=1))
    return found.select("doc_id", F.col("item_id").alias("query_id"), "edits")


@R.query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).where("edits = 0").drop("edits")


@R.query("p8_edited")
def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Passages held with at most one word replaced, inserted or deleted."""
    return _leaked(spark, d)


@R.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents")).where("kind != 'prose'").select("doc_id", "kind")


@R.query("p9_stats")
def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    rounded = lambda c, t: F.round(c, 6).alias(c) if t == "double" else F.col(c)
    return text_statistics(table(spark, d, "documents")).select("doc_id", *(rounded(c, t) for c, t in STATS.items()), "kind")


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "code_sections")
    parts = F.struct(
        F.col("fetched_at").try_cast("timestamp").alias("t"), F.col("body_text").alias("body"), F.col("jurisdiction_tenant").alias("owner"),
        F.element_at(F.split("code_edition_id", "/"), -1).alias("edition"),
    )
    scans = rows.where("source_adapter = 'raw-pdf'").groupBy(F.col("entity_id").alias("id")).agg(F.max(parts).alias("r"))
    return scans.select("id", "r.body", "r.owner", "r.edition"), rows.where("source_adapter != 'raw-pdf'").select(F.col("body_text").alias("body"))


@R.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    repairs, _ = read_pages(*_scanned(spark, d), Scratch(spark, "scan"))
    return repairs.select(F.col("id").alias("entity_id"), F.col("kind").alias("repair_kind"), "item").distinct()


@R.query("p5_text")
def p5_text(spark: SparkSession, d: str) -> DataFrame:
    repairs, pages = read_pages(*_scanned(spark, d), Scratch(spark, "scan"))
    return repaired_text(pages, repairs).select(F.col("id").alias("entity_id"), F.col("text").alias("body_text"))
