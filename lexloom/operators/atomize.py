"""Records and links from document trees.

Everything is keyed by page (one edition each); a page's meta row (tenant, name, edition label,
publication date, fetched_at, adapter, url) is joined once, by a size-checked join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.numbering import numbered
from lexloom.operators.tree import fold_paragraphs
from lexloom.tables import Scratch

META = "page string, tenant string, name string, edition_label string, published string, fetched_at string, adapter string, url string, access_policy string"
LINK = ("from_type", "from_id", "to_type", "to_id", "link_type", "context")


def _links(df: DataFrame, from_type: str, from_id: Column, to_type: str, to_id: Column, kind, context: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.lit(from_type).alias("from_type"), from_id.alias("from_id"), F.lit(to_type).alias("to_type"), to_id.alias("to_id"), kind.alias("link_type"), (context if context is not None else F.lit(None).cast("string")).alias("context"))


def _edition(m: DataFrame) -> Column:
    return I.edition_id(F.col("tenant"), F.col("edition_label"))


def sections(tree: DataFrame, meta: DataFrame) -> DataFrame:
    """Section records, subsections among them, in page order.

    Sections whose plain id is shared by several anchors are re-keyed by their anchor's container.
    A subsection is a section of its own, numbered by its parents' numbers and its own label; one
    outside any section is left out, with all below it.
    """
    heads = tree.where("kind = 'heading'").join(meta, "page").withColumn("edition_id", _edition(meta))
    real = heads.where("node_kind = 'section'").withColumn("named", F.when(F.col("number") != "", F.col("number")).otherwise(F.col("title")))
    real = real.withColumn("plain", I.section_id(F.col("edition_id"), F.col("named")))
    shared = real.groupBy("page", "plain").agg(F.size(F.collect_set(F.coalesce("anchor", F.lit("")))).alias("anchors"))
    path = I.anchor_path(F.col("anchor"))
    own = F.when((F.col("anchors") >= 2) & path.isNotNull(), F.concat_ws("/", "edition_id", path, I.slug(I.normal_label(F.col("named"))))).otherwise(F.col("plain"))
    real = real.join(shared, ["page", "plain"]).withColumn("entity_id", own).withColumn("sub_path", F.lit(None).cast("string")).withColumn("section_number", F.col("number")).withColumn("section_title", F.col("title"))
    subs = heads.where("node_kind = 'subsection'")
    secs = F.filter("path", lambda h: h["kind"] == "section")
    inner = F.filter("path", lambda h: h["kind"] == "subsection")
    parent = F.try_element_at(secs, F.lit(-1))
    number = F.concat(parent["number"], F.array_join(F.transform(inner, lambda h: h["number"]), ""), "number")
    subs = subs.where(F.size(secs) > 0).withColumn("section_number", number).withColumn("section_title", parent["title"]).withColumn("sub_path", F.col("number"))
    subs = subs.withColumn("entity_id", I.section_id(F.col("edition_id"), F.when(F.col("section_number") != "", F.col("section_number")).otherwise(F.col("section_title"))))
    keep = ["page", "at", "entity_id", "edition_id", "tenant", "section_number", "section_title", "sub_path", "anchor", "fetched_at", "adapter", "url"]
    both = real.select(*keep).unionByName(subs.select(*keep)).join(fold_paragraphs(tree), ["page", "at"], "left")
    body = F.coalesce("body", F.lit(""))
    return both.select(
        "page", "at", F.lit("code-section").alias("entity_type"), "entity_id", F.col("tenant").alias("jurisdiction_tenant"), F.col("edition_id").alias("code_edition_id"), "section_number", F.col("section_title").alias("title"),
        F.col("sub_path").alias("subsection_path"), body.alias("body_text"), "fetched_at", F.col("adapter").alias("source_adapter"), F.col("url").alias("source_url"),
        I.content_hash(F.lit("code-section"), F.col("entity_id"), F.col("section_number"), F.col("section_title"), F.col("sub_path"), body).alias("content_hash"),
    )


def _contained(rows: DataFrame, secs: DataFrame) -> DataFrame:
    """Rows with the record of the section or subsection heading they stand under, if any."""
    held = secs.select("page", F.col("at").alias("sat"), F.col("entity_id").alias("in_id"), F.col("section_number").alias("in_number"))
    return rows.join(held, (rows["page"] == held["page"]) & (rows["top.at"] == held["sat"]), "left").drop(held["page"]).drop("sat")


def definitions(tree: DataFrame, secs: DataFrame, meta: DataFrame) -> DataFrame:
    x = _contained(tree.where("kind = 'definition'"), secs).join(meta, "page").withColumn("edition_id", _edition(meta))
    eid = F.concat("edition_id", F.lit("/"), I.slug(F.col("label")))
    return x.select(
        "page", "at", F.lit("code-definition").alias("entity_type"), eid.alias("entity_id"), F.col("tenant").alias("jurisdiction_tenant"), F.col("edition_id").alias("code_edition_id"), F.col("label").alias("term"),
        F.col("text").alias("definition_text"), F.col("in_id").alias("defining_section_id"), F.when(F.col("in_id").isNotNull(), "section").otherwise("code").alias("scope"),
        I.content_hash(F.lit("code-definition"), eid, F.col("label"), F.col("text")).alias("content_hash"),
    )


def cross_references(tree: DataFrame, secs: DataFrame, meta: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """References, numbered in page order. The target id is built from the label and may name no
    record; a reference outside any section takes the page's latest one."""
    x = _contained(tree.where("kind = 'cross-reference'"), secs).join(meta, "page").withColumn("edition_id", _edition(meta))
    x = numbered(x, ["page"], ["at"], "n", scratch, "references")
    label = F.coalesce("in_number", F.nullif("near_section", F.lit("")), F.concat(F.lit("corpus-"), F.col("n").cast("string")))
    source = F.coalesce("in_id", I.section_id(F.col("edition_id"), label))
    target = F.when(F.coalesce("label", F.lit("")) != "", I.section_id(F.col("edition_id"), F.col("label"))).otherwise("")
    x = x.withColumn("from_section_id", source).withColumn("to_section_id", target)
    x = x.withColumn("entity_id", F.concat("edition_id", F.lit("/"), I.slug(F.col("from_section_id")), F.lit("/xref-"), F.col("n").cast("string")))
    return x.select(
        "page", "at", F.lit("code-cross-reference").alias("entity_type"), "entity_id", F.col("tenant").alias("jurisdiction_tenant"), "from_section_id", "to_section_id", F.col("text").alias("reference_text"),
        F.col("extra")["context"].alias("reference_context"), F.coalesce(F.col("extra")["reference_type"], F.lit("unknown")).alias("reference_type"),
        I.content_hash(F.lit("code-cross-reference"), F.col("entity_id"), F.col("from_section_id"), F.col("to_section_id"), F.col("text")).alias("content_hash"),
    )


def amendments(tree: DataFrame, secs: DataFrame, meta: DataFrame) -> DataFrame:
    """Amendment records. The labels in their text are resolved against the sections that stand
    before them on the page; of sections with one label the latest counts."""
    x = tree.where("kind = 'amendment-record'").join(meta, "page").withColumn("edition_id", _edition(meta))
    x = x.withColumn("ordinance_id", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("unknown-"), F.col("pos").cast("string"))))
    x = x.withColumn("entity_id", F.concat("tenant", F.lit("/"), I.slug(F.col("ordinance_id"))))
    found = F.concat(F.regexp_extract_all("text", F.lit(r"§\s*([\w.()-]+)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?i)(?<![A-Za-z0-9_])section\s+([\w.()-]+)"), F.lit(1)))
    labels = x.select("page", "at", F.posexplode(F.array_distinct(F.transform(found, I.no_end_marks))).alias("k", "raw"))
    probes = labels.select("page", "at", "k", F.posexplode(F.array("raw", I.normal_label(F.col("raw")))).alias("p", "name"))
    names = secs.select(F.col("page").alias("sp"), F.col("at").alias("sat"), F.col("entity_id").alias("sid"), F.explode(F.array_distinct(F.array("section_number", I.normal_label(F.col("section_number"))))).alias("sname"))
    hit = probes.join(names, (F.col("page") == F.col("sp")) & (F.col("name") == F.col("sname")) & (F.col("sat") < F.col("at")))
    best = hit.groupBy("page", "at", "k").agg(F.max_by("sid", F.struct((-F.col("p")).alias("p"), "sat")).alias("sid"))
    ids = best.groupBy("page", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sid"))), lambda s: s["sid"]).alias("affected"))
    return x.join(ids, ["page", "at"], "left").select(
        "page", "at", F.lit("code-amendment").alias("entity_type"), "entity_id", F.col("tenant").alias("jurisdiction_tenant"), F.lit("temporal").alias("amendment_scope"), "ordinance_id",
        F.col("extra")["effective_date"].alias("effective_date"), F.col("extra")["authority"].alias("authority"), F.coalesce("affected", F.array().cast("array<string>")).alias("affected_section_ids"), F.col("text").alias("amendment_text"),
        I.content_hash(F.lit("code-amendment"), F.col("entity_id"), F.col("ordinance_id"), F.col("extra")["effective_date"], F.col("text")).alias("content_hash"),
    )


def editions(secs: DataFrame, amends: DataFrame, meta: DataFrame) -> DataFrame:
    """One edition per page; its hash runs over those of its sections and amendments in order."""
    roll = lambda df, p: df.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "entity_id", "content_hash"))).alias(p))
    x = meta.join(roll(secs, "s"), "page", "left").join(roll(amends, "a"), "page", "left").withColumn("entity_id", _edition(meta))
    some = lambda c, f: F.coalesce(F.transform(c, lambda e: e[f]), F.array().cast("array<string>"))
    hashed = I.content_hash(F.lit("code-edition"), F.col("entity_id"), F.col("edition_label"), F.array_join(some("s", "content_hash"), ""), F.array_join(some("a", "content_hash"), ""))
    return x.select(
        "page", F.lit("code-edition").alias("entity_type"), "entity_id", F.col("tenant").alias("jurisdiction_tenant"), "edition_label", F.coalesce(F.nullif("published", F.lit("")), "fetched_at").alias("effective_from"),
        some("s", "entity_id").alias("section_ids"), some("a", "entity_id").alias("amendment_ids"), hashed.alias("content_hash"),
    )


def corpora(meta: DataFrame) -> DataFrame:
    return meta.select(
        "page", F.lit("jurisdiction-corpus").alias("entity_type"), F.col("tenant").alias("entity_id"), F.col("tenant").alias("jurisdiction_tenant"), F.col("name").alias("jurisdiction_name"), F.array(_edition(meta)).alias("adopted_edition_ids"),
        "access_policy", I.content_hash(F.lit("jurisdiction-corpus"), F.col("tenant"), F.col("name"), _edition(meta), F.coalesce("access_policy", F.lit("public-free"))).alias("content_hash"),
    )


def links(secs: DataFrame, defs: DataFrame, xrefs: DataFrame, amends: DataFrame, corp: DataFrame) -> DataFrame:
    """Contains, defines, reference, amends and contains links of a page's records."""
    c = F.col
    amended = amends.select("entity_id", F.explode("affected_section_ids").alias("to"))
    adopted = corp.select("entity_id", F.explode("adopted_edition_ids").alias("to"))
    return (
        _links(secs, "code-edition", c("code_edition_id"), "code-section", c("entity_id"), "contains")
        .unionByName(_links(defs.where("defining_section_id is not null"), "code-section", c("defining_section_id"), "code-definition", c("entity_id"), "defines"))
        .unionByName(_links(xrefs.where("to_section_id != ''"), "code-section", c("from_section_id"), "code-section", c("to_section_id"), I.link_type(c("reference_type")), c("reference_context")))
        .unionByName(_links(amended, "code-amendment", c("entity_id"), "code-section", c("to"), "amends"))
        .unionByName(_links(adopted, "jurisdiction-corpus", c("entity_id"), "code-edition", c("to"), "contains"))
    )
