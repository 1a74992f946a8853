"""Records of model-code documents given as nested rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.numbering import numbered
from lexloom.sources.markup import citations
from lexloom.tables import Scratch

DOCUMENT = (
    "struct<title:struct<titleId:string,codeAbbrev:string,name:string,year:int,versionStatus:string>,"
    "chapters:array<struct<chapter:struct<chapterId:string,titleId:string,chapterNumber:string,heading:string>,"
    "sections:array<struct<sectionId:string,sectionNumber:string,heading:string,viewerUrl:string,"
    "content:array<struct<kind:string,text:string,caption:string,headers:array<string>,rows:array<array<string>>,imageUrl:string>>,"
    "definedTerms:array<struct<term:string,definition:string>>>>>>>"
)


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def read_documents(rows: DataFrame) -> DataFrame:
    """``(doc, d)`` of ``rows (doc string, body string)``; bodies that are no such document are null."""
    return rows.select("doc", F.from_json("body", DOCUMENT).alias("d"))


def flat_sections(docs: DataFrame, tenant: str, viewer: str) -> DataFrame:
    """One row per section with its place, label, deep link and references."""
    c = docs.select("doc", F.col("d.title").alias("t"), F.posexplode("d.chapters").alias("chap_at", "ch"))
    s = c.select("doc", "t", "chap_at", F.col("ch.chapter").alias("chapter"), F.posexplode("ch.sections").alias("sec_at", "s"))
    label = F.concat(F.col("t.year").cast("string"), F.lit(" "), "t.name")
    s = s.withColumn("edition_label", label).withColumn("edition_id", I.edition_id(F.lit(tenant), label))
    home = F.concat(F.lit(viewer), "t.codeAbbrev", F.col("t.year").cast("string"))
    s = s.withColumn("link", F.coalesce(F.nullif("s.viewerUrl", F.lit("")), F.concat(home, F.lit("#"), I.url_component(F.col("s.sectionNumber")))))
    prose = F.transform(F.filter(F.coalesce("s.content", F.array()), lambda n: n["kind"] == "prose"), lambda n: n["text"])
    refs = F.flatten(F.transform(prose, lambda t: F.transform(F.filter(citations(t, "model"), lambda r: r["target"] != ""), lambda r: F.struct(r["whole"].alias("whole"), r["target"].alias("target"), t.alias("context")))))
    return s.withColumn("refs", refs).withColumn("entity_id", I.section_id(F.col("edition_id"), F.col("s.sectionNumber")))


def summary() -> Column:
    """Structural summary of a section: where it is and what it holds, never its text."""
    count = lambda k: F.size(F.filter(F.coalesce("s.content", F.array()), lambda n: n["kind"] == k))
    terms = F.transform(F.coalesce("s.definedTerms", F.array()), lambda t: t["term"])
    labels = F.transform("refs", lambda r: r["target"])
    facts = F.array_compact(
        F.array(
            F.when(count("table") > 0, _plural(count("table"), "table")), F.when(count("figure") > 0, _plural(count("figure"), "figure")),
            F.when(F.size(terms) > 0, F.concat(F.lit("defines "), _plural(F.size(terms), "term"), F.lit(" ("), F.array_join(terms, ", "), F.lit(")"))),
            F.when(F.size(labels) > 0, F.concat(F.lit("cross-references "), F.array_join(labels, ", "))),
        )
    )
    head = F.concat(F.lit("Section "), "s.sectionNumber", F.lit(" ("), "s.heading", F.lit(") of the "), "edition_label", F.lit(", Chapter "), "chapter.chapterNumber", F.lit(" ("), "chapter.heading", F.lit(")."))
    return F.concat_ws(" ", head, F.when(F.size(facts) > 0, F.concat(F.lit("Structure: "), F.array_join(facts, "; "), F.lit("."))), F.concat(F.lit("The verbatim text is published elsewhere; see "), "link", F.lit(".")))


def verbatim() -> Column:
    """Text of a section, a blank line between its pieces; for a hook only, never stored."""
    prose = F.filter(F.coalesce("s.content", F.array()), lambda n: n["kind"] == "prose")
    return F.array_join(F.transform(prose, lambda n: n["text"]), "\n\n")


def reasoned(flat: DataFrame, hook: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """``flat`` with ``body`` by a hook in place of the structural summary. The hook gets Arrow batches
    with number, heading, chapter, link, labels and the verbatim text, and gives one text a row."""
    facts = F.struct(
        F.col("s.sectionNumber").alias("section_number"), F.col("s.heading").alias("heading"), F.col("chapter.heading").alias("chapter"), "edition_label", "link",
        F.transform("refs", lambda r: r["target"]).alias("references"), verbatim().alias("text"),
    )
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"hd": b["hd"], "hc": b["hc"], "hs": b["hs"], "body": hook(b).astype("string")})

    asked = flat.select(F.col("doc").alias("hd"), F.col("chap_at").alias("hc"), F.col("sec_at").alias("hs"), facts.alias("f")).select("hd", "hc", "hs", "f.*")
    said = asked.mapInPandas(run, "hd string, hc int, hs int, body string")
    return flat.join(said, (F.col("doc") == F.col("hd")) & (F.col("chap_at") == F.col("hc")) & (F.col("sec_at") == F.col("hs"))).drop("hd", "hc", "hs")


def edition(docs: DataFrame, secs: DataFrame, tenant: str, viewer: str, effective_from: str | None = None) -> DataFrame:
    """Edition records of documents with their section records; they hold no amendments, and count
    from the first day of their year where no other day is given."""
    label = F.concat(F.col("d.title.year").cast("string"), F.lit(" "), "d.title.name")
    e = docs.select("doc", label.alias("edition_label"), I.edition_id(F.lit(tenant), label).alias("entity_id"), F.col("d.title.year").cast("string").alias("year"), F.concat(F.lit(viewer), "d.title.codeAbbrev", F.col("d.title.year").cast("string")).alias("source_url")).dropDuplicates(["doc"])
    held = secs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chap_at", "sec_at", "entity_id", "content_hash"))).alias("l"))
    some = lambda f: F.coalesce(F.transform("l", lambda x: x[f]), F.array().cast("array<string>"))
    since = F.lit(effective_from) if effective_from else F.concat("year", F.lit("-01-01"))
    return e.join(held, "doc", "left").select(
        "entity_id", F.lit(tenant).alias("jurisdiction_tenant"), "edition_label", since.alias("effective_from"), some("entity_id").alias("section_ids"), F.array().cast("array<string>").alias("amendment_ids"), "source_url",
        I.content_hash(F.lit("code-edition"), F.col("entity_id"), F.col("edition_label"), F.array_join(some("content_hash"), "")).alias("content_hash"),
    )


def sections(flat: DataFrame) -> DataFrame:
    """Section records, with the structural summary as body, or the ``body`` that ``reasoned`` gave."""
    x = flat if "body" in flat.columns else flat.withColumn("body", summary())
    return x.select(
        "doc", "chap_at", "sec_at", "entity_id", F.col("edition_id").alias("code_edition_id"), F.col("s.sectionNumber").alias("section_number"), F.col("s.heading").alias("title"), F.col("body").alias("body_text"),
        F.col("link").alias("verbatim_text_deep_link"), (F.length("link") > 0).alias("footed"),
        I.content_hash(F.lit("code-section"), F.col("entity_id"), F.col("s.sectionNumber"), F.col("s.heading"), F.col("body"), F.col("link")).alias("content_hash"),
    )


def definitions(flat: DataFrame) -> DataFrame:
    """Scope is the whole code in a chapter named Definitions, else the section."""
    x = flat.select("doc", "edition_id", "entity_id", "chapter", F.explode("s.definedTerms").alias("t"))
    eid = F.concat("edition_id", F.lit("/"), I.slug(F.col("t.term")))
    return x.select("doc", eid.alias("entity_id"), "t.term", F.col("t.definition").alias("definition_text"), F.col("entity_id").alias("defining_section_id"), F.when(F.lower(F.trim("chapter.heading")) == "definitions", "code").otherwise("section").alias("scope"))


def cross_references(flat: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """References in order, resolved within the document by normal label (of equal ones the last
    section); unresolved ones stay with an empty target."""
    at = F.struct("chap_at", "sec_at")
    known = flat.groupBy(F.col("doc").alias("kd"), I.normal_label(F.col("s.sectionNumber")).alias("kl")).agg(F.max_by("entity_id", at).alias("to_id"))
    x = flat.select("doc", "edition_id", "chap_at", "sec_at", "entity_id", F.col("s.sectionNumber").alias("number"), F.posexplode("refs").alias("k", "r"))
    x = numbered(x, ["doc"], ["chap_at", "sec_at", "k"], "n", scratch, "references")
    x = x.join(known, (F.col("doc") == F.col("kd")) & (I.normal_label(F.col("r.target")) == F.col("kl")), "left")
    kind = I.reference_type(F.col("r.context"), I.MODEL_REFERENCE_PHRASES)
    return x.select(
        "doc", F.concat("edition_id", F.lit("/"), I.slug(F.col("number")), F.lit("/xref-"), F.col("n").cast("string")).alias("entity_id"), F.col("entity_id").alias("from_section_id"), F.coalesce("to_id", F.lit("")).alias("to_section_id"),
        F.col("r.whole").alias("reference_text"), kind.alias("reference_type"), I.link_type(kind).alias("link_type"),
    )


def blocks(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Block stream of the documents: chapters at depth 1, sections at depth 2, then content in
    order and defined terms."""
    c = docs.select("doc", F.posexplode("d.chapters").alias("a", "ch"))
    none, empty = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    out = lambda df, at, kind, depth, text, anchor, label: df.select(F.col("doc").alias("page"), at.alias("at"), kind.alias("kind"), depth.alias("depth"), text.alias("text"), anchor.alias("anchor"), label.alias("label"), empty.alias("extra"))
    place = lambda *p: F.array(*(F.lit(x) if isinstance(x, int) else F.col(x) for x in p))
    heads = out(c, place("a", -1), F.lit("heading"), F.lit(1), F.trim(F.concat(F.lit("Chapter "), "ch.chapter.chapterNumber", F.lit(" "), "ch.chapter.heading")), F.concat(F.lit("#"), "ch.chapter.chapterId"), F.col("ch.chapter.chapterNumber"))
    s = c.select("doc", "a", F.posexplode("ch.sections").alias("b", "s"))
    secs = out(s, place("a", "b", -1), F.lit("heading"), F.lit(2), F.trim(F.concat("s.sectionNumber", F.lit(" "), "s.heading")), F.concat(F.lit("#"), "s.sectionId"), F.col("s.sectionNumber"))
    n = s.select("doc", "a", "b", F.posexplode("s.content").alias("k", "n")).where("n.kind != 'prose' or trim(coalesce(n.text, '')) != ''")
    kind = F.when(F.col("n.kind") == "prose", "paragraph").when(F.col("n.kind") == "table", "table").otherwise("figure")
    nodes = out(n, place("a", "b", "k"), kind, F.lit(None).cast("int"), F.when(F.col("n.kind") == "prose", F.trim("n.text")).otherwise(F.col("n.caption")), none, none)
    t = s.select("doc", "a", "b", F.size(F.coalesce("s.content", F.array())).alias("m"), F.posexplode("s.definedTerms").alias("k", "t")).withColumn("q", F.col("m") + F.col("k"))
    terms = out(t, place("a", "b", "q"), F.lit("definition"), F.lit(None).cast("int"), F.col("t.definition"), none, F.col("t.term"))
    every = heads.unionByName(secs).unionByName(nodes).unionByName(terms)
    return numbered(every, ["page"], ["at"], "n", scratch, "blocks").withColumn("pos", F.col("n") - 1).drop("at", "n")
