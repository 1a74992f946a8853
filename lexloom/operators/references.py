"""References found in the bodies of section records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.graph import resolve_labels
from lexloom.operators.numbering import numbered
from lexloom.tables import Scratch

#: How bodies cite sections, in the order of the passes; characters of context.
PASSES = (r"§\s*([\w.()-]+)", r"(?i)(?<![A-Za-z0-9_])section\s+([\w.()-]+)")
AROUND = 60
#: Links between sections that a new reading of the bodies replaces.
REPLACED = ("cites", "see-also", "subject-to", "as-defined-in")


def matches(text: Column, pattern: str) -> Column:
    """Array of structs (whole, part, at): every match, its group 1 and where it begins (from 0)."""
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
    one = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("before"))
    kind = "array<struct<whole:string,part:string,at:int>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("l"))

    def add(held: Column, m: Column) -> Column:
        at = held["end"] + F.length(m["before"])
        return F.struct((at + F.length(m["whole"])).alias("end"), F.concat(held["l"], F.array(F.struct(m["whole"].alias("whole"), m["part"].alias("part"), at.alias("at")))).alias("l"))

    return F.aggregate(one, start, add, lambda held: held["l"])


def label_forms(sections: DataFrame) -> DataFrame:
    """``(bucket, label, id)``: the four forms of each section's number within its edition; of
    sections with one form the last written counts."""
    n = F.col("section_number")
    forms = F.array(n, I.normal_label(n), I.bare_label(n), I.bare_label(I.normal_label(n)))
    x = sections.where(n.isNotNull()).select(F.col("code_edition_id").alias("bucket"), "entity_id", "seq", F.posexplode(forms).alias("f", "label"))
    return x.groupBy("bucket", "label").agg(F.max_by("entity_id", F.struct("seq", "f", "entity_id")).alias("id"))


def sniff(sections: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Reference records of ``sections (entity_id, code_edition_id, section_number, body_text, seq)``,
    and the references that name no section of their edition.

    Both passes run over the whole body; of references with one normal label only the first of a
    section counts, whether or not it resolves. Context is 60 characters on either side; the kind
    is inferred from it. Records are numbered within their edition, by section and place. A null
    body has no references.
    """
    found = F.concat(*(F.transform(matches(F.col("body_text"), p), lambda m, i=i: F.struct(F.lit(i).alias("pass_no"), m["at"].alias("at"), m["whole"].alias("whole"), m["part"].alias("part"))) for i, p in enumerate(PASSES)))
    x = sections.where("body_text is not null").select("entity_id", "code_edition_id", "seq", "body_text", F.explode(found).alias("m"))
    label = I.no_end_marks(F.col("m.part"))
    start = F.greatest(F.lit(0), F.col("m.at") - AROUND)
    context = I.trim_all(F.substring("body_text", start + 1, F.col("m.at") - start + F.length("m.whole") + AROUND))
    x = x.select("entity_id", "code_edition_id", "seq", F.col("m.pass_no").alias("pass_no"), F.col("m.at").alias("at"), F.trim("m.whole").alias("reference_text"), label.alias("label"), I.normal_label(label).alias("normal"), context.alias("reference_context"))
    x = x.where("label != '' and normal != ''")
    w = Window.partitionBy("entity_id", "normal").orderBy("pass_no", "at")
    x = x.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    probes = x.withColumn("bucket", F.col("code_edition_id")).withColumn("probe_1", F.col("label")).withColumn("probe_2", F.col("normal")).withColumn("probe_3", I.bare_label(F.col("normal")))
    hit = resolve_labels(probes, label_forms(sections)).drop("bucket", "probe_1", "probe_2", "probe_3")
    kind = I.reference_type(F.col("reference_context"))
    good = numbered(hit.where("to_id is not null"), ["code_edition_id"], ["seq", "entity_id", "pass_no", "at"], "n", scratch, "references").withColumn("reference_type", kind)
    xid = F.concat("code_edition_id", F.lit("/"), I.slug(F.col("entity_id")), F.lit("/xref-"), F.col("n").cast("string"))
    records = good.select(
        xid.alias("entity_id"), F.col("entity_id").alias("from_section_id"), F.col("to_id").alias("to_section_id"), "reference_text", "reference_context", "reference_type", I.link_type(F.col("reference_type")).alias("link_type"),
        I.content_hash(F.lit("code-cross-reference"), xid, F.col("entity_id"), F.col("to_id"), F.col("reference_text")).alias("content_hash"),
    )
    return records, hit.where("to_id is null").select(F.col("entity_id").alias("from_section_id"), "label")


def replace_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links with those between sections of the replaced kinds taken out and the records' put in,
    each (from, to, kind) once."""
    old = links.where(~((F.col("from_type") == "code-section") & (F.col("to_type") == "code-section") & F.col("link_type").isin(*REPLACED)))
    s = F.lit("code-section")
    new = records.select(s.alias("from_type"), F.col("from_section_id").alias("from_id"), s.alias("to_type"), F.col("to_section_id").alias("to_id"), "link_type", F.col("reference_context").alias("context"), "entity_id")
    first = new.groupBy("from_type", "from_id", "to_type", "to_id", "link_type").agg(F.min_by("context", "entity_id").alias("context"))
    return old.select(*first.columns).unionByName(first)
