"""Document trees from block streams, by windows.

A heading's ancestors are, at each smaller depth, the latest heading not followed by a shallower or
equal one. Six conditional ``last`` columns over one partitioning and order hold them all, so a
document's tree takes one sort and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.ids import trim_all

#: Bits of the positions within a part of a page.
PART_BITS = 24
#: What a heading of a depth is.
KINDS = {1: "chapter", 2: "article", 3: "section", 4: "subsection", 5: "subsection", 6: "subsection"}
#: How headings name their label: by sign, by division word, by the first word alone.
SIGN = r"^§\s*([\w.()-]+)\s*[—–-]?\s*(.*)$"
WORD = r"(?i)^(Chapter|Ch\.?|Article|Art\.?|Division|Div\.?|Section|Sec\.?)\s+([\w.-]+)\s*[—–-]?\s*(.*)$"
BARE = r"^([\w.-]+)\s+(.*)$"


def split_heading(text: Column) -> Column:
    """Struct ``(label, title)`` of a heading's text."""
    word_title = trim_all(F.regexp_extract(text, WORD, 3))
    return (
        F.when(text.rlike(SIGN), F.struct(F.regexp_extract(text, SIGN, 1).alias("label"), trim_all(F.regexp_extract(text, SIGN, 2)).alias("title")))
        .when(text.rlike(WORD), F.struct(F.regexp_extract(text, WORD, 2).alias("label"), F.when(word_title != "", word_title).otherwise(F.regexp_extract(text, WORD, 1)).alias("title")))
        .when(text.rlike(BARE), F.struct(F.regexp_extract(text, BARE, 1).alias("label"), trim_all(F.regexp_extract(text, BARE, 2)).alias("title")))
        .otherwise(F.struct(F.lit("").alias("label"), text.alias("title")))
    )


def kind_of(depth: Column, schema: dict[int, str] = KINDS) -> Column:
    out = F.lit("section")
    for d, k in schema.items():
        out = F.when(depth == d, k).otherwise(out)
    return out


def build_tree(blocks: DataFrame, schema: dict[int, str] = KINDS) -> DataFrame:
    """``blocks (page, pos, sub, kind, depth, text, anchor, label, extra)`` with, for headings,
    ``node_kind, number, title`` and for all rows ``top`` (the container: latest heading above),
    ``path`` (headings from the outermost to the container as structs) and ``near_section`` (latest
    section heading of the page, never reset). ``at`` is the order within a page.

    Pages are cut into parts of ``PART`` positions. A window runs over one part; what a part leaves
    open to the next, one row a part, is carried along the page by a window over those rows.
    """
    at = F.struct("pos", "sub")
    b = blocks.withColumn("at", at).withColumn("_part", F.shiftright("pos", PART_BITS))
    head = F.col("kind") == "heading"
    parts = split_heading(F.coalesce("label", "text"))
    b = b.withColumn("node_kind", F.when(head, kind_of(F.col("depth"), schema)).otherwise(F.when(F.col("kind") == "amendment-record", "amendment").otherwise(F.col("kind"))))
    b = b.withColumn("number", F.when(head, parts["label"])).withColumn("title", F.when(head, parts["title"]))
    me = F.struct("at", "depth", F.col("node_kind").alias("kind"), "number", "title", "anchor")
    w = Window.partitionBy("page", "_part").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, -1)
    marks = {f"s{d}": F.when(head & (F.col("depth") == d), me) for d in range(1, 7)} | {"near_section": F.when(F.col("node_kind") == "section", F.struct("number"))}
    ends = b.where(head).groupBy("page", "_part").agg(*(F.max_by(v, F.when(v.isNotNull(), at)).alias(k) for k, v in marks.items()))
    along = Window.partitionBy("page").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts_ = b.select("page", "_part").distinct().join(ends, ["page", "_part"], "left")
    carried = parts_.select("page", "_part", *(F.last(k, ignorenulls=True).over(along).alias(f"_{k}") for k in marks))
    b = b.select("*", *(F.last(v, ignorenulls=True).over(w).alias(k) for k, v in marks.items())).join(carried, ["page", "_part"])
    b = b.select(*blocks.columns, "at", "node_kind", "number", "title", *(F.coalesce(k, f"_{k}").alias(k) for k in marks)).withColumn("near_section", F.col("near_section.number"))
    # A heading is still open when no later one is as shallow or shallower, and shallower than the row.
    still = []
    for d in range(1, 7):
        ok = F.col(f"s{d}").isNotNull()
        for e in range(1, d):
            ok = ok & (F.col(f"s{e}").isNull() | (F.col(f"s{e}.at") < F.col(f"s{d}.at")))
        ok = ok & (~head | (F.lit(d) < F.col("depth")))
        still.append(F.when(ok, F.col(f"s{d}")))
    b = b.withColumn("path", F.array_compact(F.array(*still))).drop(*(f"s{d}" for d in range(1, 7)))
    return b.withColumn("top", F.when(F.col("kind") != "amendment-record", F.try_element_at("path", F.lit(-1))))


def fold_paragraphs(tree: DataFrame) -> DataFrame:
    """``(page, at, body)``: paragraphs of each section or subsection heading joined by line feeds in
    order; text elsewhere is a stray note and in no body."""
    inside = tree.where("kind = 'paragraph' and top.kind in ('section', 'subsection')")
    held = inside.groupBy("page", F.col("top.at").alias("own")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    return held.select("page", F.col("own").alias("at"), F.array_join(F.transform("t", lambda s: s["text"]), "\n").alias("body"))


def quality(tree: DataFrame) -> DataFrame:
    """Counts per page and whether the structure is viable: sections and references exist."""
    n = lambda k: F.count_if(F.col("node_kind") == k)
    return tree.groupBy("page").agg(
        n("section").alias("sections"), n("definition").alias("definitions"), n("cross-reference").alias("cross_references"), n("amendment").alias("amendments"),
        F.count_if((F.col("node_kind") == "cross-reference") & (F.coalesce("label", F.lit("")) == "")).alias("unresolved"),
    ).withColumn("viable", (F.col("sections") > 0) & (F.col("cross_references") > 0))
