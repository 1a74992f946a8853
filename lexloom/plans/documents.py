"""Queries of block streams, trees, records from pages, model code, migration, folds, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.functions import text as T
from lexloom.operators import atomize, curated, fold, graph, migrate, modelcode, references, store, summaries, tree, validate
from lexloom.plans import Registry, twins
from lexloom.sources import dumps, markup, pages
from lexloom.tables import Scratch, table

R = Registry()
S, J = T.sql, I.sql


def _us(c: str):
    return F.expr(f"unix_micros(try_cast({c} as timestamp))")


# --- block streams and trees ------------------------------------------------------------------

_BLOCK_KIND = r"CASE WHEN regexp_matches(line, '^[A-Z][A-Z ,;]+$') THEN 1 WHEN regexp_matches(line, '^(§|Sec\. )') THEN 3 WHEN regexp_matches(line, '^\([a-z]\) ') THEN 4 END"
_LINES = f"""lines AS (SELECT doc_id, pos, {J.trim_all('raw')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)),
b AS (SELECT doc_id, pos, line, {_BLOCK_KIND} AS depth FROM lines WHERE line <> '')"""


def _line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks: capitals, section signs and letters in brackets are headings."""
    x = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = I.trim_all(F.col("raw"))
    depth = F.when(line.rlike("^[A-Z][A-Z ,;]+$"), 1).when(line.rlike(r"^(§|Sec\. )"), 3).when(line.rlike(r"^\([a-z]\) "), 4)
    none = F.lit(None).cast("string")
    x = x.select("page", F.col("pos").cast("bigint").alias("pos"), F.when(depth.isNotNull(), "heading").otherwise("paragraph").alias("kind"), depth.alias("depth"), line.alias("text"), none.alias("anchor"), none.alias("label"), F.create_map().cast("map<string,string>").alias("extra"))
    return x.where("text != ''")


@R.query(
    "heading_stack_tree",
    f"""WITH {_LINES}, w AS (SELECT *, {', '.join(f"last_value(CASE WHEN depth = {k} THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s{k}" for k in (1, 3, 4))} FROM b)
    SELECT doc_id, pos, depth, CASE depth WHEN 1 THEN 'chapter' WHEN 3 THEN 'section' ELSE 'subsection' END AS node_kind,
      CASE WHEN depth > 3 AND s3 IS NOT NULL AND s3 > coalesce(s1, -1) THEN s3 WHEN depth > 1 THEN s1 END AS parent_pos FROM w WHERE depth IS NOT NULL""",
)
def heading_stack_tree(spark: SparkSession, d: str) -> DataFrame:
    t = tree.build_tree(_line_blocks(spark, d).withColumn("sub", F.lit(0)))
    return t.where("kind = 'heading'").select(F.col("page").cast("bigint").alias("doc_id"), "pos", "depth", "node_kind", F.col("top.at.pos").alias("parent_pos"))


@R.query(
    "paragraph_fold",
    f"""WITH {_LINES}, w AS (SELECT *, last_value(CASE WHEN depth IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b),
    k AS (SELECT doc_id, pos FROM b WHERE depth IN (3, 4))
    SELECT w.doc_id, w.top AS pos, string_agg(line, chr(10) ORDER BY w.pos) AS body FROM w JOIN k ON k.doc_id = w.doc_id AND k.pos = w.top WHERE depth IS NULL GROUP BY 1, 2""",
)
def paragraph_fold(spark: SparkSession, d: str) -> DataFrame:
    t = tree.build_tree(_line_blocks(spark, d).withColumn("sub", F.lit(0)))
    return tree.fold_paragraphs(t).select(F.col("page").cast("bigint").alias("doc_id"), F.col("at.pos").alias("pos"), "body")


@R.query(
    "extraction_quality",
    rf"""WITH {_LINES}, r AS (SELECT doc_id, sum(len(regexp_extract_all(line, '(?i)§\s*([\w.()-]+)', 1))) AS n FROM b WHERE depth IS NULL GROUP BY 1)
    SELECT b.doc_id, cast(coalesce(count_if(coalesce(depth = 3, false)), 0) AS BIGINT) AS sections, cast(coalesce(any_value(r.n), 0) AS BIGINT) AS cross_references, count_if(coalesce(depth = 3, false)) > 0 AND coalesce(any_value(r.n), 0) > 0 AS viable FROM b LEFT JOIN r ON r.doc_id = b.doc_id GROUP BY 1""",
)
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    t = tree.build_tree(markup.with_references(_line_blocks(spark, d)))
    return tree.quality(t).select(F.col("page").cast("bigint").alias("doc_id"), "sections", "cross_references", "viable")


_SIGN, _WORD, _BARE = tree.SIGN, tree.WORD, tree.BARE


@R.query(
    "split_headings",
    f"""SELECT DISTINCT heading, CASE WHEN regexp_matches(heading, '{_SIGN}') THEN regexp_extract(heading, '{_SIGN}', 1) WHEN regexp_matches(heading, '{_WORD}') THEN regexp_extract(heading, '{_WORD}', 2)
      WHEN regexp_matches(heading, '{_BARE}') THEN regexp_extract(heading, '{_BARE}', 1) ELSE '' END AS label,
    CASE WHEN regexp_matches(heading, '{_SIGN}') THEN {J.trim_all(f"regexp_extract(heading, '{_SIGN}', 2)")} WHEN regexp_matches(heading, '{_WORD}') THEN coalesce(nullif({J.trim_all(f"regexp_extract(heading, '{_WORD}', 3)")}, ''), regexp_extract(heading, '{_WORD}', 1))
      WHEN regexp_matches(heading, '{_BARE}') THEN {J.trim_all(f"regexp_extract(heading, '{_BARE}', 2)")} ELSE heading END AS title FROM toc_nodes WHERE heading IS NOT NULL""",
)
def split_headings(spark: SparkSession, d: str) -> DataFrame:
    p = tree.split_heading(F.col("heading"))
    return table(spark, d, "toc_nodes").where("heading is not null").select("heading", p["label"].alias("label"), p["title"].alias("title")).distinct()


# --- pages of markup to records ---------------------------------------------------------------


def _section_docs(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each edition as documents with paragraphs in markup, as a dump delivers them."""
    s = table(spark, d, "code_sections").groupBy("entity_id").agg(F.max_by(F.struct("code_edition_id", "section_number", "title", "body_text"), F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r")).select("entity_id", "r.*")
    safe = F.replace(F.replace(F.replace("body_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    content = F.concat(F.lit("<p>"), F.array_join(F.filter(F.split(safe, "\n"), lambda x: F.trim(x) != ""), "<p>"))
    return s.select(
        F.col("code_edition_id").alias("page"), F.lit(0).alias("node_ord"), F.lit("body").alias("node_id"), F.lit("Body").alias("node_heading"), F.col("entity_id").alias("doc_ord"),
        F.regexp_replace("entity_id", "[^A-Za-z0-9]", "_").alias("doc_id"), F.concat(F.lit("§ "), I.bare_label(F.coalesce("section_number", F.lit("0"))), F.lit(" — "), "title").alias("title"), content.alias("content"),
    )


def _meta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "code_editions").groupBy("entity_id").agg(F.min_by(F.struct("jurisdiction_tenant", "edition_label", "fetched_at", "source_adapter", "source_url"), F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r"))
    return e.select(
        F.col("entity_id").alias("page"), F.col("r.jurisdiction_tenant").alias("tenant"), F.col("r.jurisdiction_tenant").alias("name"), F.col("r.edition_label").alias("edition_label"), F.lit("").alias("published"), F.col("r.fetched_at").alias("fetched_at"),
        F.col("r.source_adapter").alias("adapter"), F.col("r.source_url").alias("url"), F.lit(None).cast("string").alias("access_policy"),
    )


def _page_tree(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """The tree of each page is written once, as several kinds of record are read off it."""
    blocks = markup.html_blocks(markup.fragments(_section_docs(spark, d), scratch))
    return scratch.save(tree.build_tree(markup.with_references(blocks)), "tree")


@R.query("html_blocks", twins.HTML_BLOCKS)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_blocks(markup.fragments(_section_docs(spark, d), Scratch(spark, "pages"))).select("page", "pos", "kind", "depth", "text", "anchor")


@R.query("page_sections", twins.PAGE_SECTIONS)
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Markup pages to blocks, trees and section records, end to end."""
    return atomize.sections(_page_tree(spark, d, Scratch(spark, "pages")), _meta(spark, d)).select("entity_id", "code_edition_id", "section_number", "title", "subsection_path", "content_hash")


@R.query("page_links", twins.PAGE_LINKS)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "pages")
    t, m = _page_tree(spark, d, scratch), _meta(spark, d)
    secs = atomize.sections(t, m)
    amends = atomize.amendments(t, secs, m)
    return atomize.links(secs, atomize.definitions(t, secs, m), atomize.cross_references(t, secs, m, scratch), amends, atomize.corpora(m))


@R.query("page_editions", twins.PAGE_EDITIONS)
def page_editions(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "pages")
    t, m = _page_tree(spark, d, scratch), _meta(spark, d)
    secs = atomize.sections(t, m)
    return atomize.editions(secs, atomize.amendments(t, secs, m), m).select("entity_id", "effective_from", F.size("section_ids").alias("n_sections"), "content_hash")


@R.query("scan_page_blocks")
def scan_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of paper sources through the page walker, with references."""
    s = table(spark, d, "code_sections").where("source_adapter = 'raw-pdf'").select(F.col("entity_id").alias("page"), F.lit(1).alias("page_no"), F.concat(F.lit("SEC. "), I.bare_label(F.coalesce("section_number", F.lit("0"))), F.lit(" "), F.upper("title"), F.lit("\n"), "body_text").alias("text")).distinct()
    return markup.with_references(pages.page_blocks(s), "page").select("page", "pos", "sub", "kind", "depth", "text", "anchor", "label")


@R.query(
    "line_rebuild",
    """WITH i AS (SELECT user_id AS page, event_id AS item_no, event_type AS s, value AS y FROM events), w AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY page ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM i),
    g AS (SELECT *, sum(CASE WHEN abs(y - py) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY item_no) AS line FROM w),
    l AS (SELECT page, line, string_agg(s, ' ' ORDER BY item_no) AS t FROM g GROUP BY 1, 2) SELECT cast(page AS VARCHAR) AS page, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""",
)
def line_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Lines from positioned items; events stand in for a page's text runs."""
    i = table(spark, d, "events").select(F.col("user_id").cast("string").alias("page"), F.lit(1).alias("page_no"), F.col("event_id").alias("item_no"), F.col("event_type").alias("str"), F.col("value").cast("double").alias("y"))
    return pages.rebuild_lines(i).select("page", "text")


@R.query(
    "toc_walk",
    f"""WITH RECURSIVE n AS (SELECT id, {S.strip_blanks('parent_id')} AS p, doc_order_id, code_edition_id FROM toc_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY {S.instant('fetched_at')} DESC, p DESC NULLS LAST) = 1),
    k AS (SELECT n.*, x.id AS up FROM n LEFT JOIN n x ON x.id = n.p), c AS (SELECT id, 0 AS depth FROM k WHERE up IS NULL UNION ALL SELECT k.id, depth + 1 FROM c JOIN k ON k.up = c.id WHERE depth < 6)
    SELECT c.id, c.depth FROM c WHERE depth = 6 OR NOT EXISTS (SELECT 1 FROM k WHERE k.up = c.id)""",
)
def toc_walk(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at which a walk down the contents stops: leaves, and all at the depth cap. The cap
    bounds the walk, so it is six joins by level."""
    n = table(spark, d, "toc_nodes").select("id", F.struct(T.instant(F.col("fetched_at")).alias("t"), T.strip_blanks(F.col("parent_id")).alias("p")).alias("r")).groupBy("id").agg(F.max("r")["p"].alias("p"))
    ids = n.select(F.col("id").alias("up"))
    k = n.join(ids, F.col("p") == F.col("up"), "left").select("id", "up")
    level = k.where("up is null").select("id", F.lit(0).alias("depth"))
    seen = level
    for i in range(1, 7):
        level = k.join(level.select(F.col("id").alias("up")), "up").select("id", F.lit(i).alias("depth"))
        seen = seen.unionByName(level)
    return seen.join(k.select(F.col("up").alias("has")).where("has is not null").distinct(), F.col("id") == F.col("has"), "left").where("depth = 6 or has is null").select("id", "depth")


@R.query(
    "leaf_cover",
    f"""WITH n AS (SELECT id, {S.strip_blanks('parent_id')} AS p, doc_order_id FROM toc_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY {S.instant('fetched_at')} DESC, p DESC NULLS LAST, doc_order_id DESC NULLS LAST) = 1)
    SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM n k WHERE k.p = n.id) QUALIFY row_number() OVER (PARTITION BY p ORDER BY doc_order_id, id) = 1""",
)
def leaf_cover(spark: SparkSession, d: str) -> DataFrame:
    """Leaves to fetch when one fetch brings all leaves of a parent: the first of each parent. A leaf
    is a node that no node has as its parent; the stated flag is not trusted."""
    x = table(spark, d, "toc_nodes").select("id", F.struct(T.instant(F.col("fetched_at")).alias("t"), T.strip_blanks(F.col("parent_id")).alias("p"), "doc_order_id").alias("r")).groupBy("id").agg(F.max("r").alias("r")).select("id", "r.p", "r.doc_order_id")
    leaves = x.join(x.select(F.col("p").alias("up")).distinct(), F.col("id") == F.col("up"), "left_anti")
    return leaves.groupBy("p").agg(F.min(F.struct("doc_order_id", "id"))["id"].alias("id")).select("id")


# --- model code -------------------------------------------------------------------------------


def _model_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each edition as model-code documents, one chapter per first number."""
    s = table(spark, d, "code_sections").groupBy("entity_id").agg(F.max_by(F.struct("code_edition_id", "section_number", "title", "body_text"), F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r")).select("entity_id", "r.*")
    number = I.bare_label(F.coalesce("section_number", F.lit("0")))
    sec = F.struct(
        F.col("entity_id").alias("sectionId"), number.alias("sectionNumber"), F.col("title").alias("heading"), F.lit(None).cast("string").alias("viewerUrl"),
        F.array(F.struct(F.lit("prose").alias("kind"), F.col("body_text").alias("text"))).alias("content"), F.array(F.struct(F.lower("title").alias("term"), F.col("title").alias("definition"))).alias("definedTerms"),
    )
    chap = s.withColumn("c", F.regexp_extract(number, r"^([A-Za-z]*\d+)", 1)).groupBy("code_edition_id", "c").agg(F.array_sort(F.collect_list(F.struct("entity_id", sec.alias("s")))).alias("l"))
    chap = chap.select("code_edition_id", F.struct("c", F.struct(F.struct(F.col("c").alias("chapterId"), F.col("c").alias("chapterNumber"), F.when(F.col("c") == "2", "Definitions").otherwise("General").alias("heading")).alias("chapter"), F.transform("l", lambda e: e["s"]).alias("sections")).alias("ch")).alias("o"))
    doc = chap.groupBy("code_edition_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda e: e["ch"]).alias("chapters"))
    title = F.struct(F.lit("t").alias("titleId"), F.lit("MC").alias("codeAbbrev"), F.col("code_edition_id").alias("name"), F.lit(2021).alias("year"), F.lit("current").alias("versionStatus"))
    return modelcode.read_documents(doc.select(F.col("code_edition_id").alias("doc"), F.to_json(F.struct(title.alias("title"), "chapters")).alias("body")))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return modelcode.flat_sections(_model_documents(spark, d), "model", "https://codes.example/content/")


@R.query("model_code_sections", twins.MODEL_SECTIONS)
def model_code_sections(spark: SparkSession, d: str) -> DataFrame:
    return modelcode.sections(_flat(spark, d)).select("entity_id", "section_number", "title", "body_text", "verbatim_text_deep_link", "footed", "content_hash")


@R.query("model_code_references", twins.MODEL_REFERENCES)
def model_code_references(spark: SparkSession, d: str) -> DataFrame:
    return modelcode.cross_references(_flat(spark, d), Scratch(spark, "model"))


@R.query("model_code_definitions", twins.MODEL_DEFINITIONS)
def model_code_definitions(spark: SparkSession, d: str) -> DataFrame:
    return modelcode.definitions(_flat(spark, d)).select("entity_id", "term", "definition_text", "defining_section_id", "scope")


@R.query("model_code_blocks", twins.MODEL_BLOCKS)
def model_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return modelcode.blocks(_model_documents(spark, d), Scratch(spark, "model")).select("page", "pos", "kind", "depth", "text", "anchor", "label")


@R.query("model_code_editions", twins.MODEL_EDITIONS)
def model_code_editions(spark: SparkSession, d: str) -> DataFrame:
    docs, viewer = _model_documents(spark, d), "https://codes.example/content/"
    secs = modelcode.sections(modelcode.flat_sections(docs, "model", viewer))
    return modelcode.edition(docs, secs, "model", viewer).select("entity_id", "edition_label", "effective_from", F.size("section_ids").alias("n_sections"), "content_hash")


@R.query("model_code_hook", twins.MODEL_HOOK)
def model_code_hook(spark: SparkSession, d: str) -> DataFrame:
    """Bodies by a hook over the verbatim text, here one that tells its length."""
    hook = lambda b: b["section_number"] + ": " + b["text"].str.len().astype("string") + " characters"
    return modelcode.sections(modelcode.reasoned(_flat(spark, d), hook)).select("entity_id", "body_text")


# --- dumps of a library -----------------------------------------------------------------------

_ORDINANCES = "(?i)ordinances|supplement"


@R.query(
    "product_choice",
    f"""WITH e AS (SELECT entity_id, jurisdiction_tenant, edition_label FROM code_editions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {S.instant('fetched_at')}, content_hash) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction_tenant ORDER BY entity_id) AS k FROM e)
    SELECT jurisdiction_tenant AS client, cast(k AS INT) AS product_id, edition_label AS product_name FROM p WHERE regexp_matches(edition_label, '{_ORDINANCES}') QUALIFY row_number() OVER (PARTITION BY jurisdiction_tenant ORDER BY k) = 1""",
)
def product_choice(spark: SparkSession, d: str) -> DataFrame:
    """Editions of each tenant as a library's product list, and the product that is walked."""
    e = table(spark, d, "code_editions").groupBy("entity_id").agg(F.min_by(F.struct("jurisdiction_tenant", "edition_label"), F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r"))
    l = e.groupBy("r.jurisdiction_tenant").agg(F.array_sort(F.collect_list(F.struct("entity_id", "r.edition_label"))).alias("l"))
    codes = F.transform("l", lambda x, i: F.struct(x["edition_label"].alias("productName"), (i + 1).alias("productId")))
    return dumps.choose_products(l.select(F.col("jurisdiction_tenant").alias("client"), F.to_json(codes).alias("body")), _ORDINANCES)


@R.query("latest_jobs", f"SELECT jurisdiction_tenant AS product_id, report_id AS job_id, edition_entity_id AS name FROM ingest_reports QUALIFY row_number() OVER (PARTITION BY jurisdiction_tenant ORDER BY {S.instant('run_at')} DESC, report_id DESC) = 1")
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "ingest_reports").select(F.col("jurisdiction_tenant").alias("product_id"), F.col("report_id").alias("job_id"), F.col("edition_entity_id").alias("name"), _us("run_at").alias("w"))
    return dumps.latest_jobs(jobs, [F.col("w"), F.col("job_id")])


@R.query(
    "envelope_docs",
    """WITH s AS (SELECT DISTINCT entity_id, code_edition_id, title, body_text FROM code_sections WHERE coalesce(body_text, '') <> '')
    SELECT code_edition_id AS page, entity_id AS doc_id, count(*) AS n, min(length(body_text)) AS least FROM s GROUP BY 1, 2""",
)
def envelope_docs(spark: SparkSession, d: str) -> DataFrame:
    """Content envelopes as JSON, one a distinct text of a section, to documents."""
    s = table(spark, d, "code_sections").select("entity_id", "code_edition_id", "title", "body_text").distinct()
    doc = F.struct(F.col("entity_id").alias("Id"), F.col("title").alias("Title"), F.col("body_text").alias("Content"), F.lit(1).alias("DocOrderId"))
    env = s.select(F.md5(F.concat_ws("|", "entity_id", "body_text", "title")).alias("node_id"), F.concat_ws("#", "code_edition_id", F.md5(F.concat_ws("|", "title", "body_text"))).alias("page"), F.lit(0).alias("node_ord"), F.lit("Body").alias("node_heading"), F.to_json(F.struct(F.array(doc).alias("Docs"))).alias("body"))
    x = dumps.envelope_docs(env)
    return x.groupBy(F.substring_index("page", "#", 1).alias("page"), "doc_id").agg(F.count("*").alias("n"), F.min(F.length("content")).cast("bigint").alias("least"))


@R.query("pages_or_placeholder", "SELECT DISTINCT entity_id AS page, CASE WHEN trim(coalesce(body_text, '')) = '' THEN '<html><body><!-- page unreachable --></body></html>' ELSE body_text END AS html FROM code_sections")
def pages_or_placeholder(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "code_sections").select(F.col("entity_id").alias("page"), F.col("body_text").alias("html"))
    return dumps.with_placeholder(x, "page unreachable").distinct()


@R.query("file_slugs", f"SELECT DISTINCT source_url, {J.file_slug('source_url')} AS slug FROM code_sections WHERE source_url IS NOT NULL")
def file_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_sections").where("source_url is not null").select("source_url", I.file_slug(F.col("source_url")).alias("slug")).distinct()


# --- curated queries --------------------------------------------------------------------------


@R.query(
    "curated_compile",
    f"""WITH x AS (SELECT DISTINCT id, jurisdiction_key AS t, code_book AS b, edition AS e, section_number AS s, section_title AS q FROM legacy_atoms), n AS (SELECT *, row_number() OVER (ORDER BY id, s NULLS FIRST, q NULLS FIRST) AS n FROM x)
    SELECT 'seed-' || t || '-' || b || '-' || n AS query_id, t AS jurisdiction_tenant, q AS query_text, 'did:lex:code-section:' || t || '/' || {J.slug("b || '-' || e")} || '/' || {J.slug(J.normal_label('s'))} AS expected_atom_did, 'retrieval' AS query_type, 'draft' AS status FROM n""",
)
def curated_compile(spark: SparkSession, d: str) -> DataFrame:
    """A draft for each legacy row, asking for its title."""
    x = table(spark, d, "legacy_atoms").select("id", F.col("jurisdiction_key").alias("tenant"), F.col("code_book").alias("book"), "edition", "section_number", F.col("section_title").alias("query_text"), F.lit(None).cast("string").alias("query_type")).distinct()
    return curated.compile_drafts(x, ["id", "section_number", "query_text"], Scratch(spark, "curated"))


@R.query(
    "curated_author",
    """WITH h AS (SELECT DISTINCT jurisdiction_tenant, id, heading FROM toc_nodes WHERE heading IS NOT NULL) SELECT jurisdiction_tenant, count(*) AS generated, count(*) AS upserted, count(*) AS awaiting_review FROM h WHERE length(heading) >= 12 GROUP BY 1""",
)
def curated_author(spark: SparkSession, d: str) -> DataFrame:
    """Drafts by a hook that asks for every heading of twelve characters or more."""

    def ask(lines):
        lines = lines[lines["heading"].str.len() >= 12]
        return lines.assign(query_text="Where is: " + lines["heading"], query_type="retrieval")

    x = table(spark, d, "toc_nodes").where("heading is not null").select(F.col("jurisdiction_tenant").alias("tenant"), "id", "heading").distinct()
    x = x.select("tenant", F.xxhash64("id", "heading").alias("line_no"), "heading")
    return curated.author_counts(curated.author(x, ask, True, Scratch(spark, "author")))


@R.query("shares_of", "SELECT 'd' || event_id AS did, 'u' || user_id AS from_user_did, 'u' || (event_id % 97) AS to_user_did FROM events WHERE user_id = 5 OR event_id % 97 = 5")
def shares_of(spark: SparkSession, d: str) -> DataFrame:
    """Edges with a user on either side; events stand in for shares."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = table(spark, d, "events").select(text("d", F.col("event_id")).alias("did"), F.lit("w").alias("workspace_did"), text("u", F.col("user_id")).alias("from_user_did"), text("u", F.col("event_id") % 97).alias("to_user_did"), F.col("ts").alias("shared_at"))
    return graph.shares(e, "w", "u5").select("did", "from_user_did", "to_user_did")


# --- migration --------------------------------------------------------------------------------

_EDITION = f"jurisdiction_key || '/' || {J.slug("code_book || '-' || edition")}"
_LEGACY = f"""lg AS (SELECT a.*, {_EDITION} AS ed, ({_EDITION}) || '/' || {J.slug(J.normal_label('section_number'))} AS eid, 'legacy/' || coalesce(s.source_name, 'unknown') AS adapter
  FROM (SELECT DISTINCT id, source_id, jurisdiction_key, code_book, edition, section_number, section_title, body, source_url, fetched_at FROM legacy_atoms) a LEFT JOIN legacy_sources s ON s.id = a.source_id
  WHERE coalesce({J.trim_all('section_number')}, '') <> '' AND coalesce({J.trim_all('body')}, '') <> '')"""


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "legacy_atoms").select("id", "source_id", "jurisdiction_key", "code_book", "edition", "section_number", "section_title", "body", "source_url", "fetched_at").distinct()
    return migrate.transform(rows, table(spark, d, "legacy_sources"))


@R.query(
    "legacy_transform",
    f"""WITH {_LEGACY} SELECT id AS legacy_id, eid AS entity_id, ed AS code_edition_id, adapter AS source_adapter, coalesce(section_title, '') AS title,
      {J.content_hash("'code-section'", "eid", "section_number", "section_title", "''", "body")} AS content_hash FROM lg""",
)
def legacy_transform(spark: SparkSession, d: str) -> DataFrame:
    return _legacy(spark, d).select("legacy_id", "entity_id", "code_edition_id", "source_adapter", "title", "content_hash")


@R.query("legacy_earliest", f"WITH {_LEGACY} SELECT eid AS entity_id, id AS legacy_id FROM lg QUALIFY row_number() OVER (PARTITION BY eid ORDER BY fetched_at, id) = 1")
def legacy_earliest(spark: SparkSession, d: str) -> DataFrame:
    x = _legacy(spark, d).select("entity_id", "legacy_id", "fetched_at")
    return store.keep_first(x, ["entity_id"], [F.col("fetched_at"), F.col("legacy_id")]).select("entity_id", "legacy_id")


@R.query(
    "collision_log",
    f"""WITH {_LEGACY}, x AS (SELECT eid, id, epoch_us(fetched_at) AS f, row_number() OVER (PARTITION BY eid ORDER BY id, fetched_at) AS n FROM lg),
    y AS (SELECT *, min((f, n, id)) OVER (PARTITION BY eid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now, min((f, n, id)) OVER (PARTITION BY eid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM x)
    SELECT eid AS entity_id, now[3] AS kept_id, CASE WHEN now = was THEN id ELSE was[3] END AS dropped_id FROM y WHERE n > 1""",
)
def collision_log(spark: SparkSession, d: str) -> DataFrame:
    x = _legacy(spark, d).select("entity_id", "legacy_id", "fetched_at")
    return store.collision_log(x, "entity_id", "legacy_id", [F.col("legacy_id"), F.col("fetched_at")], [F.col("fetched_at")])


@R.query(
    "legacy_drop_counts",
    f"""SELECT cast(count_if(coalesce({J.trim_all('section_number')}, '') = '') AS BIGINT) AS dropped_null_section, cast(count_if(coalesce({J.trim_all('section_number')}, '') <> '' AND coalesce({J.trim_all('body')}, '') = '') AS BIGINT) AS dropped_empty_body,
      cast(count_if(coalesce({J.trim_all('section_number')}, '') <> '' AND coalesce({J.trim_all('body')}, '') <> '') AS BIGINT) AS kept FROM legacy_atoms""",
)
def legacy_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return migrate.drop_counts(table(spark, d, "legacy_atoms"))


@R.query(
    "legacy_run_report",
    twins.run_report("legacy_rows AS (SELECT DISTINCT id, source_id, jurisdiction_key, code_book, edition, section_number, section_title, body, source_url, fetched_at FROM legacy_atoms), " + _LEGACY),
)
def legacy_run_report(spark: SparkSession, d: str) -> DataFrame:
    """A whole migration and its report."""
    rows = table(spark, d, "legacy_atoms").select("id", "source_id", "jurisdiction_key", "code_book", "edition", "section_number", "section_title", "body", "source_url", "fetched_at").distinct()
    return migrate.run(rows, table(spark, d, "legacy_sources"), Scratch(spark, "migration"))["report"]


_EDITIONS = f"""ed AS (SELECT jurisdiction_key AS t, ed, count(*) AS n, min(fetched_at) AS lo, max(fetched_at) AS hi, arg_min(adapter, (fetched_at, id)) AS adapter, min((fetched_at, id)) AS first, string_agg(eid, '' ORDER BY fetched_at, id) AS ids,
  max(edition) AS label FROM lg GROUP BY 1, 2)"""


def _editions(spark: SparkSession, d: str) -> DataFrame:
    x = _legacy(spark, d)
    labels = table(spark, d, "legacy_atoms").select(F.concat("jurisdiction_key", F.lit("/"), I.slug(F.concat_ws("-", "code_book", "edition"))).alias("le"), F.col("edition").alias("label")).groupBy("le").agg(F.max("label").alias("label"))
    e = migrate.edition_rollup(x, [F.col("fetched_at"), F.col("legacy_id")]).drop("edition_label", "content_hash").join(labels, F.col("code_edition_id") == F.col("le"))
    return e.withColumn("content_hash", I.content_hash(F.lit("code-edition"), F.col("code_edition_id"), F.col("label"), F.array_join("section_ids", "")))


@R.query(
    "edition_rollup",
    f"""WITH {_LEGACY}, {_EDITIONS} SELECT ed AS code_edition_id, n AS n_sections, adapter AS source_adapter, {J.effective_from('label', "strftime(lo AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')")} AS effective_from,
      {J.content_hash("'code-edition'", "ed", "label", "ids")} AS content_hash FROM ed""",
)
def edition_rollup(spark: SparkSession, d: str) -> DataFrame:
    since = I.effective_from(F.col("label"), F.date_format("earliest", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _editions(spark, d).select("code_edition_id", "n_sections", "source_adapter", since.alias("effective_from"), "content_hash")


@R.query(
    "corpus_rollup",
    f"""WITH {_LEGACY}, {_EDITIONS} SELECT t AS jurisdiction_tenant, count(*) AS n_editions, arg_max(ed, first) AS current_edition_id, arg_min(adapter, (-epoch_us(hi), first)) AS source_adapter, string_agg(ed, ' ' ORDER BY first) AS editions FROM ed GROUP BY 1""",
)
def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    return migrate.corpus_rollup(_editions(spark, d)).select("jurisdiction_tenant", "n_editions", "current_edition_id", "source_adapter", F.array_join("adopted_edition_ids", " ").alias("editions"))


@R.query(
    "coverage_report",
    """SELECT a.jurisdiction_key, a.code_book, a.edition, s.source_name, count(*) AS n_atoms, cast(count_if(length(a.body) > 0) AS BIGINT) AS with_body, cast(count_if(a.body_html IS NOT NULL) AS BIGINT) AS with_body_html,
      cast(count_if(a.embedding IS NOT NULL) AS BIGINT) AS with_embedding, epoch_us(min(a.fetched_at)) AS earliest, epoch_us(max(a.fetched_at)) AS latest FROM legacy_atoms a JOIN legacy_sources s ON s.id = a.source_id GROUP BY 1, 2, 3, 4""",
)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "legacy_atoms").join(table(spark, d, "legacy_sources").select(F.col("id").alias("source_id"), "source_name"), "source_id")
    return a.groupBy("jurisdiction_key", "code_book", "edition", "source_name").agg(
        F.count("*").alias("n_atoms"), F.count_if(F.length("body") > 0).alias("with_body"), F.count("body_html").alias("with_body_html"), F.count("embedding").alias("with_embedding"),
        F.unix_micros(F.min("fetched_at")).alias("earliest"), F.unix_micros(F.max("fetched_at")).alias("latest"),
    )


@R.query(
    "section_samples",
    """SELECT jurisdiction_key, code_book, section_number, row_number() OVER (PARTITION BY jurisdiction_key, code_book ORDER BY section_number, id, fetched_at) AS place FROM legacy_atoms WHERE section_number IS NOT NULL QUALIFY place <= 25""",
)
def section_samples(spark: SparkSession, d: str) -> DataFrame:
    """First 25 section numbers of each book, in one pass."""
    w = Window.partitionBy("jurisdiction_key", "code_book").orderBy("section_number", "id", "fetched_at")
    x = table(spark, d, "legacy_atoms").where("section_number is not null").select("jurisdiction_key", "code_book", "section_number", F.row_number().over(w).alias("place"))
    return x.where("place <= 25").withColumn("place", F.col("place").cast("bigint"))


@R.query("xref_records", twins.XREF_RECORDS)
def xref_records(spark: SparkSession, d: str) -> DataFrame:
    """References in bodies as records, with context, kind and link, numbered within their edition.
    References that ingestion kept are bodies of their own, with their context."""
    us = _us("fetched_at")
    s = table(spark, d, "code_sections").groupBy("entity_id").agg(F.max_by(F.struct("code_edition_id", "section_number", "body_text"), F.struct(us, F.col("content_hash"))).alias("r"), F.min(us).alias("seq"))
    own = F.concat(F.lit("xref/"), F.col("xref_id").cast("string")).alias("entity_id")
    c = table(spark, d, "cross_refs").groupBy(own, "code_edition_id", F.concat_ws(": ", "reference_text", "reference_context").alias("body_text")).agg(F.min(us).alias("seq"))
    bodies = s.select("entity_id", "r.*", "seq").unionByName(c.withColumn("section_number", F.lit(None).cast("string")))
    return references.sniff(bodies, Scratch(spark, "references"))[0]


@R.query("legacy_sources_by_name", "SELECT id, source_name, label, source_type, license_type FROM legacy_sources ORDER BY source_name")
def legacy_sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legacy_sources").select("id", "source_name", "label", "source_type", "license_type").orderBy("source_name")


@R.query(
    "legacy_probe",
    r"""SELECT id, section_number, section_title FROM legacy_atoms WHERE regexp_matches(section_title, 'setback|use district|zoning', 'i') OR (regexp_matches(section_number, '^1-|^UDC', 'i') AND NOT regexp_matches(section_title, 'charter|amendment', 'i'))
      ORDER BY section_number NULLS LAST, id, fetched_at LIMIT 50""",
)
def legacy_probe(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "legacy_atoms")
    hit = F.col("section_title").rlike("(?i)setback|use district|zoning") | (F.col("section_number").rlike("(?i)^1-|^UDC") & ~F.col("section_title").rlike("(?i)charter|amendment"))
    return x.where(hit).orderBy(F.asc_nulls_last("section_number"), "id", "fetched_at").limit(50).select("id", "section_number", "section_title")


# --- folds, nesting, validation, summaries ----------------------------------------------------


@R.query(
    "event_fold",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, arg_max(event_type, n) AS event_type, arg_max(value, n) FILTER (WHERE value IS NOT NULL) AS value, strftime(min(ts) FILTER (WHERE event_type = 'view'), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n_events FROM e GROUP BY 1""",
)
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    x = fold.fold_events(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", ["value"], F.col("event_type") == "view", F.col("event_type") == "purchase")
    return x.select("user_id", "event_type", "value", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "ended")), "n_events")


@R.query(
    "event_transitions",
    """WITH e AS (SELECT user_id, event_id, event_type AS to_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
    SELECT user_id, event_id, from_state, to_state FROM e WHERE from_state IS NOT NULL AND NOT (from_state = 'view' OR (from_state = 'click' AND to_state = 'purchase'))""",
)
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Steps of users that are not in a table of legal ones."""
    kinds = table(spark, d, "events").select(F.lit("view").alias("from_state"), F.col("event_type").alias("to_state")).distinct()
    legal = kinds.unionByName(spark.createDataFrame([("click", "purchase")], "from_state string, to_state string")).distinct()
    x = fold.illegal_transitions(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", legal)
    return x.select("user_id", "event_id", "from_state", "to_state")


@R.query("roll_up_by_key", "SELECT user_id, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def roll_up_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@R.query(
    "nested_package",
    """WITH l AS (SELECT l_orderkey, string_agg(l_partkey || 'x' || cast(l_quantity AS BIGINT), ',' ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_quantity) AS lines, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def nested_package(spark: SparkSession, d: str) -> DataFrame:
    """Parents with their children nested and sorted, newest first."""
    o = table(spark, d, "orders").select("o_orderkey")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", "l_shipdate", "l_linenumber")
    x = fold.nest(o, "o_orderkey", lines=(l, [-F.unix_date("l_shipdate") if dict(l.dtypes)["l_shipdate"] == "date" else -F.unix_micros(F.col("l_shipdate").cast("timestamp")), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]))
    text = F.transform("lines", lambda e: F.concat(e["l_partkey"].cast("string"), F.lit("x"), e["l_quantity"].cast("bigint").cast("string")))
    return x.select("o_orderkey", F.size("lines").cast("bigint").alias("n_lines"), F.array_join(text, ",").alias("lines"))


@R.query(
    "recent_of_owner",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
)
def recent_of_owner(spark: SparkSession, d: str) -> DataFrame:
    """Newest parents that a party owns or takes part in."""
    part = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("k")).distinct().withColumn("in", F.lit(True))
    o = table(spark, d, "orders").join(part, F.col("o_orderkey") == F.col("k"), "left").where((F.col("o_custkey") == 7) | F.col("in"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


def _errors_sql(kind: str, more: str = "") -> str:
    empty = ", ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '{c} is empty' END" for c in validate.REQUIRED[kind])
    return f"array_to_string(list_filter([{empty}{more}], lambda x: x IS NOT NULL), '; ') AS errors"


def _errors(spark: SparkSession, d: str, name: str, kind: str, key: str, **more) -> DataFrame:
    return validate.validate(table(spark, d, name), validate.rules_for(kind) | {f"{c} is empty": rule for c, rule in more.items()}).select(key, F.array_join("errors", "; ").alias("errors")).distinct()


_NO_ADDRESS = "CASE WHEN {c} IS NOT NULL AND NOT regexp_matches({c}, '^https?://[^\\s/]+') THEN '{n} is no address' END"


@R.query(
    "validate_sections",
    "SELECT DISTINCT entity_id, "
    + _errors_sql("code-section", ", " + ", ".join((_NO_ADDRESS.format(c="source_url", n="source_url"), "CASE WHEN try_cast(fetched_at AS TIMESTAMPTZ) IS NULL THEN 'fetched_at is no time' END", _NO_ADDRESS.format(c="verbatim_text_deep_link", n="deep link"), "CASE WHEN coalesce(body_text, '') = '' THEN 'body_text is empty' END")))
    + " FROM code_sections",
)
def validate_sections(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "code_sections", "code-section", "entity_id", body_text=validate.filled("body_text"))


@R.query("validate_editions", "SELECT DISTINCT entity_id, " + _errors_sql("code-edition") + " FROM code_editions")
def validate_editions(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "code_editions", "code-edition", "entity_id")


@R.query(
    "validate_references",
    "SELECT DISTINCT xref_id, " + _errors_sql("code-cross-reference", ", CASE WHEN coalesce(reference_type NOT IN (" + ", ".join(f"'{t}'" for t in validate.REFERENCE_TYPES) + "), true) THEN 'reference_type is unknown' END") + " FROM cross_refs",
)
def validate_references(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "cross_refs", "code-cross-reference", "xref_id")


@R.query(
    "context_summary",
    """SELECT DISTINCT entity_id, coalesce(section_number, '') || ' ' || coalesce(title, '') || '. ' || coalesce(body_text, '') AS prose, entity_id || '@' || content_hash AS provenance FROM code_sections
    UNION ALL SELECT DISTINCT 'xref/' || xref_id, trim(upper(coalesce(reference_type, '')) || ': ' || coalesce(reference_text, '') || ' ' || coalesce(reference_context, ''), ' '), 'xref/' || xref_id || '@' || report_id FROM cross_refs""",
)
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    s = summaries.summarize(table(spark, d, "code_sections"), "code-section")
    x = summaries.summarize(table(spark, d, "cross_refs").withColumn("entity_id", F.concat(F.lit("xref/"), F.col("xref_id").cast("string"))).withColumn("content_hash", F.col("report_id")), "code-cross-reference")
    return s.unionByName(x).select("entity_id", "prose", "provenance").distinct()


@R.query("context_summary_user", "SELECT DISTINCT entity_id, coalesce(section_number, '') || ' ' || coalesce(title, '') AS prose, true AS scope_filtered FROM code_sections")
def context_summary_user(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summarize(table(spark, d, "code_sections"), "code-section", "user").select("entity_id", "prose", "scope_filtered").distinct()
