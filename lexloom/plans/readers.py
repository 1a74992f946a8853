"""Queries of readers, walkers, summaries and small record operators on inputs made from the tables,
so that SQL can say what they must give back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.functions import text as T
from lexloom.operators import migrate, search, store, summaries, validate
from lexloom.plans import Registry
from lexloom.sources import files, markup, pages
from lexloom.tables import table

R = Registry()
S, J = T.sql, I.sql
_WRITTEN = S.instant("fetched_at")


def _us(c: str):
    return F.expr(f"unix_micros(try_cast({c} as timestamp))")


def _safe(c) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """The last written row of each section."""
    held = F.struct("code_edition_id", "section_number", "title", "body_text")
    return table(spark, d, "code_sections").groupBy("entity_id").agg(F.max_by(held, F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r")).select("entity_id", "r.*")


_CUR = f"""cur AS (SELECT entity_id, code_edition_id, section_number, title, body_text FROM code_sections
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC, content_hash DESC) = 1)"""


def _editions(spark: SparkSession, d: str) -> DataFrame:
    held = F.struct("jurisdiction_tenant", "edition_label", "effective_from", "effective_to", "content_hash")
    return table(spark, d, "code_editions").groupBy("entity_id").agg(F.min_by(held, F.struct(_us("fetched_at"), F.col("content_hash"))).alias("r")).select("entity_id", "r.*")


_EDS = f"""eds AS (SELECT entity_id, jurisdiction_tenant, edition_label, effective_from, effective_to, content_hash FROM code_editions
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN}, content_hash) = 1)"""

# --- markup -----------------------------------------------------------------------------------


@R.query("discover_codes", f"""WITH {_EDS} SELECT entity_id AS source_id, {J.slug("edition_label || '-tx'")} AS jurisdiction_tenant, edition_label, 'https://library.example/codes/' || entity_id || '/' AS source_url FROM eds""")
def discover_codes(spark: SparkSession, d: str) -> DataFrame:
    """Index pages, one a tenant, with a link to each edition and one to elsewhere."""
    link = F.concat(F.lit('<li><a href="/codes/'), "entity_id", F.lit('/">'), _safe(F.col("edition_label")), F.lit('</a><a href="/about/">More</a>'))
    index = _editions(spark, d).groupBy("jurisdiction_tenant").agg(F.array_join(F.collect_list(link), "").alias("html"))
    return markup.discover(index, "https://library.example", "TX")


@R.query("page_metadata", f"""WITH {_EDS} SELECT entity_id AS page, coalesce(effective_from, '') AS publication_date, jurisdiction_tenant AS jurisdiction_name FROM eds""")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = lambda name, c: F.concat(F.lit(f'<meta name="{name}" content="'), _safe(F.coalesce(c, F.lit(""))), F.lit('">'))
    html = F.concat(F.lit("<html><head>"), meta("publication-date", "effective_from"), meta("jurisdiction-name", "jurisdiction_tenant"), F.lit("</head><p>Text"))
    return markup.page_metadata(_editions(spark, d).select(F.col("entity_id").alias("page"), html.alias("html")))


_LINES = f"""l AS (SELECT entity_id, line, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS k FROM (SELECT entity_id, {J.trim_all('raw')} AS line, i FROM (
    SELECT entity_id, unnest(string_split(body_text, chr(10))) AS raw, generate_subscripts(string_split(body_text, chr(10)), 1) AS i FROM cur WHERE title <> '' AND body_text IS NOT NULL)) WHERE line <> '')"""


@R.query(
    "section_pages",
    f"""WITH {_CUR}, {_LINES} SELECT entity_id AS page, cast(0 AS BIGINT) AS pos, 'heading' AS kind, 3 AS depth, {J.trim_all('title')} AS text, '#' || md5(entity_id) AS anchor FROM cur WHERE title <> '' AND body_text IS NOT NULL
    UNION ALL SELECT entity_id, k, 'paragraph', NULL, line, NULL FROM l""",
)
def section_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the layout of sections with a heading and a body."""
    body = F.array_join(F.transform(F.split(_safe(F.col("body_text")), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = F.concat(F.lit('<div class="section" id="'), F.md5("entity_id"), F.lit('"><div class="heading">'), _safe(F.col("title")), F.lit('</div><div class="body">'), body, F.lit("</div></div>"))
    x = _sections(spark, d).where("title != ''").select(F.col("entity_id").alias("page"), html.alias("html"))
    return markup.html_blocks(x, "section").select("page", "pos", "kind", "depth", "text", "anchor")


# --- paper ------------------------------------------------------------------------------------


@R.query(
    "extract_pages",
    f"""WITH {_CUR}, p AS (SELECT entity_id, body_text, string_split(body_text, chr(12)) AS t FROM cur WHERE body_text IS NOT NULL), o AS (SELECT entity_id, CASE WHEN {J.trim_all("replace(body_text, chr(12), '')")} = '' THEN ['read by eye'] ELSE t END AS t FROM p WHERE NOT starts_with(body_text, '(a)'))
    SELECT entity_id AS page, cast(generate_subscripts(t, 1) AS INT) AS page_no, unnest(t) AS text, cast(NULL AS VARCHAR) AS error FROM o UNION ALL SELECT entity_id, 0, NULL, 'ValueError: lettered' FROM p WHERE starts_with(body_text, '(a)')""",
)
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as files whose pages are set apart by form feeds; some cannot be read."""

    def read(content: bytes) -> list[str]:
        text = bytes(content).decode()
        if text.startswith("(a)"):
            raise ValueError("lettered")
        return text.split("\f")

    x = _sections(spark, d).select(F.col("entity_id").alias("path"), F.col("body_text").cast("binary").alias("content"))
    return files.extract_pages(x, read, lambda content: "read by eye")


_TITLE = "regexp_replace(coalesce(nullif({t}, ''), 'Untitled'), '[^A-Za-z ]+', ' ', 'g')"
_NUM = "cast(1 + length(entity_id) % 20 AS VARCHAR)"


def _paper(spark: SparkSession, d: str) -> DataFrame:
    """Sections with a title of plain letters and a number from 1 to 20."""
    title = F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")), "[^A-Za-z ]+", " ")
    return _sections(spark, d).select(F.col("entity_id").alias("page"), F.trim(F.regexp_replace(title, " +", " ")).alias("title"), (1 + F.length("entity_id") % 20).cast("string").alias("n"))


_PAPER = f"paper AS (SELECT entity_id AS page, trim(regexp_replace({_TITLE.format(t='title')}, ' +', ' ', 'g')) AS title, {_NUM} AS n FROM cur)"


def _walked(spark: SparkSession, d: str, texts: list, convention: str) -> DataFrame:
    x = _paper(spark, d)
    every = None
    for i, text in enumerate(texts):
        one = x.select("page", F.lit(i + 1).alias("page_no"), F.array_join(F.array(*text), "\n").alias("text"))
        every = one if every is None else every.unionByName(one)
    return pages.page_blocks(every, convention).select("page", "pos", "kind", "depth", "text", "anchor", "label")


def _walk_sql(rows: list[tuple[str, ...]]) -> str:
    parts = [f"SELECT page, cast({i} AS BIGINT) AS pos, '{kind}' AS kind, cast({depth} AS INT) AS depth, {text} AS text, {anchor} AS anchor, {label} AS label FROM paper" for i, (kind, depth, text, anchor, label) in enumerate(rows)]
    return f"WITH {_CUR}, {_PAPER} " + " UNION ALL ".join(parts)


@R.query(
    "capital_pages",
    _walk_sql([
        ("heading", "1", "'Chapter ' || n || ' GENERAL'", "'#p1-chapter-' || n", "NULL"), ("heading", "2", "'Article ' || n || '.1 SCOPE AND REACH'", "'#p1-article-' || n || '-1'", "NULL"),
        ("heading", "3", "'Sec. ' || n || '.1.001 ' || upper(title)", "'#p1-section-' || n || '-1-001'", "NULL"), ("paragraph", "NULL", "'First rule on ' || title || '.'", "NULL", "'(a)'"), ("paragraph", "NULL", "'Under it.'", "NULL", "'(a)(1)'"),
        ("paragraph", "NULL", "'plain words go on'", "NULL", "'(a)'"), ("heading", "3", "'Sec. ' || n || '.1.002 NEXT'", "'#p2-section-' || n || '-1-002'", "NULL"), ("paragraph", "NULL", "'last words'", "NULL", "NULL"),
    ]),
)
def capital_pages(spark: SparkSession, d: str) -> DataFrame:
    """Headings in capitals: contents lines, a wrapped title, repeated running headers, subsections."""
    t = lambda *p: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(p)))
    one = [
        t("CHAPTER ", "n", " GENERAL"), F.lit("1 of 2"), t("CHAPTER ", "n", " GENERAL"), t("SEC. ", "n", ".1.009 LISTED 12"), t("ARTICLE ", "n", ".1 SCOPE"), F.lit("AND REACH"), F.concat(F.lit("SEC. "), "n", F.lit(".1.001 "), F.upper("title")),
        t("(a) First rule on ", "title", "."), F.lit("(1) Under it."), F.lit("plain words go on"),
    ]
    two = [t("CHAPTER ", "n", " GENERAL"), F.lit("2 of 2"), t("CHAPTER ", "n", " GENERAL"), t("SEC. ", "n", ".1.002 NEXT"), F.lit("last words")]
    return _walked(spark, d, [one, two], "caps-prefixed")


@R.query(
    "decimal_pages",
    _walk_sql([
        ("heading", "1", "'Chapter ' || n || ' Rules'", "'#p2-chapter-' || n", "NULL"), ("heading", "3", "'10.101 ' || title", "'#p2-section-10-101'", "NULL"), ("paragraph", "NULL", "'Body text.'", "NULL", "NULL"), ("paragraph", "NULL", "'More of it.'", "NULL", "NULL"),
        ("heading", "1", "'Chapter 99 Next'", "'#p3-chapter-99'", "NULL"), ("paragraph", "NULL", "'Last.'", "NULL", "NULL"),
    ]),
)
def decimal_pages(spark: SparkSession, d: str) -> DataFrame:
    """Decimal numbers: a contents page before the first chapter, chapters told by running headers."""
    t = lambda *p: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(p)))
    one = [F.lit("Contents"), t("10.101 ", "title", " 4"), F.lit("10.102 Other 5")]
    two = [t("Chapter ", "n", " Rules § 10.101"), t("10.101 ", "title"), F.lit("Body text."), F.lit("17")]
    three = [t("Chapter ", "n", " Rules § 10.2"), F.lit("More of it."), F.lit("Chapter 99 Next § 1"), F.lit("Last.")]
    return _walked(spark, d, [one, two, three], "decimal-numbered")


@R.query(
    "chapter_pages",
    _walk_sql([
        ("heading", "1", "'Chapter ' || n || ' GENERAL'", "'#p2-chapter-' || n", "NULL"), ("heading", "3", "n || '.1 ' || title", "'#p2-section-' || n || '-1'", "NULL"), ("paragraph", "NULL", "'2.5 acres'", "NULL", "NULL"), ("paragraph", "NULL", "'Words.'", "NULL", "NULL"),
        ("heading", "1", "'Chapter 99 NEXT'", "'#p3-chapter-99'", "NULL"), ("heading", "3", "'99.1 More'", "'#p3-section-99-1'", "NULL"),
    ]),
)
def chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chapter and decimal: a contents page, page numbers, and quantities that look like numbers."""
    t = lambda *p: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(p)))
    one = [F.lit("TABLE OF CONTENTS"), t("", "n", ".1 Scope 2"), t("CHAPTER ", "n", " - GENERAL 2")]
    two = [t("CHAPTER ", "n", " - GENERAL"), F.concat("n", F.lit(".1 "), "title"), F.lit("1 - 3"), F.lit("2.5 acres"), F.lit("Words.")]
    return _walked(spark, d, [one, two, [F.lit("CHAPTER 99 - NEXT"), F.lit("99.1 More")]], "chapter-decimal")


@R.query(
    "page_ranges",
    r"""SELECT DISTINCT section_number, CASE WHEN a <> '' THEN try_cast(a AS INT) ELSE 1 END AS first, CASE WHEN b <> '' THEN try_cast(b AS INT) WHEN a <> '' THEN try_cast(a AS INT) ELSE 3 END AS last
      FROM (SELECT section_number, regexp_extract(section_number, '^\s*(\d+)\s*(?:-\s*\d+\s*)?$', 1) AS a, regexp_extract(section_number, '^\s*\d+\s*-\s*(\d+)\s*$', 1) AS b FROM code_sections)""",
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = migrate.page_range(F.col("section_number"))
    return table(spark, d, "code_sections").select("section_number", p["first"].alias("first"), p["last"].alias("last")).distinct()


@R.query("ingest_units", "SELECT source_adapter AS unit_id, count(*) AS n_rows, count(DISTINCT entity_id) AS n_sections FROM code_sections GROUP BY 1")
def ingest_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by source; one of them has no rows and one fails, which stops none of the others."""
    s = table(spark, d, "code_sections")
    of = lambda name: lambda: s.where(F.col("source_adapter") == name)
    units = {name: of(name) for name in ("ecode360-html", "municode-json", "municode-html", "raw-pdf", "nothing")} | {"broken": lambda: s.select("no such column")}
    got, _ = migrate.run_units(units)
    return got.groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_sections"))


# --- records ----------------------------------------------------------------------------------


@R.query(
    "review_updates",
    """SELECT query_id, CASE WHEN length(query_id) % 2 = 0 THEN 'approved' ELSE status END AS status, CASE WHEN length(query_id) % 2 = 0 AND query_type = 'retrieval' THEN 'reviewer' ELSE human_reviewed_by END AS human_reviewed_by,
      CASE WHEN length(query_id) % 2 = 0 AND query_type = 'retrieval' THEN '2024-01-01' END AS human_reviewed_at FROM curated_queries""",
)
def review_updates(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "curated_queries").withColumn("human_reviewed_at", F.lit(None).cast("string"))
    retrieval = F.col("query_type") == "retrieval"
    u = q.where("length(query_id) % 2 = 0").select("query_id", F.lit("approved").alias("status"), F.when(retrieval, "reviewer").alias("reviewer"), F.when(retrieval, "2024-01-01").alias("reviewed_at")).distinct()
    return store.set_status(q, u, "query_id").select("query_id", "status", "human_reviewed_by", "human_reviewed_at")


_KINDS = ", ".join(f"'{t}'" for t in validate.REFERENCE_TYPES)


@R.query("missing_kinds", f"SELECT code_edition_id, array_to_string(list_filter([{_KINDS}], lambda k: NOT list_contains(list(reference_type), k)), ' ') AS missing FROM cross_refs GROUP BY 1")
def missing_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of reference that the references of an edition lack."""
    x = table(spark, d, "cross_refs").groupBy("code_edition_id").agg(F.transform(F.collect_set("reference_type"), lambda k: F.struct(k.alias("kind"))).alias("held"))
    return x.select("code_edition_id", F.array_join(validate.missing_kinds(F.col("held"), validate.REFERENCE_TYPES), " ").alias("missing"))


_TEXT = "coalesce(cast({} AS VARCHAR), '')"
_OPS = "CASE event_type WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'add' END"
_SCOPE = f"CASE WHEN user_id % 2 = 0 THEN 'jurisdictional overlay (' || {_OPS} || ')' ELSE 'temporal amendment' END"


@R.query(
    "context_summary_kinds",
    f"""WITH {_EDS}, {_CUR}, n AS (SELECT code_edition_id, count(*) AS n FROM cur GROUP BY 1),
    e AS (SELECT eds.*, n.n FROM eds LEFT JOIN n ON n.code_edition_id = eds.entity_id), c AS (SELECT jurisdiction_tenant AS t, count(*) AS n, max(entity_id) AS cur_id, min(content_hash) AS h FROM eds GROUP BY 1),
    t AS (SELECT DISTINCT id, heading FROM toc_nodes)
    SELECT 'edition/' || entity_id AS entity_id, edition_label || ' — ' || {_TEXT.format('n')} || ' sections, effective from ' || {_TEXT.format('effective_from')} || coalesce(' to ' || effective_to, '') || '.' AS prose, edition_label AS compact FROM e
    UNION ALL SELECT 'corpus/' || t, t || ' — ' || n || ' editions, current: ' || cur_id || '. Quality bar: not-evaluated.', t FROM c
    UNION ALL SELECT 'term/' || id || '/' || {_TEXT.format('heading')}, {_TEXT.format('heading')} || ' — means ' || {_TEXT.format('heading')}, {_TEXT.format('heading')} FROM t
    UNION ALL SELECT 'ordinance/' || event_id, 'Ordinance ' || event_id || ' — ' || {_SCOPE} || ', effective ' || strftime(ts, '%Y-%m-%d') || ', council. ' || event_type, 'Ordinance ' || event_id || ' (' || {_SCOPE} || ')' FROM events""",
)
def context_summary_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of editions, corpora, definitions and amendments for both audiences."""
    e, s = _editions(spark, d), _sections(spark, d)
    n = s.groupBy(F.col("code_edition_id").alias("ne")).agg(F.count("*").alias("n_sections"))
    own = lambda p, c: F.concat(F.lit(p), c)
    editions = e.join(n, F.col("entity_id") == F.col("ne"), "left").withColumn("entity_id", own("edition/", F.col("entity_id")))
    corpora = e.groupBy("jurisdiction_tenant").agg(F.count("*").alias("n_editions"), F.max("entity_id").alias("current_edition_id"), F.min("content_hash").alias("content_hash")).select(
        own("corpus/", F.col("jurisdiction_tenant")).alias("entity_id"), F.col("jurisdiction_tenant").alias("jurisdiction_name"), "n_editions", "current_edition_id", F.lit("not-evaluated").alias("quality_bar"), "content_hash"
    )
    h = F.coalesce("heading", F.lit(""))
    terms = table(spark, d, "toc_nodes").select("id", "heading").distinct().select(F.concat(F.lit("term/"), "id", F.lit("/"), h).alias("entity_id"), F.col("heading").alias("term"), F.concat(F.lit("means "), h).alias("definition_text"), F.lit("").alias("content_hash"))
    amends = table(spark, d, "events").select(
        F.concat(F.lit("ordinance/"), F.col("event_id").cast("string")).alias("entity_id"), F.col("event_id").alias("ordinance_id"), F.when(F.col("user_id") % 2 == 0, "jurisdictional-overlay").otherwise("temporal").alias("amendment_scope"),
        F.expr(_OPS).alias("overlay_operation"), F.date_format("ts", "yyyy-MM-dd").alias("effective_date"), F.lit("council").alias("authority"), F.col("event_type").alias("amendment_text"), F.lit("").alias("content_hash"),
    )
    out = None
    for kind, rows in (("code-edition", editions), ("jurisdiction-corpus", corpora), ("code-definition", terms), ("code-amendment", amends)):
        full = summaries.summarize(rows, kind).select("entity_id", "prose")
        short = summaries.summarize(rows, kind, "user").select(F.col("entity_id").alias("k"), F.col("prose").alias("compact"))
        both = full.join(short, F.col("entity_id") == F.col("k")).select("entity_id", "prose", "compact")
        out = both if out is None else out.unionByName(both)
    return out


_Q = "section 1-11 code"
_HITS = " + ".join(f"CASE WHEN contains(lower(snippet), '{t}') THEN 1 ELSE 0 END" for t in _Q.split())


@R.query(
    "search_other_kinds",
    f"""WITH {_EDS}, a AS (
      SELECT DISTINCT 'code-cross-reference' AS entity_type, 'xref/' || xref_id AS entity_id, coalesce(reference_text, 'null') || ' (' || coalesce(reference_type, 'null') || ')' AS snippet FROM cross_refs
      UNION ALL SELECT DISTINCT 'code-definition', id || '/' || coalesce(heading, ''), coalesce(heading, 'null') || ' — section of the code' FROM toc_nodes
      UNION ALL SELECT 'code-amendment', 'o/' || event_id, 'Ordinance ' || event_id || ': ' || event_type FROM events
      UNION ALL SELECT DISTINCT 'jurisdiction-corpus', jurisdiction_tenant, jurisdiction_tenant || ' code' FROM eds), s AS (SELECT *, 'did:lex:' || entity_type || ':' || entity_id AS did, ({_HITS}) / 3.0 AS score FROM a)
    SELECT did, entity_type, score FROM s WHERE score > 0 ORDER BY score DESC, did LIMIT 100""",
)
def search_other_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of record that are no section or edition, searched by their own snippets."""
    none = F.lit(None).cast("string")
    names = ("section_number", "title", "body_text", "term", "definition_text", "reference_text", "reference_type", "ordinance_id", "amendment_text", "edition_label", "jurisdiction_name")

    def atoms(rows: DataFrame, kind: str, **fields) -> DataFrame:
        k = F.lit(kind)
        snip = search.snippet(k, {n: fields.get(n, none) for n in names})
        return rows.select(I.did(k, F.col("entity_id")).alias("did"), k.alias("entity_type"), "entity_id", none.alias("jurisdiction_tenant"), none.alias("section_number"), snip.alias("snippet"), F.lit(0).alias("seq"))

    c = F.col
    x = table(spark, d, "cross_refs").select(F.concat(F.lit("xref/"), c("xref_id").cast("string")).alias("entity_id"), "reference_text", "reference_type").distinct()
    t = table(spark, d, "toc_nodes").select(F.concat("id", F.lit("/"), F.coalesce("heading", F.lit(""))).alias("entity_id"), "heading").distinct()
    o = table(spark, d, "events").select(F.concat(F.lit("o/"), c("event_id").cast("string")).alias("entity_id"), c("event_id").cast("string").alias("n"), "event_type")
    j = _editions(spark, d).select(c("jurisdiction_tenant").alias("entity_id")).distinct()
    every = (
        atoms(x, "code-cross-reference", reference_text=c("reference_text"), reference_type=c("reference_type")).unionByName(atoms(t, "code-definition", term=c("heading"), definition_text=F.lit("section of the code")))
        .unionByName(atoms(o, "code-amendment", ordinance_id=c("n"), amendment_text=c("event_type"))).unionByName(atoms(j, "jurisdiction-corpus", jurisdiction_name=F.concat("entity_id", F.lit(" code"))))
    )
    return search.search(every, _Q, limit=100).select("did", "entity_type", "score")
