"""Queries of the record store, search, links, evaluation, migration and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.functions import text as T
from lexloom.operators import drift, evaluate, graph, references, rules, search, store
from lexloom.plans import Registry
from lexloom.tables import Scratch, table

R = Registry()
S, J = T.sql, I.sql


def _us(c: str):
    return F.expr(f"unix_micros(try_cast({c} as timestamp))")


# --- identifiers ------------------------------------------------------------------------------


@R.query(
    "did_build_parse",
    f"""SELECT DISTINCT {J.did("entity_type", "entity_id")} AS did, split_part({J.did("entity_type", "entity_id")}, ':', 3) AS parsed_type, entity_id AS parsed_id FROM code_sections""",
)
def did_build_parse(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "code_sections").select(I.did(F.col("entity_type"), F.col("entity_id")).alias("did")).distinct()
    p = I.did_parts(F.col("did"))
    return x.select("did", p["entity_type"].alias("parsed_type"), p["entity_id"].alias("parsed_id"))


@R.query(
    "slugify_ids",
    f"""SELECT DISTINCT entity_id, {J.slug("edition_label")} AS label_slug, jurisdiction_tenant || '/' || {J.slug("edition_label")} AS built_id FROM code_editions""",
)
def slugify_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_editions").select(
        "entity_id", I.slug(F.col("edition_label")).alias("label_slug"), I.edition_id(F.col("jurisdiction_tenant"), F.col("edition_label")).alias("built_id")
    ).distinct()


@R.query(
    "section_ids",
    f"""SELECT DISTINCT code_edition_id, section_number, {J.normal_label("section_number")} AS normal, {J.bare_label("section_number")} AS bare,
      code_edition_id || '/' || {J.slug(J.normal_label("section_number"))} AS section_id FROM code_sections WHERE section_number IS NOT NULL""",
)
def section_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("section_number")
    return table(spark, d, "code_sections").where(n.isNotNull()).select(
        "code_edition_id", n, I.normal_label(n).alias("normal"), I.bare_label(n).alias("bare"), I.section_id(F.col("code_edition_id"), n).alias("section_id")
    ).distinct()


@R.query(
    "content_hash",
    f"""SELECT DISTINCT entity_id, {J.content_hash("'code-section'", "entity_id", "section_number", "title", "subsection_path", "body_text")} AS content_hash,
      'bafy-' || {J.content_hash("'code-section'", "entity_id", "section_number", "title", "subsection_path", "body_text")} AS cid FROM code_sections""",
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    parts = (F.lit("code-section"), *(F.col(c) for c in ("entity_id", "section_number", "title", "subsection_path", "body_text")))
    return table(spark, d, "code_sections").select("entity_id", I.content_hash(*parts).alias("content_hash")).distinct().withColumn("cid", I.cid(F.col("content_hash")))


@R.query(
    "anchor_rekey",
    f"""WITH n AS (SELECT DISTINCT code_edition_id AS ed, id, heading FROM toc_nodes),
    b AS (SELECT ed, id, ed || '/' || {J.slug("split_part(heading, ' ', 1) || ' ' || split_part(heading, ' ', 2)")} AS bare FROM n),
    c AS (SELECT bare, count(DISTINCT id) AS k FROM b GROUP BY 1)
    SELECT ed AS code_edition_id, id, CASE WHEN k >= 2 THEN ed || '/' || {J.slug("regexp_replace(id, '_[^_]*$', '')")} || '/' || split_part(b.bare, '/', 3) ELSE b.bare END AS node_key
    FROM b JOIN c ON b.bare = c.bare""",
)
def anchor_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Ids that collide under distinct anchors take the anchor's container path."""
    n = table(spark, d, "toc_nodes").select("code_edition_id", "id", "heading").distinct()
    word = lambda k: F.coalesce(F.get(F.split("heading", " "), F.lit(k)), F.lit(""))
    b = n.withColumn("bare", F.concat("code_edition_id", F.lit("/"), I.slug(F.concat(word(0), F.lit(" "), word(1)))))
    many = b.groupBy("bare").agg(F.count_distinct("id").alias("k"))
    key = F.concat_ws("/", "code_edition_id", I.anchor_path(F.col("id")), F.substring_index("bare", "/", -1))
    return b.join(many, "bare").select("code_edition_id", "id", F.when((F.col("k") >= 2) & I.anchor_path(F.col("id")).isNotNull(), key).otherwise(F.col("bare")).alias("node_key"))


# --- store ------------------------------------------------------------------------------------

_WRITTEN = f"{S.instant('fetched_at')}"


@R.query(
    "upsert_last_write",
    f"""SELECT entity_id, section_number, title, sha256(body_text) AS body_hash, seq FROM (
      SELECT *, min({_WRITTEN}) OVER (PARTITION BY entity_id) AS seq, row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC) AS r FROM code_sections) WHERE r = 1""",
)
def upsert_last_write(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_sections").select("entity_id", "section_number", "title", F.sha2("body_text", 256).alias("body_hash"), _us("fetched_at").alias("w"))
    return store.upsert_last(rows, ["entity_id"], [F.col("w")]).select("entity_id", "section_number", "title", "body_hash", F.col("seq.w").alias("seq"))


_LINKS = """SELECT 'did:lex:code-edition:' || code_edition_id AS from_did, 'did:lex:code-section:' || entity_id AS to_did, 'contains' AS link_type, source_adapter AS context"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_sections").select(
        I.did(F.lit("code-edition"), F.col("code_edition_id")).alias("from_did"), I.did(F.lit("code-section"), F.col("entity_id")).alias("to_did"),
        F.lit("contains").alias("link_type"), F.col("source_adapter").alias("context"), _us("fetched_at").alias("w"),
    )


@R.query(
    "links_first_write",
    f"""SELECT from_did, to_did, link_type, context FROM (SELECT *, row_number() OVER (PARTITION BY from_did, to_did, link_type ORDER BY w) AS r
      FROM ({_LINKS}, {_WRITTEN} AS w FROM code_sections)) WHERE r = 1""",
)
def links_first_write(spark: SparkSession, d: str) -> DataFrame:
    return store.keep_first(_links(spark, d), ["from_did", "to_did", "link_type"], [F.col("w")]).drop("w")


@R.query(
    "did_cid_latest",
    f"""SELECT {J.did("'code-section'", "entity_id")} AS did, 'bafy-' || {S.hash_key('content_hash')} AS cid FROM section_snapshots WHERE {S.hash_key('content_hash')} IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC, {S.hash_key('content_hash')} DESC) = 1""",
)
def did_cid_latest(spark: SparkSession, d: str) -> DataFrame:
    """Published content id of each record: the last one wins."""
    x = table(spark, d, "section_snapshots").select(I.did(F.lit("code-section"), F.col("entity_id")).alias("did"), T.hash_key(F.col("content_hash")).alias("h"), _us("fetched_at").alias("w")).where("h is not null")
    return x.groupBy("did").agg(I.cid(F.max(F.struct("w", "h"))["h"]).alias("cid"))


@R.query("content_pins", f"SELECT {S.hash_key('content_hash')} AS content_hash, count(*) AS n_writes FROM section_snapshots WHERE {S.hash_key('content_hash')} IS NOT NULL GROUP BY 1")
def content_pins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "section_snapshots").select(T.hash_key(F.col("content_hash")).alias("content_hash")).where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n_writes"))


@R.query(
    "dedupe_longest",
    """SELECT text_key, doc_id, n FROM (SELECT source || '/' || coalesce(section_number, '') AS text_key, doc_id, length(coalesce(text, '')) AS n FROM documents)
      QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY n DESC, doc_id) = 1""",
)
def dedupe_longest(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.coalesce("section_number", F.lit(""))).alias("text_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return store.keep_longest(x, ["text_key"], "text", [F.col("doc_id")]).select("text_key", "doc_id", F.length("text").cast("bigint").alias("n"))


@R.query(
    "dedupe_first",
    """SELECT source || '/' || coalesce(section_number, '') AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1""",
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.coalesce("section_number", F.lit(""))).alias("text_key"), "doc_id")
    return store.keep_first(x, ["text_key"], [F.col("doc_id")])


@R.query(
    "section_number_groups",
    """WITH s AS (SELECT DISTINCT jurisdiction_tenant, section_number, entity_id FROM code_sections WHERE jurisdiction_tenant IS NOT NULL AND section_number IS NOT NULL AND entity_id IS NOT NULL),
    g AS (SELECT jurisdiction_tenant, section_number, count(*) AS n_sections FROM s GROUP BY 1, 2)
    SELECT s.jurisdiction_tenant, s.section_number, s.entity_id, n_sections FROM s JOIN g ON g.jurisdiction_tenant = s.jurisdiction_tenant AND g.section_number = s.section_number""",
)
def section_number_groups(spark: SparkSession, d: str) -> DataFrame:
    """Exact section number within a tenant, for all tenants: each section with its group and the
    group's size, so that a group of n sections is n rows and not its n * n pairs."""
    s = table(spark, d, "code_sections").select("jurisdiction_tenant", "section_number", "entity_id").dropna().distinct()
    return s.join(s.groupBy("jurisdiction_tenant", "section_number").agg(F.count("*").alias("n_sections")), ["jurisdiction_tenant", "section_number"])


def _status_rows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ingest_reports").select("jurisdiction_tenant", _us("run_at").alias("w"), "report_id", "access_policy", "sections_ingested", "cross_references_ingested", "cross_references_resolved")
    latest = x.groupBy("jurisdiction_tenant").agg(F.max_by(F.struct("report_id", "access_policy", "sections_ingested", "cross_references_ingested", "cross_references_resolved"), F.struct("w", "report_id")).alias("r"))
    return latest.select("jurisdiction_tenant", "r.*")


_STATUS = f"""SELECT jurisdiction_tenant, report_id, access_policy, sections_ingested, cross_references_ingested, cross_references_resolved FROM ingest_reports
  QUALIFY row_number() OVER (PARTITION BY jurisdiction_tenant ORDER BY {S.instant('run_at')} DESC, report_id DESC) = 1"""
_RATIO = "CASE WHEN coalesce(cross_references_ingested, 0) = 0 THEN 1.0 ELSE cross_references_resolved / cast(cross_references_ingested AS DOUBLE) END"


@R.query("status_upsert", _STATUS)
def status_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _status_rows(spark, d)


@R.query(
    "status_visible",
    f"""SELECT jurisdiction_tenant, access_policy, quality_bar FROM (SELECT *, CASE WHEN {_RATIO} >= 0.95 THEN 'passing' ELSE 'failing' END AS quality_bar FROM ({_STATUS}))
      WHERE quality_bar LIKE 'passing%' AND coalesce(access_policy, 'public-free') = 'public-free'""",
)
def status_visible(spark: SparkSession, d: str) -> DataFrame:
    s = _status_rows(spark, d).withColumn("quality_bar", F.when(F.expr(_RATIO) >= 0.95, "passing").otherwise("failing"))
    known = ("public-free", "public-paid", "platform-internal", "tenant-private")
    return store.visible(s, "public-free, nonsense", known, passing_only=True).select("jurisdiction_tenant", "access_policy", "quality_bar")


@R.query(
    "status_rebuild",
    f"""WITH s AS (SELECT jurisdiction_tenant, count(DISTINCT entity_id) AS n_sections FROM code_sections GROUP BY 1),
    e AS (SELECT jurisdiction_tenant, min(entity_id) AS current_edition FROM code_editions GROUP BY 1),
    r AS (SELECT jurisdiction_tenant, min({_RATIO}) AS least_score, bool_and({_RATIO} >= 0.95) AS all_passed FROM ingest_reports GROUP BY 1)
    SELECT s.jurisdiction_tenant, n_sections, current_edition, round(least_score, 6) AS least_score, coalesce(all_passed, false) AS all_passed
    FROM s LEFT JOIN e ON e.jurisdiction_tenant = s.jurisdiction_tenant LEFT JOIN r ON r.jurisdiction_tenant = s.jurisdiction_tenant""",
)
def status_rebuild(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "code_sections").groupBy("jurisdiction_tenant").agg(F.count_distinct("entity_id").alias("n_sections"))
    e = table(spark, d, "code_editions").groupBy("jurisdiction_tenant").agg(F.min("entity_id").alias("current_edition"))
    r = table(spark, d, "ingest_reports").groupBy("jurisdiction_tenant").agg(F.min(F.expr(_RATIO)).alias("least"), F.bool_and(F.expr(_RATIO) >= 0.95).alias("ok"))
    return s.join(e, "jurisdiction_tenant", "left").join(r, "jurisdiction_tenant", "left").select(
        "jurisdiction_tenant", "n_sections", "current_edition", F.round("least", 6).alias("least_score"), F.coalesce("ok", F.lit(False)).alias("all_passed")
    )


# --- search -----------------------------------------------------------------------------------


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """Sections and editions as searchable records, one row each, in order of first writing."""
    s = table(spark, d, "code_sections").groupBy("entity_id").agg(
        F.max_by(F.struct("jurisdiction_tenant", "section_number", "title", "body_text"), F.struct(_us("fetched_at"), F.col("content_hash"))).alias("p"), F.min(_us("fetched_at")).alias("seq")
    )
    kind = F.lit("code-section")
    snip = search.snippet(kind, {**{k: F.col(f"p.{k}") for k in ("section_number", "title", "body_text")}, **{k: F.lit(None).cast("string") for k in ("term", "definition_text", "reference_text", "reference_type", "ordinance_id", "amendment_text", "edition_label", "jurisdiction_name")}})
    sections = s.select(I.did(kind, F.col("entity_id")).alias("did"), kind.alias("entity_type"), "entity_id", "p.jurisdiction_tenant", "p.section_number", snip.alias("snippet"), "seq")
    e = table(spark, d, "code_editions").groupBy("entity_id").agg(F.min(F.struct(_us("fetched_at").alias("seq"), "jurisdiction_tenant", "edition_label")).alias("p"))
    kind = F.lit("code-edition")
    editions = e.select(I.did(kind, F.col("entity_id")).alias("did"), kind.alias("entity_type"), "entity_id", "p.jurisdiction_tenant", F.lit(None).cast("string").alias("section_number"), F.col("p.edition_label").alias("snippet"), "p.seq")
    return sections.unionByName(editions)


ATOMS = f"""
atoms AS (
  SELECT 'did:lex:code-section:' || entity_id AS did, 'code-section' AS entity_type, entity_id, jurisdiction_tenant, section_number,
    coalesce(section_number, 'null') || ' ' || coalesce(title, 'null') || '. ' || coalesce(body_text, 'null') AS snippet, min({_WRITTEN}) OVER (PARTITION BY entity_id) AS seq
  FROM code_sections QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC, content_hash DESC) = 1
  UNION ALL
  SELECT 'did:lex:code-edition:' || entity_id, 'code-edition', entity_id, jurisdiction_tenant, NULL, edition_label, {_WRITTEN}
  FROM code_editions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN}, jurisdiction_tenant, edition_label) = 1)
"""


def _score_sql(q: str, source: str) -> str:
    num = "regexp_replace(lower(section_number), '[.,;:!?]+$', '')"
    return f"""
    scored AS (SELECT *, list_filter(regexp_split_to_array({q}, '[^a-z0-9.-]+'), lambda t: length(t) >= 2 OR regexp_full_match(t, '[0-9]')) AS toks FROM {source}),
    hits AS (SELECT *, len(list_filter(toks, lambda t: contains(lower(snippet), t))) AS m, {num} AS num FROM scored),
    ranked AS (SELECT *, CASE WHEN {q} = '' THEN 1.0 WHEN len(toks) > 0 AND m > 0 THEN m / cast(len(toks) AS DOUBLE)
      + CASE WHEN coalesce(num <> '' AND (list_contains(toks, num) OR (split_part(num, '#', 1) NOT IN ('', num) AND list_contains(toks, split_part(num, '#', 1)))), false) THEN 0.25 ELSE 0.0 END END AS score FROM hits)"""


def _search_sql(q: str, where: str = "true", n: int = 25) -> str:
    return f"""WITH {ATOMS}, q AS (SELECT *, lower('{q}') AS q FROM atoms WHERE {where}), {_score_sql('q', 'q')}
    SELECT did, entity_type, entity_id, jurisdiction_tenant, section_number, snippet, score FROM ranked WHERE score IS NOT NULL ORDER BY score DESC, seq, did LIMIT {n}"""


@R.query("search_topk", _search_sql("retaining wall 1-11 permit; a fee of the city clerk"))
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_atoms(spark, d), "retaining wall 1-11 permit; a fee of the city clerk")


@R.query("search_empty_query", _search_sql("", n=100))
def search_empty_query(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_atoms(spark, d), "", limit=1000)


@R.query("search_noise_only", _search_sql("a ( i ) x"))
def search_noise_only(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_atoms(spark, d), "a ( i ) x")


@R.query("search_anchor_boost", _search_sql("section 2-11 limits", "entity_type = 'code-section'", 10))
def search_anchor_boost(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_atoms(spark, d), "section 2-11 limits", kind="code-section", limit=10)


@R.query("search_tenant_type", _search_sql("unified code", "entity_type = 'code-edition' AND jurisdiction_tenant = 'torvec-hollow'"))
def search_tenant_type(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_atoms(spark, d), "unified code", tenant="torvec-hollow", kind="code-edition")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "curated_queries").select("query_id", F.col("jurisdiction_tenant").alias("tenant"), F.col("query_text").alias("q"))
    return search.search_many(_atoms(spark, d), q, 3)


_RANKED = f"""WITH {ATOMS}, q AS (SELECT c.query_id, regexp_replace(lower(coalesce(query_text, '')), '^\\s+|\\s+$', '', 'g') AS q, atoms.* FROM curated_queries c JOIN atoms ON atoms.jurisdiction_tenant = c.jurisdiction_tenant),
{_score_sql('q', 'q')},
top AS (SELECT query_id, did, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, did) AS place FROM ranked WHERE score IS NOT NULL QUALIFY place <= 3)"""


@R.query("curated_top3", _RANKED + " SELECT query_id, did, round(score, 6) AS score, place FROM top")
def curated_top3(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).withColumn("score", F.round("score", 6)).withColumn("place", F.col("place").cast("bigint"))


_HITS = """, hits3 AS (SELECT c.query_id, c.jurisdiction_tenant, coalesce(list_contains(t.top, replace(c.expected_atom_did, 'did:civic:', 'did:lex:')), false) AS hit, coalesce(array_to_string(t.top, ' '), '') AS top
  FROM curated_queries c LEFT JOIN (SELECT query_id, list(did ORDER BY place) AS top FROM top GROUP BY 1) t ON t.query_id = c.query_id WHERE query_type = 'retrieval')"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "curated_queries").withColumn("expected_atom_did", F.replace("expected_atom_did", F.lit("did:civic:"), F.lit("did:lex:")))
    return evaluate.top3_hits(_ranked(spark, d), q)


@R.query("eval_failures", _RANKED + _HITS + " SELECT query_id, jurisdiction_tenant, top FROM hits3 WHERE NOT hit")
def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).where("not hit").select("query_id", "jurisdiction_tenant", F.coalesce(F.array_join("top", " "), F.lit("")).alias("top"))


_XREF_OK = f"""xr AS (SELECT DISTINCT xref_id, jurisdiction_tenant, code_edition_id, {S.section_key('target_section_label')} AS k FROM cross_refs),
sk AS (SELECT DISTINCT code_edition_id, {S.section_key('section_number')} AS k FROM code_sections),
xs AS (SELECT jurisdiction_tenant, avg(CASE WHEN sk.k IS NULL THEN 0.0 ELSE 1.0 END) AS x FROM xr LEFT JOIN sk ON sk.code_edition_id = xr.code_edition_id AND sk.k = xr.k GROUP BY 1),
ns AS (SELECT jurisdiction_tenant, avg(CASE WHEN EXISTS (SELECT 1 FROM code_sections c WHERE c.jurisdiction_tenant = atoms.jurisdiction_tenant AND c.section_number = atoms.section_number AND c.section_number <> '' AND c.entity_id = atoms.entity_id)
  THEN 1.0 ELSE 0.0 END) AS x FROM atoms WHERE entity_type = 'code-section' GROUP BY 1)"""


def _cross_scores(spark: SparkSession, d: str) -> DataFrame:
    xr = table(spark, d, "cross_refs").select("xref_id", "jurisdiction_tenant", "code_edition_id", T.section_key(F.col("target_section_label")).alias("k")).distinct()
    sk = table(spark, d, "code_sections").select("code_edition_id", T.section_key(F.col("section_number")).alias("k")).distinct().withColumn("ok", F.lit(1.0))
    return xr.join(sk, ["code_edition_id", "k"], "left").groupBy("jurisdiction_tenant").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("cross_ref_score"))


def _number_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are the searchable sections; each is looked up by its number among all rows."""
    candidates = _atoms(spark, d).where("entity_type = 'code-section'")
    held = table(spark, d, "code_sections").select("jurisdiction_tenant", "section_number", I.did(F.lit("code-section"), F.col("entity_id")).alias("did"))
    found = evaluate.retrievable(candidates, held)
    return found.groupBy("jurisdiction_tenant").agg(F.avg(F.col("retrievable").cast("double")).alias("section_num_score"))


@R.query("coverage_score", f"WITH {ATOMS}, {_XREF_OK} SELECT jurisdiction_tenant, round(x, 6) AS section_num_score FROM ns")
def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    """Share of a tenant's sections that a look-up of their exact number finds again."""
    return _number_scores(spark, d).withColumn("section_num_score", F.round("section_num_score", 6))


@R.query("cross_ref_score", f"WITH {ATOMS}, {_XREF_OK} SELECT jurisdiction_tenant, round(x, 6) AS cross_ref_score FROM xs")
def cross_ref_score(spark: SparkSession, d: str) -> DataFrame:
    return _cross_scores(spark, d).withColumn("cross_ref_score", F.round("cross_ref_score", 6))


@R.query(
    "eval_scores",
    _RANKED + _HITS + f""", {_XREF_OK}, tn AS (SELECT DISTINCT jurisdiction_tenant FROM code_sections), hs AS (SELECT jurisdiction_tenant, avg(cast(hit AS INT)) AS x, count(*) AS n FROM hits3 GROUP BY 1)
    SELECT tn.jurisdiction_tenant, round(coalesce(hs.x, 1.0), 6) AS top3_score, coalesce(hs.n, 0) AS n_queries, round(coalesce(ns.x, 1.0), 6) AS section_num_score, round(coalesce(xs.x, 1.0), 6) AS cross_ref_score,
      coalesce(hs.x, 1.0) >= 0.9 AND coalesce(ns.x, 1.0) >= 1.0 AND coalesce(xs.x, 1.0) >= 0.95 AS passed
    FROM tn LEFT JOIN hs ON hs.jurisdiction_tenant = tn.jurisdiction_tenant LEFT JOIN ns ON ns.jurisdiction_tenant = tn.jurisdiction_tenant LEFT JOIN xs ON xs.jurisdiction_tenant = tn.jurisdiction_tenant""",
)
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    tenants = table(spark, d, "code_sections").select("jurisdiction_tenant").distinct()
    x = evaluate.score_per_tenant(_hits(spark, d), tenants).join(_number_scores(spark, d), "jurisdiction_tenant", "left").join(_cross_scores(spark, d), "jurisdiction_tenant", "left")
    x = x.fillna(1.0, ["section_num_score", "cross_ref_score"])
    ok = evaluate.passed(F.col("top3_score"), F.col("section_num_score"), F.col("cross_ref_score")).alias("passed")
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("jurisdiction_tenant", r("top3_score"), "n_queries", r("section_num_score"), r("cross_ref_score"), ok)


@R.query(
    "eval_samples",
    f"""WITH {ATOMS}, r AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction_tenant, entity_type ORDER BY seq, did) AS place FROM atoms) SELECT jurisdiction_tenant, entity_type, did, place FROM r WHERE place <= 20""",
)
def eval_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 records of each tenant and kind, as a quality run samples them."""
    return evaluate.samples(_atoms(spark, d), 20).select("jurisdiction_tenant", "entity_type", "did", F.col("place").cast("bigint").alias("place"))


@R.query("search_total", "WITH r AS (" + _search_sql("grading permit of the county surveyor", n=40) + ") SELECT did, score, count(*) OVER () AS total_candidates FROM r")
def search_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of results with the number of records on it."""
    return search.with_total(search.search(_atoms(spark, d), "grading permit of the county surveyor", limit=40)).select("did", "score", "total_candidates")


# --- links ------------------------------------------------------------------------------------


@R.query(
    "traverse_links",
    """SELECT 'did:lex:code-edition:' || x.code_edition_id AS from_did, 'did:lex:code-section:' || x.entity_id AS to_did, s.entity_id IS NOT NULL AS found
      FROM (SELECT DISTINCT code_edition_id, entity_id FROM section_snapshots) x LEFT JOIN (SELECT DISTINCT entity_id FROM code_sections) s ON s.entity_id = x.entity_id""",
)
def traverse_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "section_snapshots").select(I.did(F.lit("code-edition"), F.col("code_edition_id")).alias("from_did"), I.did(F.lit("code-section"), F.col("entity_id")).alias("to_did"), F.lit("contains").alias("link_type")).distinct()
    atoms = table(spark, d, "code_sections").select(I.did(F.lit("code-section"), F.col("entity_id")).alias("did"), F.lit("").alias("content_hash")).distinct()
    return graph.traverse(links, atoms).select("from_did", "to_did", "found")


@R.query(
    "dangling_links",
    """SELECT DISTINCT 'did:lex:code-section:' || entity_id AS to_did FROM section_snapshots
      WHERE entity_id NOT IN (SELECT entity_id FROM code_sections GROUP BY 1 HAVING bool_or(removed_at IS NULL))""",
)
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    """Delivered sections that are not, or no longer, in the store."""
    links = table(spark, d, "section_snapshots").select(I.did(F.lit("code-section"), F.col("entity_id")).alias("to_did")).distinct()
    held = table(spark, d, "code_sections").where("removed_at is null")
    return graph.dangling(links, held.select(I.did(F.lit("code-section"), F.col("entity_id")).alias("did")))


@R.query(
    "links_not_stored",
    f"""SELECT DISTINCT 'did:lex:code-edition:' || code_edition_id AS from_did, 'did:lex:code-section:' || entity_id AS to_did, 'contains' AS link_type FROM section_snapshots x
      WHERE NOT EXISTS (SELECT 1 FROM code_sections s WHERE s.entity_id = x.entity_id AND s.code_edition_id = x.code_edition_id AND s.removed_at IS NULL)""",
)
def links_not_stored(spark: SparkSession, d: str) -> DataFrame:
    """Links that deliveries bring and the store, without sections taken away, does not hold."""
    keys = ["from_did", "to_did", "link_type"]
    links = lambda x: x.select(I.did(F.lit("code-edition"), F.col("code_edition_id")).alias("from_did"), I.did(F.lit("code-section"), F.col("entity_id")).alias("to_did"), F.lit("contains").alias("link_type"))
    return store.new_links(links(table(spark, d, "section_snapshots")).distinct(), links(table(spark, d, "code_sections").where("removed_at is null")), keys)


_KINDS_SQL = ", ".join(f"'{k}'" for k in graph.LINK_TYPES)


@R.query("links_unknown", f"SELECT DISTINCT xref_id, reference_type AS link_type FROM cross_refs WHERE coalesce(reference_type NOT IN ({_KINDS_SQL}), true)")
def links_unknown(spark: SparkSession, d: str) -> DataFrame:
    """References whose stated kind is none of the link taxonomy."""
    return graph.unknown_links(table(spark, d, "cross_refs").select("xref_id", F.col("reference_type").alias("link_type"))).distinct()


@R.query(
    "composition_children",
    """SELECT e.entity_id AS edition_id, count(s.entity_id) AS n_children, min(s.entity_id) AS first_child FROM (SELECT DISTINCT entity_id FROM code_editions) e
      LEFT JOIN (SELECT DISTINCT code_edition_id, entity_id FROM code_sections) s ON s.code_edition_id = e.entity_id GROUP BY 1""",
)
def composition_children(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "code_editions").select(F.col("entity_id").alias("edition_id")).distinct()
    s = table(spark, d, "code_sections").select(F.col("code_edition_id").alias("edition_id"), "entity_id").distinct().groupBy("edition_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_child"))
    return e.join(s, "edition_id", "left").select("edition_id", F.coalesce("n", F.lit(0)).alias("n_children"), "first_child")


_SNIFF = rf"""m AS (SELECT entity_id, code_edition_id, body_text, unnest(list_concat(regexp_extract_all(body_text, '{references.PASSES[0]}', 1), regexp_extract_all(body_text, '(?i)\bsection\s+([\w.()-]+)', 1))) AS raw
  FROM (SELECT DISTINCT entity_id, code_edition_id, body_text FROM code_sections))"""


def _sniffed(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "code_sections").select("entity_id", "code_edition_id", "body_text").distinct()
    a, b = (F.regexp_extract_all("body_text", F.lit(p), F.lit(1)) for p in references.PASSES)
    return x.select("entity_id", "code_edition_id", F.explode(F.concat(a, b)).alias("raw")).withColumn("label", I.no_end_marks(F.col("raw"))).withColumn("normal", I.normal_label(F.col("label"))).where("label != '' and normal != ''")


@R.query("xref_sniff", f"WITH {_SNIFF} SELECT entity_id, {J.normal_label(J.no_end_marks('raw'))} AS label, count(*) AS n FROM m WHERE {J.normal_label(J.no_end_marks('raw'))} <> '' GROUP BY 1, 2")
def xref_sniff(spark: SparkSession, d: str) -> DataFrame:
    return _sniffed(spark, d).groupBy("entity_id", F.col("normal").alias("label")).agg(F.count("*").alias("n"))


#: Targets by the four forms of a section's number: of one form the last written section counts.
_TARGETS = f"""t AS (SELECT code_edition_id, label, arg_max(entity_id, (w, f, entity_id)) AS id FROM (SELECT code_edition_id, entity_id, w, unnest(forms) AS label, generate_subscripts(forms, 1) AS f FROM (
      SELECT code_edition_id, entity_id, {_WRITTEN} AS w, [section_number, {J.normal_label('section_number')}, {J.bare_label('section_number')}, {J.bare_label(J.normal_label('section_number'))}] AS forms FROM code_sections WHERE section_number IS NOT NULL)) GROUP BY 1, 2)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return references.label_forms(table(spark, d, "code_sections").select("code_edition_id", "entity_id", "section_number", _us("fetched_at").alias("seq")))


#: References with labels to look up: those that bodies hold, and those that ingestion recorded.
_CITED = f"""l AS (SELECT DISTINCT entity_id AS from_id, code_edition_id, {J.no_end_marks('raw')} AS label FROM m
      UNION SELECT DISTINCT 'xref/' || xref_id, code_edition_id, {J.no_end_marks('target_section_label')} FROM cross_refs WHERE target_section_label IS NOT NULL)"""


@R.query(
    "xref_resolve",
    f"""WITH {_SNIFF}, {_CITED}, p AS (SELECT *, {J.normal_label('label')} AS normal, {J.bare_label(J.normal_label('label'))} AS bare FROM l), {_TARGETS}
    SELECT p.from_id, p.label, coalesce(a.id, b.id, c.id) AS to_id FROM p LEFT JOIN t a ON a.code_edition_id = p.code_edition_id AND a.label = p.label
      LEFT JOIN t b ON b.code_edition_id = p.code_edition_id AND b.label = p.normal LEFT JOIN t c ON c.code_edition_id = p.code_edition_id AND c.label = p.bare WHERE p.label <> '' AND p.normal <> ''""",
)
def xref_resolve(spark: SparkSession, d: str) -> DataFrame:
    """References of bodies and of ingestion, resolved within their edition by three forms of the label."""
    found = _sniffed(spark, d).select(F.col("entity_id").alias("from_id"), F.col("code_edition_id").alias("bucket"), "label")
    stated = table(spark, d, "cross_refs").where("target_section_label is not null").select(
        F.concat(F.lit("xref/"), F.col("xref_id").cast("string")).alias("from_id"), F.col("code_edition_id").alias("bucket"), I.no_end_marks(F.col("target_section_label")).alias("label")
    )
    normal = I.normal_label(F.col("label"))
    refs = found.unionByName(stated).where((F.col("label") != "") & (normal != "")).select("from_id", "bucket", "label", F.col("label").alias("probe_1"), normal.alias("probe_2"), I.bare_label(normal).alias("probe_3")).distinct()
    return graph.resolve_labels(refs, _targets(spark, d)).select("from_id", "label", "to_id")


@R.query(
    "xref_types",
    f"SELECT DISTINCT xref_id, reference_type, {J.link_type('reference_type')} AS link_type, {J.reference_type('reference_context')} AS inferred_type FROM cross_refs WHERE reference_context IS NOT NULL",
)
def xref_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cross_refs").where("reference_context is not null").select(
        "xref_id", "reference_type", I.link_type(F.col("reference_type")).alias("link_type"), I.reference_type(F.col("reference_context")).alias("inferred_type")
    ).distinct()


# --- effective rules and drift ----------------------------------------------------------------

_OPS = "CASE event_type WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'replace' WHEN 'error' THEN 'delete' ELSE 'add' END"


def _overlays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 7).cast("string")).alias("jurisdiction_tenant"), F.array(F.concat(F.lit("part-"), (F.col("event_id") % 211).cast("string"))).alias("affected_section_ids"),
        F.date_format("ts", "yyyy-MM-dd").alias("effective_date"), F.col("event_id").alias("seq"), F.expr(_OPS).alias("overlay_operation"), F.concat(F.lit("o-"), F.col("event_id").cast("string")).alias("ordinance_id"),
        F.lit("jurisdictional-overlay").alias("amendment_scope"),
    )


def _effective(spark: SparkSession, d: str, part: DataFrame) -> DataFrame:
    parts = part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("base_id"), F.col("p_partkey").cast("string").alias("section_number"), F.col("p_name").alias("title"), F.lit("base").alias("code_edition_id"),
        F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"),
    )
    bases = parts.select(F.concat(F.lit("tenant-"), F.col("t").cast("string")).alias("jurisdiction_tenant"), "base_id", "section_number", "title", "code_edition_id")
    return rules.effective_rules(bases, _overlays(spark, d)).drop("code_edition_id")


@R.query(
    "effective_rule_all",
    f"""WITH o AS (SELECT 'tenant-' || (user_id % 7) AS t, 'part-' || (event_id % 211) AS b, strftime(ts, '%Y-%m-%d') AS dt, event_id AS seq, {_OPS} AS op FROM events),
    bases AS (SELECT 'tenant-' || t AS t, 'part-' || p_partkey AS b, p_partkey AS n, p_name AS title FROM part, range(7) r(t)),
    per AS (SELECT t, b, count(*) AS k, arg_max(op, (dt, seq)) AS op, 'o-' || arg_max(seq, (dt, seq)) AS ord, max(dt) AS dt, bool_or(op IN ('replace', 'delete')) AS gone FROM o GROUP BY 1, 2),
    x AS (SELECT coalesce(bases.t, per.t) AS t, coalesce(bases.b, per.b) AS b, n, title, k, op, ord, dt, gone, CASE op WHEN 'modify' THEN 'modified' WHEN 'replace' THEN 'replaced' WHEN 'add' THEN 'added' WHEN 'delete' THEN 'deleted' ELSE 'base-only' END AS resolution
      FROM bases FULL JOIN per ON per.t = bases.t AND per.b = bases.b)
    SELECT t AS jurisdiction_tenant, b AS base_id, resolution, n IS NOT NULL AND coalesce(NOT gone AND resolution <> 'added', true) AS base_governs, coalesce(k, 0) AS n_overlays,
      CASE WHEN n IS NULL THEN '(no base section)' ELSE trim('§' || n || ' ' || title) END || CASE WHEN k IS NULL THEN ' adopted by ' || t || ' without local amendment.'
        ELSE ': ' || resolution || ' for ' || t || ' by ' || CASE WHEN k = 1 THEN '1 overlay' ELSE k || ' overlays' END || ' (latest: ordinance ' || ord || ', ' || op || ', effective ' || dt || ').' END AS note FROM x""",
)
def effective_rule_all(spark: SparkSession, d: str) -> DataFrame:
    """The rule of every part under the overlays of every tenant."""
    return _effective(spark, d, table(spark, d, "part"))


@R.query(
    "overlays_by_section",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS effective_date, event_id AS seq, {_OPS} AS overlay_operation FROM events WHERE user_id % 7 = 3 AND event_id % 211 = 17""",
)
def overlays_by_section(spark: SparkSession, d: str) -> DataFrame:
    return rules.overlays_of(_overlays(spark, d), "tenant-3", "part-17").select("effective_date", "seq", "overlay_operation")


_CAPTURES = f"""c AS (SELECT snapshot_no AS n, entity_id, {S.hash_key('content_hash')} AS h FROM section_snapshots WHERE snapshot_no IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_no, entity_id ORDER BY {_WRITTEN} DESC, h DESC NULLS LAST) = 1),
    b AS (SELECT * FROM c WHERE n > (SELECT min(n) FROM c)), a AS (SELECT n + 1 AS n, entity_id, h FROM c WHERE n < (SELECT max(n) FROM c))"""


def _consecutive(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by snapshot as those before and those of each snapshot but the first."""
    low, high = x.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    return x.where(F.col("snapshot_no") < F.lit(high)).withColumn("snapshot_no", F.col("snapshot_no") + 1), x.where(F.col("snapshot_no") > F.lit(low))


@R.query(
    "drift_diff",
    f"""WITH {_CAPTURES} SELECT coalesce(b.n, a.n) AS snapshot_no, coalesce(b.entity_id, a.entity_id) AS section_id, CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
      a.h AS prior_hash, b.h AS current_hash FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.n = b.n WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.h <> b.h""",
)
def drift_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot against the one of the number before, of all tenants together."""
    x = table(spark, d, "section_snapshots").select("snapshot_no", F.col("entity_id").alias("section_id"), T.hash_key(F.col("content_hash")).alias("hash"), _us("fetched_at").alias("w"))
    prior, now = _consecutive(x)
    within = ("snapshot_no",)
    return drift.diff(drift.capture(prior, "w", within), drift.capture(now, "w", within), within)


@R.query(
    "drift_new_editions",
    """WITH e AS (SELECT DISTINCT snapshot_no AS n, code_edition_id AS id FROM section_snapshots) SELECT n AS snapshot_no, id AS amendment_id FROM e
      WHERE n > (SELECT min(n) FROM e) AND NOT EXISTS (SELECT 1 FROM e p WHERE p.n = e.n - 1 AND p.id = e.id)""",
)
def drift_new_editions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "section_snapshots").select("snapshot_no", F.col("code_edition_id").alias("amendment_id")).distinct()
    return drift.new_amendments(*_consecutive(x), ("snapshot_no",))


def write_index(spark: SparkSession, d: str, path: str) -> None:
    """The searchable records, links and status rows of a data folder as a snapshot."""
    store.write_snapshot(path, {"atoms": _atoms(spark, d), "links": _links(spark, d), "status": _status_rows(spark, d)}, "2024-01-01T00:00:00.000Z", ["tables"])


@R.query("snapshot_round_trip", f"WITH {ATOMS} SELECT did, entity_type, seq FROM atoms")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes a snapshot of the searchable records to shared storage and reads it back."""
    scratch = Scratch(spark, "snapshot")
    write_index(spark, d, scratch.root)
    return store.read_snapshot(spark, scratch.root)["atoms"].select("did", "entity_type", "seq")
