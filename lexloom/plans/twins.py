"""SQL twins of the queries that read markup pages and model code. Their inputs are made from the
sections, so what the readers must give back follows from the sections themselves."""

from __future__ import annotations

from lexloom.functions import ids as I
from lexloom.functions import text as T
from lexloom.operators import tree
from lexloom.operators.references import AROUND
from lexloom.sources.markup import PART

S, J = T.sql, I.sql
_WRITTEN = S.instant("fetched_at")

#: The last written row of each section.
CURRENT = f"""cur AS (SELECT entity_id, code_edition_id, section_number, title, body_text FROM code_sections
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC, content_hash DESC) = 1)"""

# --- markup pages -----------------------------------------------------------------------------

#: Documents with content, in page order (part 1 is the node's heading), and their lines.
_DOCS = f"""{CURRENT}, docs AS (SELECT code_edition_id AS page, entity_id, '#' || regexp_replace(entity_id, '[^A-Za-z0-9]', '_', 'g') AS anchor,
    {J.trim_all(f"('§ ' || {J.bare_label("coalesce(section_number, '0')")} || ' — ' || title)")} AS head, body_text FROM cur WHERE body_text IS NOT NULL),
  parts AS (SELECT *, 1 + row_number() OVER (PARTITION BY page ORDER BY entity_id) AS part FROM docs),
  lines AS (SELECT page, entity_id, anchor, part, line, row_number() OVER (PARTITION BY entity_id ORDER BY i) AS k FROM (
    SELECT page, entity_id, anchor, part, {J.trim_all('raw')} AS line, i FROM (
      SELECT page, entity_id, anchor, part, unnest(string_split(body_text, chr(10))) AS raw, generate_subscripts(string_split(body_text, chr(10)), 1) AS i FROM parts)) WHERE line <> '')"""

HTML_BLOCKS = f"""WITH {_DOCS}
SELECT DISTINCT code_edition_id AS page, {PART} AS pos, 'heading' AS kind, 2 AS depth, 'Body' AS text, '#body' AS anchor FROM cur
UNION ALL SELECT page, part * {PART}, 'heading', 3, head, anchor FROM parts WHERE head IS NOT NULL
UNION ALL SELECT lines.page, lines.part * {PART} + k, 'paragraph', NULL, line, NULL FROM lines JOIN parts ON parts.entity_id = lines.entity_id WHERE head IS NOT NULL"""

_LABEL = f"CASE WHEN regexp_matches(head, '{tree.SIGN}') THEN regexp_extract(head, '{tree.SIGN}', 1) ELSE '' END"
_TITLE = f"CASE WHEN regexp_matches(head, '{tree.SIGN}') THEN {J.trim_all(f"regexp_extract(head, '{tree.SIGN}', 2)")} ELSE head END"
_HELD = J.slug("regexp_replace(raw, '_[^_]*$', '')")
_PATH = f"coalesce(CASE WHEN contains(raw, '_') THEN nullif({_HELD}, '') END, nullif({J.slug('raw')}, ''))"
_SECTIONS = f"""{_DOCS}, meta AS (SELECT entity_id AS page, jurisdiction_tenant AS tenant, edition_label, fetched_at, jurisdiction_tenant || '/' || {J.slug('edition_label')} AS ed FROM code_editions
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN}, content_hash) = 1),
  h AS (SELECT p.page, p.entity_id AS own, part, ed, substr(anchor, 2) AS raw, anchor, {_LABEL} AS number, {_TITLE} AS title FROM parts p JOIN meta ON meta.page = p.page WHERE head IS NOT NULL),
  n AS (SELECT *, CASE WHEN number <> '' THEN number ELSE title END AS named FROM h),
  q AS (SELECT *, ed || '/' || {J.slug(J.normal_label('named'))} AS plain FROM n),
  a AS (SELECT *, (SELECT count(DISTINCT anchor) FROM q x WHERE x.page = q.page AND x.plain = q.plain) AS anchors, {_PATH} AS path FROM q),
  b AS (SELECT entity_id AS own, string_agg(line, chr(10) ORDER BY k) AS body FROM lines GROUP BY 1),
  secs AS (SELECT a.page, part, own, ed, number, title, CASE WHEN anchors >= 2 AND path IS NOT NULL THEN ed || '/' || path || '/' || {J.slug(J.normal_label('named'))} ELSE plain END AS id, coalesce(body, '') AS body FROM a LEFT JOIN b USING (own)),
  hashed AS (SELECT *, {J.content_hash("'code-section'", 'id', 'number', 'title', "''", 'body')} AS hash FROM secs)"""

PAGE_SECTIONS = f"WITH {_SECTIONS} SELECT id AS entity_id, ed AS code_edition_id, number AS section_number, title, cast(NULL AS VARCHAR) AS subsection_path, hash AS content_hash FROM hashed"

PAGE_LINKS = rf"""WITH {_SECTIONS}, cites AS (SELECT s.id, s.ed, line, unnest(regexp_extract_all(line, '(?i)§\s*([\w.()-]+)', 1)) AS target FROM lines l JOIN secs s ON s.own = l.entity_id)
SELECT 'code-edition' AS from_type, ed AS from_id, 'code-section' AS to_type, id AS to_id, 'contains' AS link_type, cast(NULL AS VARCHAR) AS context FROM secs
UNION ALL SELECT 'code-section', id, 'code-section', ed || '/' || {J.slug(J.normal_label('target'))}, {J.link_type(J.reference_type('line'))}, line FROM cites WHERE target <> ''
UNION ALL SELECT 'jurisdiction-corpus', tenant, 'code-edition', ed, 'contains', NULL FROM meta"""

PAGE_EDITIONS = f"""WITH {_SECTIONS}, r AS (SELECT page, count(*) AS n, string_agg(hash, '' ORDER BY part) AS hashes FROM hashed GROUP BY 1)
SELECT ed AS entity_id, fetched_at AS effective_from, coalesce(n, 0) AS n_sections, {J.content_hash("'code-edition'", 'ed', 'edition_label', 'hashes')} AS content_hash FROM meta LEFT JOIN r ON r.page = meta.page"""

# --- model code -------------------------------------------------------------------------------

_CITED = r"(?:^|[^A-Za-z0-9_])((?:Sections?|Tables?|Chapters?|§)\s+([A-Z]?\d[\w.()-]*))"


def _url(x: str) -> str:
    x = f"url_encode({x})"
    for a, b in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_MODEL = f"""{CURRENT}, m0 AS (SELECT entity_id AS sid, code_edition_id AS doc, {J.bare_label("coalesce(section_number, '0')")} AS number, title AS heading, body_text FROM cur),
  m1 AS (SELECT *, '2021 ' || doc AS label, 'model/' || {J.slug("'2021 ' || doc")} AS ed, regexp_extract(number, '^([A-Za-z]*\\d+)', 1) AS c FROM m0),
  m AS (SELECT *, CASE c WHEN '2' THEN 'Definitions' ELSE 'General' END AS chapter, ed || '/' || {J.slug(J.normal_label('number'))} AS id, 'https://codes.example/content/MC2021#' || {_url('number')} AS link,
    dense_rank() OVER (PARTITION BY doc ORDER BY c) AS chap, row_number() OVER (PARTITION BY doc, c ORDER BY sid) AS sec FROM m1),
  r0 AS (SELECT doc, sid, chap, sec, ed, id, number, body_text, generate_subscripts(w, 1) AS k, unnest(w) AS whole, unnest(t) AS target FROM (
    SELECT *, regexp_extract_all(body_text, '{_CITED}', 1) AS w, regexp_extract_all(body_text, '{_CITED}', 2) AS t FROM m)),
  r AS (SELECT * REPLACE ({J.no_end_marks('whole')} AS whole, {J.no_end_marks('target')} AS target) FROM r0 WHERE {J.no_end_marks('target')} <> '')"""

MODEL_SECTIONS = f"""WITH {_MODEL}, cited AS (SELECT sid, string_agg(target, ', ' ORDER BY k) AS targets FROM r GROUP BY 1),
  b AS (SELECT m.*, concat_ws(' ', 'Section ' || number || ' (' || heading || ') of the ' || label || ', Chapter ' || c || ' (' || chapter || ').',
    'Structure: ' || concat_ws('; ', 'defines 1 term (' || lower(coalesce(heading, '')) || ')', 'cross-references ' || targets) || '.', 'The verbatim text is published elsewhere; see ' || link || '.') AS body FROM m LEFT JOIN cited USING (sid))
SELECT id AS entity_id, number AS section_number, heading AS title, body AS body_text, link AS verbatim_text_deep_link, length(link) > 0 AS footed, {J.content_hash("'code-section'", 'id', 'number', 'heading', 'body', 'link')} AS content_hash FROM b"""

MODEL_REFERENCES = f"""WITH {_MODEL}, known AS (SELECT doc, {J.normal_label('number')} AS l, arg_max(id, (chap, sec)) AS to_id FROM m GROUP BY 1, 2),
  x AS (SELECT r.*, row_number() OVER (PARTITION BY doc ORDER BY chap, sec, k) AS n, {J.reference_type('body_text', I.MODEL_REFERENCE_PHRASES)} AS kind FROM r)
SELECT x.doc, ed || '/' || {J.slug('number')} || '/xref-' || n AS entity_id, id AS from_section_id, coalesce(to_id, '') AS to_section_id, whole AS reference_text, kind AS reference_type, {J.link_type('kind')} AS link_type
FROM x LEFT JOIN known ON known.doc = x.doc AND known.l = {J.normal_label('target')}"""

MODEL_DEFINITIONS = f"""WITH {_MODEL} SELECT ed || '/' || {J.slug('lower(heading)')} AS entity_id, lower(heading) AS term, heading AS definition_text, id AS defining_section_id, CASE chapter WHEN 'Definitions' THEN 'code' ELSE 'section' END AS scope FROM m"""

MODEL_BLOCKS = f"""WITH {_MODEL}, e AS (
  SELECT DISTINCT doc, chap, 0 AS sec, 0 AS rank, 'heading' AS kind, 1 AS depth, trim('Chapter ' || c || ' ' || chapter) AS text, '#' || c AS anchor, c AS label FROM m
  UNION ALL SELECT doc, chap, sec, 1, 'heading', 2, trim(number || ' ' || heading), '#' || sid, number FROM m
  UNION ALL SELECT doc, chap, sec, 2, 'paragraph', NULL, trim(body_text), NULL, NULL FROM m WHERE trim(coalesce(body_text, '')) <> ''
  UNION ALL SELECT doc, chap, sec, 3, 'definition', NULL, heading, NULL, lower(heading) FROM m)
SELECT doc AS page, row_number() OVER (PARTITION BY doc ORDER BY chap, sec, rank) - 1 AS pos, kind, depth, text, anchor, label FROM e"""

# --- references as records --------------------------------------------------------------------

#: Bodies that cite: those of sections, and the references that ingestion kept, with their context.
_BODIES = f"""bodies AS (SELECT entity_id, code_edition_id, section_number, body_text, min({_WRITTEN}) OVER (PARTITION BY entity_id) AS seq FROM code_sections
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {_WRITTEN} DESC, content_hash DESC) = 1
  UNION ALL SELECT 'xref/' || xref_id, code_edition_id, NULL, concat_ws(': ', reference_text, reference_context) AS body, min({_WRITTEN}) FROM cross_refs GROUP BY ALL)"""


def _pass(no: int, pattern: str) -> str:
    """Matches of one pass with where they begin: lengths of the text between and of the matches before."""
    return f"""SELECT entity_id, code_edition_id, seq, body_text, {no} AS pass_no, w[k] AS whole, p[k] AS part, list_sum(list_transform(t[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) AS st
    FROM (SELECT *, generate_subscripts(w, 1) AS k FROM (SELECT *, regexp_extract_all(body_text, '{pattern}') AS w, regexp_extract_all(body_text, '{pattern}', 1) AS p, string_split_regex(body_text, '{pattern}') AS t FROM bodies))"""


_START = f"greatest(0, st - {AROUND})"
#: References of table ``bodies``: all (r), and the numbered records of those that resolve (n).
_REFERENCES = rf"""m AS ({_pass(0, r'§\s*([\w.()-]+)')} UNION ALL {_pass(1, r'(?i)\bsection\s+([\w.()-]+)')}),
  x AS (SELECT entity_id, code_edition_id, seq, pass_no, st, trim(whole) AS reference_text, {J.no_end_marks('part')} AS label, {J.normal_label(J.no_end_marks('part'))} AS normal,
    {J.trim_all(f"substr(body_text, cast({_START} + 1 AS BIGINT), cast(st - {_START} + length(whole) + {AROUND} AS BIGINT))")} AS context FROM m),
  o AS (SELECT * FROM x WHERE label <> '' AND normal <> '' QUALIFY row_number() OVER (PARTITION BY entity_id, normal ORDER BY pass_no, st) = 1),
  t AS (SELECT code_edition_id, label, arg_max(entity_id, (seq, f, entity_id)) AS id FROM (SELECT code_edition_id, entity_id, seq, unnest(forms) AS label, generate_subscripts(forms, 1) AS f FROM (
    SELECT *, [section_number, {J.normal_label('section_number')}, {J.bare_label('section_number')}, {J.bare_label(J.normal_label('section_number'))}] AS forms FROM bodies WHERE section_number IS NOT NULL)) GROUP BY 1, 2),
  r AS (SELECT o.*, coalesce(a.id, b.id, c.id) AS to_id FROM o LEFT JOIN t a ON a.code_edition_id = o.code_edition_id AND a.label = o.label
    LEFT JOIN t b ON b.code_edition_id = o.code_edition_id AND b.label = o.normal LEFT JOIN t c ON c.code_edition_id = o.code_edition_id AND c.label = {J.bare_label('o.normal')}),
  n AS (SELECT *, code_edition_id || '/' || {J.slug('entity_id')} || '/xref-' || row_number() OVER (PARTITION BY code_edition_id ORDER BY seq, entity_id, pass_no, st) AS id, {J.reference_type('context')} AS kind FROM r WHERE to_id IS NOT NULL)"""

XREF_RECORDS = f"""WITH {_BODIES}, {_REFERENCES}
SELECT id AS entity_id, entity_id AS from_section_id, to_id AS to_section_id, reference_text, context AS reference_context, kind AS reference_type, {J.link_type('kind')} AS link_type,
  {J.content_hash("'code-cross-reference'", 'id', 'entity_id', 'to_id', 'reference_text')} AS content_hash FROM n"""


def run_report(legacy: str) -> str:
    """The report of a migration, from the CTE of legacy rows with a number and a body."""
    none, empty = f"coalesce({J.trim_all('section_number')}, '') = ''", f"coalesce({J.trim_all('body')}, '') = ''"
    return f"""WITH {legacy}, bodies AS (SELECT eid AS entity_id, ed AS code_edition_id, section_number, body AS body_text, epoch_us(fetched_at) AS seq, jurisdiction_key AS owner FROM lg
      QUALIFY row_number() OVER (PARTITION BY eid ORDER BY fetched_at, id) = 1), {_REFERENCES},
    c AS (SELECT (SELECT count(*) FROM bodies) AS secs, (SELECT count(*) FROM lg) AS written, (SELECT count(DISTINCT code_edition_id) FROM bodies) AS eds, (SELECT count(DISTINCT owner) FROM bodies) AS corp, (SELECT count(*) FROM n) AS refs, (SELECT count(*) FROM r WHERE to_id IS NULL) AS open_)
    SELECT secs AS sections_transformed, written - secs AS section_collisions, eds AS editions_synthesized, corp AS corpora_synthesized, refs AS cross_references_resolved, open_ AS cross_references_unresolved_skipped, secs + eds + refs AS links_emitted,
      (SELECT count(*) FROM legacy_rows WHERE {none}) AS sections_dropped_null_section, (SELECT count(*) FROM legacy_rows WHERE NOT {none} AND {empty}) AS sections_dropped_empty_body FROM c"""


MODEL_EDITIONS = MODEL_SECTIONS.split("SELECT id AS entity_id, number AS section_number")[0] + f""", h AS (SELECT doc, ed, label, string_agg({J.content_hash("'code-section'", 'id', 'number', 'heading', 'body', 'link')}, '' ORDER BY chap, sec) AS hashes, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT ed AS entity_id, label AS edition_label, '2021-01-01' AS effective_from, n AS n_sections, {J.content_hash("'code-edition'", 'ed', 'label', 'hashes')} AS content_hash FROM h"""

MODEL_HOOK = f"""WITH {_MODEL} SELECT id AS entity_id, number || ': ' || length(coalesce(body_text, '')) || ' characters' AS body_text FROM m"""
