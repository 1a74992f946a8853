"""Problems 3, 4 and 6: orphan references, hierarchies, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.hierarchy import descendants, hierarchy
from lexloom.operators.orphans import broken_references
from lexloom.operators.snapshots import snapshot_changes
from lexloom.plans import Registry
from lexloom.tables import Scratch, table

R = Registry()
S = T.sql


def _cross_references(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "cross_refs")
        .where(T.strip_blanks(F.col("target_section_label")) != "")
        .select(
            F.lit("code_sections").alias("parent_table"), F.col("code_edition_id").alias("scope"),
            F.coalesce(T.section_key(F.col("target_section_label")), F.lit("")).alias("ref"), T.instant(F.col("fetched_at")).alias("at"),
            F.col("xref_id").cast("string").alias("child"), "report_id",
        )
        .distinct()
    )


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "ingest_reports")
        .select(
            F.lit("code_editions").alias("parent_table"), F.lit("").alias("scope"), F.coalesce("edition_entity_id", F.lit("")).alias("ref"),
            T.instant(F.col("run_at")).alias("at"), F.col("report_id").alias("child"), F.col("cross_references_unresolved_skipped").alias("skipped"),
        )
        .distinct()
    )


def orphans(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "code_sections").select(
        F.lit("code_sections").alias("parent_table"), F.col("code_edition_id").alias("scope"), T.section_key(F.col("section_number")).alias("ref"),
        T.instant(F.col("fetched_at")).alias("since"), T.instant(F.col("removed_at")).alias("until"),
    )
    none = F.lit(None).cast("timestamp")
    editions = table(spark, d, "code_editions").select(
        F.lit("code_editions").alias("parent_table"), F.lit("").alias("scope"), F.col("entity_id").alias("ref"), none.alias("since"), none.alias("until")
    )
    refs, reports = _cross_references(spark, d), _reports(spark, d)
    children = refs.select("parent_table", "scope", "ref", "at", "child", "report_id").unionByName(
        reports.select("parent_table", "scope", "ref", "at", "child", F.lit(None).cast("string").alias("report_id"))
    )
    scratch = Scratch(spark, "orphans")
    broken = scratch.save(broken_references(children, sections.unionByName(editions)), "broken")
    month = T.month_utc(F.col("at")).alias("period_month")
    from_refs = broken.where("parent_table = 'code_sections'")
    skipped = from_refs.groupBy(F.col("report_id").alias("r")).agg(F.count_distinct("child").alias("n"))
    miscounted = reports.where("skipped is not null").join(skipped, F.col("child") == F.col("r"), "left").where("skipped != coalesce(n, 0)")
    return (
        from_refs.select(F.lit("cross_refs").alias("ref_table"), F.col("child").alias("ref_key"), month, "reason")
        .unionByName(broken.where("parent_table = 'code_editions'").select(F.lit("ingest_reports").alias("ref_table"), F.col("child").alias("ref_key"), month, "reason"))
        .unionByName(miscounted.select(F.lit("ingest_reports").alias("ref_table"), F.col("child").alias("ref_key"), month, F.lit("miscount").alias("reason")))
        .distinct()
    )


P3 = f"""
WITH refs AS (
  SELECT DISTINCT xref_id, report_id, code_edition_id AS ed, coalesce({S.section_key('target_section_label')}, '') AS k, {S.instant('fetched_at')} AS made
  FROM cross_refs WHERE {S.strip_blanks('target_section_label')} <> ''),
secs AS (
  SELECT code_edition_id AS ed, {S.section_key('section_number')} AS k, min({S.instant('fetched_at')}) AS since, max({S.instant('removed_at')}) AS until_
  FROM code_sections GROUP BY 1, 2 HAVING k IS NOT NULL),
j AS (SELECT refs.*, secs.k AS pk, since, until_ FROM refs LEFT JOIN secs ON refs.ed IS NOT DISTINCT FROM secs.ed AND refs.k = secs.k),
bad AS (
  SELECT xref_id, report_id, made, 'missing' AS reason FROM j WHERE pk IS NULL
  UNION SELECT xref_id, report_id, made, 'late' FROM j WHERE since > made
  UNION SELECT xref_id, report_id, made, 'deleted' FROM j WHERE until_ <= made),
reps AS (SELECT DISTINCT report_id, edition_entity_id, {S.instant('run_at')} AS made, cross_references_unresolved_skipped AS skipped FROM ingest_reports),
n AS (SELECT report_id, count(DISTINCT xref_id) AS n FROM bad GROUP BY 1),
found AS (
  SELECT 'cross_refs' AS ref_table, cast(xref_id AS VARCHAR) AS ref_key, {S.month('made')} AS period_month, reason FROM bad
  UNION SELECT 'ingest_reports', report_id, {S.month('made')}, 'missing' FROM reps WHERE NOT EXISTS (SELECT 1 FROM code_editions e WHERE e.entity_id = edition_entity_id)
  UNION SELECT 'ingest_reports', reps.report_id, {S.month('made')}, 'miscount' FROM reps LEFT JOIN n ON n.report_id = reps.report_id
        WHERE skipped IS NOT NULL AND skipped <> coalesce(n, 0))
"""


@R.query("p3_found", P3 + "SELECT ref_table, ref_key, period_month, reason FROM found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d)


@R.query("p3_by_period", P3 + "SELECT ref_table, period_month, reason, count(*) AS n_orphans FROM found GROUP BY ALL")
def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).groupBy("ref_table", "period_month", "reason").agg(F.count("*").alias("n_orphans"))


def _toc_nodes(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "toc_nodes").select(F.col("id"), T.strip_blanks(F.col("parent_id")).alias("p"), T.instant(F.col("fetched_at")).alias("t"))
    return latest.groupBy("id").agg(F.max(F.struct("t", "p"))["p"].alias("parent"))


def _legacy_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "legacy_atoms").select(
        "id", F.struct("fetched_at", "jurisdiction_key", "code_book", "edition", T.outline_key(F.col("section_number")).alias("num"), T.outline_key(F.col("parent_section")).alias("up")).alias("r")
    )
    latest = rows.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*")
    book = ["jurisdiction_key", "code_book", "edition"]
    parents = latest.where("num is not null").groupBy(*(F.col(c).alias(f"p_{c}") for c in book), F.col("num").alias("p_num")).agg(F.min("id").alias("parent"))
    same = F.col("up") == F.col("p_num")
    for c in book:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return latest.join(parents, same, "left").select("id", "parent")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Both tables climb together: one forest, ids told apart by the table's name."""
    sep = "\x1f"
    toc, legacy = _toc_nodes(spark, d), _legacy_nodes(spark, d)
    tagged = [x.select(*(F.concat(F.lit(t + sep), c).alias(c) for c in ("id", "parent"))) for t, x in (("toc_nodes", toc), ("legacy_atoms", legacy))]
    forest = hierarchy(tagged[0].unionByName(tagged[1]), Scratch(spark, "hierarchy"))
    bare = lambda c: F.regexp_replace(c, f"(?:toc_nodes|legacy_atoms){sep}", "")
    return forest.select(
        F.substring_index("id", sep, 1).alias("node_table"), bare("id").alias("node_id"), "state", bare("root_id").alias("root_id"), "depth", "n_descendants", bare("path").alias("path"), "lft", "rgt"
    )


P4 = f"""
WITH RECURSIVE toc AS (
  SELECT id, {S.strip_blanks('parent_id')} AS p FROM toc_nodes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY {S.instant('fetched_at')} DESC, p DESC NULLS LAST) = 1),
leg AS (
  SELECT id, jurisdiction_key AS a, code_book AS b, edition AS c, {S.outline_key('section_number')} AS num, {S.outline_key('parent_section')} AS up FROM legacy_atoms
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) = 1),
par AS (SELECT a, b, c, num, min(id) AS pid FROM leg WHERE num IS NOT NULL GROUP BY 1, 2, 3, 4),
nodes AS (
  SELECT 'toc_nodes' AS t, toc.id, x.id AS p FROM toc LEFT JOIN toc x ON x.id = toc.p
  UNION ALL
  SELECT 'legacy_atoms', leg.id, pid FROM leg LEFT JOIN par ON leg.up = par.num AND leg.a IS NOT DISTINCT FROM par.a AND leg.b IS NOT DISTINCT FROM par.b AND leg.c IS NOT DISTINCT FROM par.c),
climb AS (
  SELECT t, id AS node, p AS cur, [id] AS chain, false AS looped FROM nodes
  UNION ALL
  SELECT climb.t, node, n.p, list_prepend(climb.cur, chain), list_contains(chain, climb.cur)
  FROM climb JOIN nodes n ON n.t = climb.t AND n.id = climb.cur WHERE NOT looped),
ends AS (SELECT t, node, chain, looped FROM climb WHERE cur IS NULL OR looped),
ok AS (SELECT t, node, chain FROM ends WHERE NOT looped),
kids AS (SELECT t, a AS node, count(*) AS n FROM (SELECT t, unnest(chain[:-2]) AS a FROM ok) GROUP BY 1, 2),
placed AS (
  SELECT ends.t AS node_table, ends.node AS node_id,
    CASE WHEN NOT looped THEN 'ok' WHEN chain[1] = ends.node THEN 'cycle' ELSE 'below-cycle' END AS state,
    CASE WHEN looped THEN '' ELSE chain[1] END AS root_id, CASE WHEN looped THEN -1 ELSE len(chain) - 1 END AS depth,
    CASE WHEN looped THEN -1 ELSE coalesce(kids.n, 0) END AS n_descendants, CASE WHEN looped THEN '' ELSE array_to_string(chain, '>') END AS path
  FROM ends LEFT JOIN kids ON kids.t = ends.t AND kids.node = ends.node)
"""


@R.query("p4_found", P4 + "SELECT * FROM placed")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).drop("lft", "rgt")


@R.query("p4_descendants", P4 + "SELECT t AS node_table, unnest(chain[:-2]) AS ancestor_id, node AS descendant_id FROM ok")
def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node, by nested-set ranges."""
    f = _places(spark, d).where("state = 'ok'").select("node_table", "root_id", F.col("node_id").alias("id"), "lft", "rgt")
    return descendants(f, ["node_table", "root_id"]).select("node_table", F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"))


@R.query("p4_ranges")
def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of every node, as ranges: b is below a when table and root are equal and
    ``a.lft < b.lft <= a.rgt``. The numbers follow no order that SQL could give, so it has no twin."""
    return _places(spark, d).where("state = 'ok'").select("node_table", "root_id", "node_id", "lft", "rgt")


@R.query(
    "p6_found",
    f"""
WITH latest AS (
  SELECT jurisdiction_tenant AS o, snapshot_no AS n, entity_id AS k, {S.hash_key('content_hash')} AS v FROM section_snapshots
  WHERE snapshot_no IS NOT NULL AND entity_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o, n, k ORDER BY {S.instant('fetched_at')} DESC NULLS LAST, v DESC NULLS LAST) = 1),
steps AS (SELECT o, n, lag(n) OVER (PARTITION BY o ORDER BY n) AS before FROM (SELECT DISTINCT o, n FROM latest)),
now AS (SELECT latest.o, latest.n, k, v FROM latest JOIN steps ON latest.o = steps.o AND latest.n = steps.n WHERE before IS NOT NULL),
was AS (SELECT latest.o, steps.n, k, v FROM latest JOIN steps ON latest.o = steps.o AND latest.n = steps.before)
SELECT coalesce(now.n, was.n) AS snapshot_no, coalesce(now.k, was.k) AS entity_id,
  CASE WHEN was.k IS NULL THEN 'added' WHEN now.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM now FULL JOIN was ON now.o = was.o AND now.n = was.n AND now.k = was.k
WHERE was.k IS NULL OR now.k IS NULL OR now.v <> was.v
""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "section_snapshots"),
        owner=F.col("jurisdiction_tenant"), snapshot=F.col("snapshot_no"), key=F.col("entity_id"),
        version=T.hash_key(F.col("content_hash")), order=T.instant(F.col("fetched_at")),
    )
