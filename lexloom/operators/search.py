"""Token search with stable ranking, for one query and for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.ids import trim_all

DEFAULT_LIMIT, MOST = 25, 100


def clamp(limit: int | None) -> int:
    return max(1, min(DEFAULT_LIMIT if limit is None else limit, MOST))


def tokens(query: Column) -> Column:
    """Lower-case tokens of letters a-z, digits, dots and hyphens; single characters other than a
    digit are noise. Repeated tokens stay."""
    return F.filter(F.split(F.lower(query), "[^a-z0-9.-]+"), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]$"))


def snippet(kind: Column, a: dict[str, Column]) -> Column:
    """Text of a record that is searched."""
    text = lambda *p: F.concat(*(F.coalesce(x, F.lit("null")) if isinstance(x, Column) else F.lit(x) for x in p))
    return (
        F.when(kind == "code-section", text(a["section_number"], " ", a["title"], ". ", a["body_text"]))
        .when(kind == "code-definition", text(a["term"], " — ", a["definition_text"]))
        .when(kind == "code-cross-reference", text(a["reference_text"], " (", a["reference_type"], ")"))
        .when(kind == "code-amendment", text("Ordinance ", a["ordinance_id"], ": ", a["amendment_text"]))
        .when(kind == "code-edition", a["edition_label"])
        .otherwise(a["jurisdiction_name"])
    )


def score(q: Column, toks: Column, snip: Column, section_number: Column) -> Column:
    """Share of tokens that the snippet holds as substrings, and 0.25 more when the section's number
    is itself a token. An empty query scores 1; no match, or nothing but noise, is null."""
    low = F.lower(snip)
    hits = F.size(F.filter(toks, lambda t: F.contains(low, t)))
    number = F.regexp_replace(F.lower(section_number), "[.,;:!?]+$", "")
    stem = F.substring_index(number, "#", 1)
    anchored = (number != "") & (F.array_contains(toks, number) | ((stem != "") & (stem != number) & F.array_contains(toks, stem)))
    return F.when(F.length(q) == 0, F.lit(1.0)).when((F.size(toks) > 0) & (hits > 0), hits / F.size(toks) + F.when(F.coalesce(anchored, F.lit(False)), 0.25).otherwise(0.0))


def search(atoms: DataFrame, query: str | None = None, tenant: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """The best records of ``atoms (did, entity_type, entity_id, jurisdiction_tenant, section_number,
    snippet, seq)``; equal scores in order of first writing. Filters reach the scan, and the sort is
    a top-k over partitions."""
    if tenant:
        atoms = atoms.where(F.col("jurisdiction_tenant") == tenant)
    if kind:
        atoms = atoms.where(F.col("entity_type") == kind)
    q = trim_all(F.lower(F.lit(query or "")))
    scored = atoms.withColumn("score", score(q, tokens(q), F.col("snippet"), F.when(F.col("entity_type") == "code-section", F.col("section_number"))))
    return scored.where("score is not null").orderBy(F.desc("score"), "seq", "did").limit(clamp(limit)).drop("seq")


def with_total(page: DataFrame) -> DataFrame:
    """A page of results (at most MOST rows) with ``total_candidates``, the number of its rows."""
    return page.withColumn("total_candidates", F.count("*").over(Window.partitionBy()))


def search_many(atoms: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """First ``top`` records of every row of ``queries (query_id, tenant, q)`` within its tenant:
    ``(query_id, did, score, place)``. Joined by tenant; the ranking keeps a bounded heap per query
    in each partition (a filter on row_number becomes a window-group limit), so a tenant that holds
    much of the data is ranked in parts before it is shuffled."""
    q = queries.withColumn("_q", trim_all(F.lower(F.coalesce("q", F.lit(""))))).withColumn("_t", tokens(F.col("_q")))
    hit = atoms.join(q, atoms["jurisdiction_tenant"] == q["tenant"]).withColumn(
        "score", score(F.col("_q"), F.col("_t"), F.col("snippet"), F.when(F.col("entity_type") == "code-section", F.col("section_number")))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "did")
    return hit.where("score is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", "did", "score", "place")
