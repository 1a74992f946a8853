"""Identifiers, labels and hashes of records. ``sql`` has the same as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import BLANKS

#: DID method of the identifiers built here; a deployment sets its own.
DID_METHOD = "lex"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def slug(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def normal_label(c: Column) -> Column:
    """A section label without its parenthesised parts."""
    return trim_all(F.regexp_replace(c, r"\([^)]*\)", ""))


def bare_label(c: Column) -> Column:
    """A label without a leading section sign or division word."""
    x = F.regexp_replace(c, f"^§[{BLANKS}]*", "")
    return trim_all(F.regexp_replace(x, f"(?i)^(section|sec\\.?|chapter|ch\\.?|article|art\\.?|division|div\\.?)[{BLANKS}]+", ""))


def no_end_marks(c: Column) -> Column:
    return F.regexp_replace(c, "[.,;:!?]+$", "")


def edition_id(tenant: Column, label: Column) -> Column:
    return F.concat(tenant, F.lit("/"), slug(label))


def section_id(edition: Column, label: Column) -> Column:
    """``edition`` is tenant and edition slug joined by a slash."""
    return F.concat(edition, F.lit("/"), slug(normal_label(label)))


def did(entity_type: Column, entity_id: Column) -> Column:
    return F.concat(F.lit(f"did:{DID_METHOD}:"), entity_type, F.lit(":"), entity_id)


def did_parts(c: Column) -> Column:
    """Struct of method, entity type and local id (which may hold colons); null when it is none."""
    p = F.split(c, ":", 4)
    ok = (F.size(p) == 4) & (F.get(p, 0) == "did") & F.get(p, 2).rlike("^[a-z]+(-[a-z0-9]+)*$") & (F.length(F.get(p, 3)) > 0)
    return F.when(ok, F.struct(F.get(p, 1).alias("method"), F.get(p, 2).alias("entity_type"), F.get(p, 3).alias("entity_id")))


def cid(content_hash: Column) -> Column:
    return F.concat(F.lit("bafy-"), content_hash)


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts without separators; null parts are empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def anchor_path(anchor: Column) -> Column:
    """The container part of a source anchor as a slug: all but the last ``_`` segment, else the
    whole; null when nothing is left."""
    raw = F.regexp_replace(anchor, "^#", "")
    held = F.when(raw.contains("_"), F.nullif(slug(F.regexp_replace(raw, "_[^_]*$", "")), F.lit("")))
    return F.coalesce(held, F.nullif(slug(raw), F.lit("")))


def url_component(c: Column) -> Column:
    """Percent encoding of a URL component, with blanks as %20 and ``! ' ( ) * ~`` kept."""
    x = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def file_slug(url: Column) -> Column:
    """Name of a document from its address: without host and extension, as a slug."""
    return slug(F.regexp_replace(F.lower(F.regexp_replace(url, "(?i)^https?://[^/]+/", "")), r"\.[a-z0-9]+$", ""))


def effective_from(label: Column, fallback: Column) -> Column:
    """First day named by an edition label: ``m/yy`` or ``m/yyyy`` (month held to 1-12), else a year
    19xx or 20xx, else the fallback; as ISO text."""
    word = r"(?<![A-Za-z0-9_])"
    month = F.regexp_extract(label, rf"{word}(\d{{1,2}})/(\d{{2,4}})(?![A-Za-z0-9_])", 1)
    year = F.regexp_extract(label, rf"{word}(\d{{1,2}})/(\d{{2,4}})(?![A-Za-z0-9_])", 2)
    plain = F.regexp_extract(label, rf"{word}((?:19|20)\d{{2}})(?![A-Za-z0-9_])", 1)
    m = F.greatest(F.lit(1), F.least(F.lit(12), month.try_cast("int")))
    y = year.try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    iso = lambda yy, mm: F.format_string("%04d-%02d-01T00:00:00.000Z", yy, mm)
    return F.when(month != "", iso(y, m)).when(plain != "", iso(plain.try_cast("int"), F.lit(1))).otherwise(fallback)


#: Kinds of reference by the first phrase found, in this order.
REFERENCE_PHRASES = (
    ("notwithstanding", "notwithstanding"), ("subject to", "subject-to"), ("as defined in", "as-defined-in"), ("amends?", "amends"), ("supersedes?", "supersedes"), ("see", "see"),
)
#: The same for model-code text.
MODEL_REFERENCE_PHRASES = (
    ("notwithstanding", "notwithstanding"), ("subject to", "subject-to"), ("as defined in", "as-defined-in"), ("in accordance with", "subject-to"), ("see", "see"),
)
#: The link that a kind of reference makes.
LINK_OF_REFERENCE = {
    "see": "see-also", "notwithstanding": "see-also", "subject-to": "subject-to", "as-defined-in": "as-defined-in", "amends": "amends", "supersedes": "supersedes", "unknown": "cites",
}


def reference_type(text: Column, phrases: tuple = REFERENCE_PHRASES) -> Column:
    out = None
    for phrase, kind in phrases:
        hit = text.rlike(f"(?i)(?<![A-Za-z0-9_]){phrase}(?![A-Za-z0-9_])")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def link_type(kind: Column) -> Column:
    out = None
    for k, link in LINK_OF_REFERENCE.items():
        out = F.when(kind == k, link) if out is None else out.when(kind == k, link)
    return out.otherwise("cites")


class sql:
    @staticmethod
    def trim_all(x: str) -> str:
        return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"

    @staticmethod
    def slug(x: str) -> str:
        return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"

    @staticmethod
    def file_slug(x: str) -> str:
        return sql.slug(rf"regexp_replace(lower(regexp_replace({x}, '^https?://[^/]+/', '', 'i')), '\.[a-z0-9]+$', '')")

    @staticmethod
    def normal_label(x: str) -> str:
        return sql.trim_all(rf"regexp_replace({x}, '\([^)]*\)', '', 'g')")

    @staticmethod
    def bare_label(x: str) -> str:
        y = f"regexp_replace({x}, '^§[{BLANKS}]*', '')"
        return sql.trim_all(rf"regexp_replace({y}, '^(section|sec\.?|chapter|ch\.?|article|art\.?|division|div\.?)[{BLANKS}]+', '', 'i')")

    @staticmethod
    def no_end_marks(x: str) -> str:
        return f"regexp_replace({x}, '[.,;:!?]+$', '')"

    @staticmethod
    def did(entity_type: str, entity_id: str) -> str:
        return f"('did:{DID_METHOD}:' || {entity_type} || ':' || {entity_id})"

    @staticmethod
    def content_hash(*parts: str) -> str:
        return "sha256(" + " || ".join(f"coalesce({p}, '')" for p in parts) + ")"

    @staticmethod
    def reference_type(x: str, phrases: tuple = REFERENCE_PHRASES) -> str:
        cases = " ".join(rf"WHEN regexp_matches({x}, '\b{p}\b', 'i') THEN '{k}'" for p, k in phrases)
        return f"CASE {cases} ELSE 'unknown' END"

    @staticmethod
    def link_type(x: str) -> str:
        return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LINK_OF_REFERENCE.items()) + " ELSE 'cites' END"

    @staticmethod
    def effective_from(label: str, fallback: str) -> str:
        m = rf"regexp_extract({label}, '\b(\d{{1,2}})/(\d{{2,4}})\b', 1)"
        y = rf"regexp_extract({label}, '\b(\d{{1,2}})/(\d{{2,4}})\b', 2)"
        p = rf"regexp_extract({label}, '\b((?:19|20)\d{{2}})\b', 1)"
        return (
            f"CASE WHEN {m} <> '' THEN printf('%04d-%02d-01T00:00:00.000Z', CASE WHEN try_cast({y} AS INT) < 100 THEN try_cast({y} AS INT) + 2000 ELSE try_cast({y} AS INT) END, "
            f"greatest(1, least(12, try_cast({m} AS INT)))) WHEN {p} <> '' THEN printf('%04d-01-01T00:00:00.000Z', try_cast({p} AS INT)) ELSE {fallback} END"
        )
