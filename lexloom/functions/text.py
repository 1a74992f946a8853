"""Text, label and instant expressions. Each has a SQL twin for the same meaning in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, usable in Java and RE2 patterns alike.
BLANKS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DASHES = r"[\p{Pd}\x{2212}]"

SECTION_WORDS = r"(?:sections?|sec|§)\.?"
CHAPTER_WORDS = r"(?:chapter|ch|sections?|sec|§)\.?"


def strip_blanks(c: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def instant(c: Column) -> Column:
    """ISO-8601 text as a timestamp; null where it is none."""
    return c.try_cast("timestamp")


def month_utc(c: Column) -> Column:
    """Month ``yyyy-MM`` of an instant in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM")


def section_key(c: Column) -> Column:
    """A section label without leading word or sign, bracketed parts, blanks, trailing
    punctuation, letter case and kind of dash; null when nothing is left."""
    x = F.regexp_replace(F.lower(c), DASHES, "-")
    x = F.regexp_replace(x, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    x = F.regexp_replace(x, f"[{BLANKS}]+", "")
    x = F.regexp_replace(x, f"^(?:{SECTION_WORDS})+", "")
    return F.nullif(F.regexp_replace(x, r"\p{P}+$", ""), F.lit(""))


def outline_key(c: Column) -> Column:
    """A chapter or section label without leading word or sign, blanks, trailing dots and
    letter case; null when nothing is left."""
    x = F.regexp_replace(F.lower(c), f"[{BLANKS}]+", "")
    x = F.regexp_replace(x, f"^(?:{CHAPTER_WORDS})+", "")
    return F.nullif(F.regexp_replace(x, r"\.+$", ""), F.lit(""))


def hash_key(c: Column) -> Column:
    """A content hash without letter case and the prefix ``sha256:``; null when empty."""
    return F.nullif(F.regexp_replace(F.lower(strip_blanks(c)), "^sha256:", ""), F.lit(""))


class sql:
    """The same expressions as DuckDB text."""

    @staticmethod
    def strip_blanks(x: str) -> str:
        return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"

    @staticmethod
    def instant(x: str) -> str:
        """Microseconds since 1970, UTC."""
        return f"epoch_us(try_cast({x} AS TIMESTAMPTZ))"

    @staticmethod
    def month(us: str) -> str:
        return f"strftime(make_timestamp({us}), '%Y-%m')"

    @staticmethod
    def section_key(x: str) -> str:
        y = f"regexp_replace(lower({x}), '{DASHES}', '-', 'g')"
        y = rf"regexp_replace({y}, '\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}', '', 'g')"
        y = f"regexp_replace({y}, '[{BLANKS}]+', '', 'g')"
        y = f"regexp_replace({y}, '^(?:{SECTION_WORDS})+', '')"
        return rf"nullif(regexp_replace({y}, '\p{{P}}+$', ''), '')"

    @staticmethod
    def outline_key(x: str) -> str:
        y = f"regexp_replace(lower({x}), '[{BLANKS}]+', '', 'g')"
        y = f"regexp_replace({y}, '^(?:{CHAPTER_WORDS})+', '')"
        return rf"nullif(regexp_replace({y}, '\.+$', ''), '')"

    @staticmethod
    def hash_key(x: str) -> str:
        return f"nullif(regexp_replace(lower({sql.strip_blanks(x)}), '^sha256:', ''), '')"
