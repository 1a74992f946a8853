"""Per-document text statistics, and prose told from lists, tables and junk.

Layout says what a line is: columns show as delimiters in the same number or at the same place down
the page, entries as markers, leaders or references with few words, and both as lines of similar
length or indentation repeating at a short period. Word, symbol and punctuation ratios then tell
readable text from debris.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.spread import spread
from lexloom.llm.words import WORD

STATS = {
    "n_words": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "line_end_ratio": "double", "common_ratio": "double",
    "n_lines": "bigint", "distinct_ratio": "double", "row_ratio": "double", "entry_ratio": "double", "alignment": "double",
    "indent_period": "double", "length_autocorrelation": "double", "odd_ratio": "double",
}

_MARK = re.compile(r"\s*(?:[-–—*•·▪◦‣o○●]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,6})[.)])\s+(?=\S)")
_SECTION = re.compile(r"\s*(?:§+|(?:sec|section|chapter|ch|art|article|artículo|part|division|subdivision|title)\b\.?)\s*[\w.-]*\d[\w.-]*\s*[.:—-]?\s+\S", re.I)
_LEADER = re.compile(r"\S.*?(?:\.\s?){4,}\s*[\divxlc-]+\s*$|\S.*?_{4,}\s*\d*\s*$", re.I)
_REFERENCES = re.compile(r"\s*\S[^,;]*(?:[,;]\s*§?\s*[A-Z]?\d+(?:[-.–:]\d+)+(?:\(\w+\))*)+\s*$")
_NUMBERED = re.compile(r"\s*\d+(?:[-.]\d+)+\.?\s+\S")
_ENDS = (".", "!", "?", ":", ";", "…")
_NEW_SENTENCE = re.compile(r"[.!?]\s+[A-ZÁÉÍÓÚÀÂÇÉÈÊ]")
_FULL_STOP = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")
_TAGS = re.compile(r"<[^<>\n]{0,300}>")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ]", re.I)
_CODE = re.compile(r"[{}]|\)\s*;|\w\s*=\s*\w|=>|\bfunction\b|\breturn\b|://|</")
_BROKEN = re.compile("[�■□]|[ÃÂâ](?=[\u0080-¿€™œž‘-•˜…])|[\u0000-\u0008\u000e-\u001f\u007f]")


@dataclass(frozen=True)
class Quality:
    #: Words held by the most distinct texts, by which the share of common words is measured.
    common: int = 200
    #: Least share of the non-empty lines that makes a document a list or table.
    most: float = 0.5
    #: Least share of the characters that those lines must hold; below it they are a short
    #: enumeration in prose.
    least_chars: float = 0.4
    #: Least autocorrelation or likeness of short lines by which lines without marker or delimiter
    #: are entries, and least share of them that aligned rows must have.
    period: float = 0.6
    #: A readable word is held by this share of the distinct texts. From ``few`` of them on it is
    #: held by two at least; with fewer every word is readable, and vowels, symbols, tags and
    #: repetition alone tell junk.
    least_share: float = 0.0005
    few: int = 50
    #: A word is also readable that this share of the texts of one language hold, five at least: as
    #: other languages grow, it stays so. A language is the first two letters of its code, and counts
    #: from this share of all texts on, so that there are at most 1 / ``language`` of them.
    language_share: float = 0.01
    language: float = 0.001


def _fields(line: str, sign: str) -> list[str]:
    if sign == "  ":
        return re.split(r" {2,}|\t+", line.strip())
    if sign == "|":
        line = line.strip().strip("|")
    return line.split(sign)


def _short(fields: list[str]) -> bool:
    return all(len(f.split()) <= 5 for f in fields)


def _columns(lines: list[str]) -> tuple[np.ndarray, float]:
    """Which lines are rows of columns, and how well their delimiters align."""
    best, best_align = np.zeros(len(lines), bool), 0.0
    for sign, least in (("|", 1), ("\t", 1), ("  ", 1), (";", 2), (",", 2)):
        if sum(x.count(sign) >= least or sign == "  " and "\t" in x for x in lines) < 2:
            continue
        split = [_fields(x, sign) for x in lines]
        n = np.array([len(f) - 1 for f in split])
        fit = np.array([k >= 1 and _short(f) for k, f in zip(n, split)])
        if sign in ",;":
            # Columns set apart by one character need cells: most of them numbers or codes.
            cells = [sum(any(c.isdigit() for c in y) or len(y.split()) <= 1 for y in f[1:]) for f in split]
            fit &= (n >= 2) & np.array([k >= 0.6 * max(1, len(f) - 1) for k, f in zip(cells, split)])
        if not fit.any():
            continue
        if sign == "  ":
            # Runs of blanks: the same number of cells, or a cell starting where others do.
            starts = [{m.end() for m in re.finditer(r" {2,}|\t+", x)} for x in lines]
            common = Counter(s for k, f in zip(starts, fit) if f for s in k)
            at = {s for s, c in common.items() if c >= max(2, 0.3 * fit.sum())}
            modal = Counter(n[fit].tolist()).most_common(1)[0][0]
            rows = fit & np.array([bool(k & at) or c == modal for k, c in zip(starts, n)])
        else:
            modal = Counter(n[fit].tolist()).most_common(1)[0][0]
            # A cut row may lack cells at its end.
            rows = fit & (n <= modal) & (n >= min(modal, max(1, modal - 1)))
        if rows.sum() < 2:
            continue
        align = rows.mean() * (n[rows] == modal).mean()
        if align > best_align:
            best, best_align = rows, float(align)
    return best, best_align


def _entry(line: str, points: bool) -> bool:
    """One entry of an enumeration, a table of contents or an index; ``points`` tells that the line
    has a leader or references."""
    if points:
        return True
    m = _MARK.match(line) or _NUMBERED.match(line)
    words_ = len(line.split())
    if m:
        rest = line[m.end():] if m.re is _MARK else line
        # Lettered paragraphs of whole sentences are prose.
        return words_ <= 14 and not (words_ > 7 and _FULL_STOP.search(rest)) and not _NEW_SENTENCE.search(rest)
    if words_ <= 14 and _SECTION.match(line):
        return not (words_ > 10 and _FULL_STOP.search(line))
    return False


class _Kinds(dict):
    """What each word is, remembered up to a bound: 1 for more than digits, 2 for letters only, 4
    for letters with a vowel."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        k = self[w] = (not w.isdigit()) + (w.isalpha() and 2 + 4 * bool(_VOWEL.search(w)))
        return k


_KIND = _Kinds()


def _ends(line: str) -> bool:
    """Whether a line ends like a sentence."""
    return line.rstrip().rstrip("\"'”’»)]")[-1:] in _ENDS


def _autocorrelation(x: np.ndarray) -> float:
    """Largest autocorrelation at the periods 1 to 4."""
    if len(x) < 6:
        return 0.0
    y = x - x.mean()
    v = float((y * y).sum())
    if v == 0:
        return 1.0
    return max(float((y[k:] * y[:-k]).sum() / v) for k in range(1, 5))


def _near_lengths(x: np.ndarray) -> float:
    """How alike the lengths of lines are: 1 when all are equal."""
    return float(1 / (1 + x.std() / x.mean())) if len(x) > 1 and x.mean() > 0 else 0.0


def _periodic(lines: list[str], size: np.ndarray, indent: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and entries that only repeat in layout, without marker or delimiter, and how well they do.

    Both are short lines that carry no sentence on. Rows are those with words starting at the places
    where most of them have one, in a page with figures; of the others indentation or length repeats.
    """
    n, none = len(lines), np.zeros(len(lines), bool)
    words_ = np.array([len(x.split()) for x in lines])
    ends = np.array([_ends(x) for x in lines], bool)
    lower = np.array([x.lstrip()[0].islower() for x in lines], bool)
    # Lower-case lines go on with a sentence, unless all are single names or indentation repeats.
    names = lower.mean() >= 0.9 and words_.mean() <= 3 or indent.std() > 0 and _autocorrelation(indent) >= 0.6
    carried = none if names else lower & np.append(False, ~ends[:-1])
    short = (words_ <= 6) & ~ends & ~carried & ~np.append(carried[1:], False)
    if short.sum() < max(6, 0.5 * n):
        return none, none, 0.0
    starts = [{m.end() for m in re.finditer(r"(?<=\S) +(?=\S)", x)} if s else set() for x, s in zip(lines, short)]
    at = {p for p, c in Counter(p for x in starts for p in x).items() if c >= 0.8 * short.sum()}
    rows = short & np.array([bool(at) and at <= x for x in starts], bool)
    figures = np.array([any(c.isdigit() for p in at for c in x[p:].split(" ", 1)[0]) for x in lines], bool)
    if rows.any() and figures[rows].mean() >= 0.5:
        return rows, none, float(rows.sum() / short.sum())
    x = indent[short]
    return none, short, max(_autocorrelation(x) if x.any() else 0.0, _autocorrelation(size[short]), _near_lengths(size[short]))


def describe(text: str | None, readable: set[str], common: set[str]) -> dict[str, float]:
    text = text or ""
    ws = WORD.findall(text.lower())
    counts, letters = Counter(ws), sum(map(len, ws))
    kinds = [(_KIND[w], n) for w, n in counts.items()]
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    solid = sum(map(len, text.split()))
    n_solid = max(1, solid)
    rows, align = _columns(lines) if len(lines) > 1 else (np.zeros(len(lines), bool), 0.0)
    leaders = [("." in x or "_" in x) and bool(_LEADER.match(x)) for x in lines]
    references = [("," in x or ";" in x) and bool(_REFERENCES.match(x)) for x in lines]
    points = [a or b for a, b in zip(leaders, references)]
    listed = np.array([_entry(x, p) for x, p in zip(lines, points)], bool)
    size = np.array([len(x) for x in lines], float)
    indent = np.array([len(x) - len(x.lstrip()) for x in lines], float)
    odd = len(_BROKEN.findall(text)) + (sum(map(len, _TAGS.findall(text))) if "<" in text else 0)
    if rows.sum() > listed.sum() and sum(points) < 0.5 * listed.sum() or not listed.any():
        listed &= ~rows
    else:
        rows &= ~listed
    n = max(1, len(lines))
    period_rows, period_entries, period = _periodic(lines, size, indent) if len(lines) >= 6 else (rows & False, rows & False, 0.0)
    known = [w for w in counts.keys() & readable if _KIND[w] & 1]
    return {
        "n_words": len(ws), "mean_word_length": letters / max(1, len(ws)), "symbol_ratio": max(0, solid - letters) / n_solid,
        "line_end_ratio": sum(map(_ends, lines)) / n,
        "common_ratio": sum(counts[w] for w in counts.keys() & common) / max(1, len(ws)), "n_lines": len(lines), "distinct_ratio": len(counts) / max(1, len(ws)),
        "row_ratio": float(rows.sum()) / n, "entry_ratio": float(listed.sum()) / n, "alignment": align,
        "indent_period": _autocorrelation(indent) if indent.any() else 0.0, "length_autocorrelation": max(_autocorrelation(size), _near_lengths(size)),
        "odd_ratio": odd / n_solid,
        "readable_ratio": sum(counts[w] for w in known) / max(1, sum(c for k, c in kinds if k & 1)),
        "vowel_ratio": sum(c for k, c in kinds if k & 4) / max(1, sum(c for k, c in kinds if k & 2)),
        "code_ratio": sum(bool(_CODE.search(x)) for x in lines) / n,
        "long_ratio": sum(len(w) * c for w, c in counts.items() if len(w) > 30) / n_solid,
        "laid_out": float(size[rows | listed].sum() / size.sum()) if lines else 0.0,
        "period": period, "period_rows": float(period_rows.sum()) / n, "period_entries": float(period_entries.sum()) / n,
        "period_chars": float(size[period_rows | period_entries].sum() / size.sum()) if lines else 0.0,
    }


def classify(f: dict[str, float], cfg: Quality) -> str:
    """``prose``, ``list``, ``table`` or ``junk``; ``prose`` also for texts without any line."""
    if not f["n_lines"]:
        return "prose"
    layout = max(f["row_ratio"], f["entry_ratio"])
    laid_out = layout > cfg.most and f["laid_out"] >= cfg.least_chars
    if f["odd_ratio"] > 0.1 or f["long_ratio"] > 0.3 or f["code_ratio"] > 0.6 and f["symbol_ratio"] > 0.1:
        return "junk"
    if not laid_out:
        unread = f["readable_ratio"] < 0.5 or f["vowel_ratio"] < 0.4 or f["n_words"] == 0
        repeats = f["n_words"] >= 8 and f["distinct_ratio"] < 0.12 and f["distinct_ratio"] * f["n_words"] < 40
        if not repeats and f["line_end_ratio"] <= 0.3 and f["period"] >= cfg.period and f["period_chars"] >= cfg.least_chars:
            if max(f["period_rows"], f["row_ratio"]) > cfg.most:
                return "table"
            if f["period_entries"] > cfg.most and f["vowel_ratio"] >= 0.4 and (f["readable_ratio"] >= 0.3 or f["common_ratio"] > 0):
                return "list"
        return "junk" if unread or repeats else "prose"
    if f["row_ratio"] > f["entry_ratio"]:
        return "table"
    return "list" if f["readable_ratio"] >= 0.3 or f["common_ratio"] > 0 else "junk"


def text_statistics(docs: DataFrame, cfg: Quality = Quality()) -> DataFrame:
    """``doc_id``, the statistics of ``STATS`` and ``kind`` for every row of ``docs (doc_id, text, ...)``.

    Null, empty and blank texts have zeros and kind ``prose``. Whole texts are read. Readable and
    common words are counted over all distinct texts, so copies count once; where there is a column
    ``lang``, readable words are also counted by language. No number of words caps the readable: at
    most (distinct words in a text, on average) / ``least_share`` can have the share, and as many by
    ``language_share`` in each language. Repeated rows come out as often as they go in.
    """
    spark = docs.sparkSession
    source = spread(docs.select("doc_id", "text"), "doc_id")
    lang = F.lower(F.substring(F.trim("lang"), 1, 2)) if "lang" in docs.columns else F.lit(None).cast("string")
    # One language is kept for each distinct text.
    texts = docs.where("text is not null").groupBy("text").agg(F.min(lang).alias("lang"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    held = texts.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(tokens).alias("w")).where("w rlike '[^0-9]'").groupBy("lang", "w").agg(F.count("*").alias("n"))
    # The rollup has the number of all texts under a null language.
    counted = texts.rollup(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.orderBy(F.desc("n"), F.asc_nulls_first("lang")).limit(math.ceil(1 / cfg.language) + 1).collect()}
    n_texts = sizes.pop(None, 0)
    least = 1 if n_texts < cfg.few else max(2, cfg.least_share * n_texts)
    own = [(k, max(5.0, cfg.language_share * n)) for k, n in sizes.items() if k and n >= cfg.language * n_texts]
    held = held.join(F.broadcast(spark.createDataFrame(own, "lang string, own double")), "lang", "left")
    words = held.groupBy("w").agg(F.sum("n").alias("n"), F.max(F.coalesce(F.col("n") >= F.col("own"), F.lit(False))).alias("own"))
    known = [tuple(r) for r in words.where((F.col("n") >= least) | F.col("own")).orderBy(F.desc("n"), "w").select("w").collect()]
    shared = spark.sparkContext.broadcast(({w for (w,) in known}, {w for (w,) in known[: cfg.common]}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readable, common = shared.value
        for b in batches:
            found = [describe(t.as_py(), readable, common) for t in b.column(1)]
            cols = [b.column(0)]
            cols += [pa.array([f[k] for f in found], pa.int64() if t == "bigint" else pa.float64()) for k, t in STATS.items()]
            cols.append(pa.array([classify(f, cfg) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *STATS, "kind"])

    return source.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} {t}" for k, t in STATS.items()) + ", kind string")
