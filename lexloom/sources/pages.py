"""Page text of paper sources to block streams.

A convention is a small table: which lines are headings of which depth, whether they must be in
capitals, whether text counts before the first heading. One walker reads them all. The walk depends
on what came before on earlier pages, so a document is one group; documents are spread over tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.sources.markup import BLOCKS


@dataclass(frozen=True)
class Head:
    """A heading line: group 1 its label, group 2 its title. ``caps``: least share of capitals."""

    depth: int
    word: str
    pattern: re.Pattern
    caps: float = 0.0
    once: bool = False
    wraps: bool = False
    #: Counts only where the label differs from the last one of this kind.
    changes: bool = False
    #: Shown word in the block's text.
    shown: str = ""


@dataclass(frozen=True)
class Convention:
    heads: tuple[Head, ...]
    ignore: tuple[re.Pattern, ...] = ()
    #: Lines of a contents list: headings that end in a page number.
    contents: str = "skip"
    #: Nothing counts before the first heading that is no contents line.
    latch: bool = False
    subsections: bool = False
    #: Titles that make a section-like line plain text.
    not_title: re.Pattern | None = None
    options: dict = field(default_factory=dict)


#: Page number at a contents line's end, page marks, lettered and numbered subsections.
_TAIL = re.compile(r"\s\d{1,4}$")
_MARKER = re.compile(r"^\s*\d+\s+of\s+\d+\s*$")
_SUB = re.compile(r"^\(([A-Za-z]+)\)\s+(.+)$")
_NESTED = re.compile(r"^\((\d+)\)\s+(.+)$")
_C = re.compile

#: The heading patterns of the three conventions.
CONVENTIONS = {
    "caps-prefixed": Convention(
        heads=(
            Head(1, "chapter", _C(r"^CHAPTER\s+([\w.-]+)\s*[:\-—–]?\s*(.*?)\s*$", re.I), caps=1.0, once=True, shown="Chapter "),
            Head(2, "article", _C(r"^ARTICLE\s+([\w.-]+)(?:\s+(.*?))?\s*$", re.I), caps=0.7, once=True, wraps=True, shown="Article "),
            Head(3, "section", _C(r"^(?:SEC\.?|SECTION)\s+([\w.-]+)(?:\s+(.*?))?\s*$", re.I), caps=0.7, wraps=True, shown="Sec. "),
        ),
        ignore=(_C(r"^(?:\s*\d+\s+of\s+\d+\s*$|INTRODUCTION\s*$)", re.I),),
        subsections=True,
    ),
    "decimal-numbered": Convention(
        heads=(
            Head(1, "chapter", _C(r"^Chapter\s+(\d+)\s+(.+?)\s+§\s*\d", re.I), changes=True, shown="Chapter "),
            Head(3, "section", _C(r"^§?\s*(10\.\d{3,}(?:\.\d+)*)\s+(\S.*)$")),
        ),
        ignore=(_C(r"^(?:Revised\s+[A-Za-z]+\s+\d{4}|Contents|\d{1,4})$", re.I),),
        contents="look-ahead",
        latch=True,
    ),
    "chapter-decimal": Convention(
        heads=(
            Head(1, "chapter", _C(r"^CHAPTER\s+(\d+)\s*[-–—:]\s*(.+?)\s*$", re.I), caps=1.0, changes=True, shown="Chapter "),
            Head(3, "section", _C(r"^§?\s*(\d{1,2}(?:\.\d{1,3}){1,5})\s+(\S.*)$")),
        ),
        ignore=(_C(r"^TABLE OF CONTENTS$", re.I), _C(r"^\d{1,2}\s*[-–—]\s*\d{1,4}$")),
        latch=True,
        not_title=_C(r"^(?:[^A-Za-z]*|acres?|feet|foot|ft|miles?|inch(?:es)?|percent|sf|du)$", re.I),
    ),
}


def capitals(line: str) -> float:
    letters = [c for c in line if c.isascii() and c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else -1.0


def _slug(s: str) -> str:
    return re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", s.lower()))


class _Walk:
    def __init__(self, c: Convention, ignore: re.Pattern | None):
        self.c, self.ignore = c, ((ignore,) if ignore is not None and not c.latch else c.ignore + ((ignore,) if ignore is not None else ()))
        self.seen: set[tuple[str, str]] = set()
        self.last: dict[str, str] = {}
        self.started = not c.latch
        self.sub: str | None = None
        self.out: list[tuple] = []

    def head(self, line: str) -> tuple[Head, re.Match] | None:
        for h in self.c.heads:
            m = h.pattern.match(line)
            if m and (h.caps == 0 or capitals(line) >= h.caps):
                return h, m
        return None

    def like_head(self, line: str) -> bool:
        return any(h.pattern.match(line) for h in self.c.heads)

    def continues(self, line: str) -> bool:
        """A wrapped title: capitals that are nothing else."""
        return bool(line) and capitals(line) >= 0.7 and not (self.like_head(line) or _MARKER.match(line) or _SUB.match(line) or _NESTED.match(line))

    def text(self, line: str, label: str | None) -> None:
        if line.strip():
            self.out.append(("paragraph", None, line.strip(), None, label))

    def page(self, number: int, text: str) -> None:
        lines = [x.strip() for x in re.split(r"\n+", text or "")]
        if self.c.subsections:
            while len(lines) >= 2 and self.like_head(lines[0]) and _MARKER.match(lines[1]):
                lines = lines[2:]
        i = 0
        while i < len(lines):
            i = self.line(number, lines, i) + 1

    def line(self, number: int, lines: list[str], i: int) -> int:
        """Reads line i and returns the last line it took."""
        line, c = lines[i], self.c
        if not line:
            return i
        found = self.head(line)
        tail = bool(_TAIL.search(line))
        moves = bool(found and found[0].changes)
        if c.latch:
            if moves and not (tail and c.contents == "skip"):
                self.started = True
            elif found and not tail:
                self.started = True
            if moves and tail and c.contents == "skip" or not self.started:
                return i
        if not moves and any(p.match(line) for p in self.ignore):
            return i
        if c.contents == "skip" and tail and (found or not c.latch and self.like_head(line)):
            return i
        if c.contents == "look-ahead" and found and tail and not moves:
            nxt = next((x for x in lines[i + 1 :] if x), "")
            if nxt and self.like_head(nxt):
                return i
        if not found:
            if c.subsections and (m := _SUB.match(line)):
                self.sub = f"({m.group(1)})"
                self.text(m.group(2), self.sub)
            elif c.subsections and (m := _NESTED.match(line)):
                self.text(m.group(2), f"{self.sub or ''}({m.group(1)})")
            else:
                self.text(line, self.sub if c.subsections else None)
            return i
        h, m = found
        label, title = m.group(1) or "", (m.group(2) or "").strip()
        if c.not_title and h.depth == 3 and c.not_title.match(title):
            self.text(line, None)
            return i
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        wrapped = h.wraps and self.continues(nxt)
        if wrapped and _TAIL.search(nxt):
            return i + 1
        if h.once and (h.word, label) in self.seen or h.changes and self.last.get(h.word) == label:
            self.sub = None
            return i
        self.seen.add((h.word, label))
        self.last[h.word] = label
        self.sub = None
        if wrapped:
            title = f"{title} {nxt}" if title else nxt
        spaced = f" {title}" if title or not (h.depth == 1) else ""
        self.out.append(("heading", h.depth, f"{h.shown}{label}{spaced}", f"#p{number}-{h.word}-{_slug(label)}", None))
        return i + 1 if wrapped else i


def page_blocks(pages: DataFrame, convention: str = "caps-prefixed", ignore: str | None = None) -> DataFrame:
    """Block stream of ``pages (page string, page_no int, text string)``, ``page`` being the document.
    Null pages are empty ones."""
    rule, skip = CONVENTIONS[convention], re.compile(ignore, re.I) if ignore else None

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        w = _Walk(rule, skip)
        doc = doc.sort_values("page_no", kind="stable")
        for n, text in zip(doc["page_no"], doc["text"]):
            w.page(n, text or "")
        name = doc["page"].iloc[0]
        rows = [(name, i, *b, {}) for i, b in enumerate(w.out)]
        return pd.DataFrame(rows, columns=["page", "pos", "kind", "depth", "text", "anchor", "label", "extra"]).astype({"depth": "Int32"})

    return pages.select("page", "page_no", "text").groupBy("page").applyInPandas(run, BLOCKS)


def rebuild_lines(items: DataFrame, jump: float = 2.0) -> DataFrame:
    """Lines of pages from positioned text items ``(page, page_no, item_no, str, y)``: a new line where
    y moves by more than ``jump`` from the last known y; items of a line are joined by a blank
    unless either side has one. Result ``(page, page_no, text)``."""
    w = Window.partitionBy("page", "page_no").orderBy("item_no")
    before = F.last("y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.when(before.isNotNull() & F.col("y").isNotNull() & (F.abs(F.col("y") - before) > jump), 1).otherwise(0)
    x = items.where("str is not null").withColumn("b", breaks).withColumn("line", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = x.groupBy("page", "page_no", "line").agg(F.array_sort(F.collect_list(F.struct("item_no", "str"))).alias("s"))
    glue = F.aggregate("s", F.lit(""), lambda a, e: F.when((F.length(a) > 0) & ~a.rlike(r"\s$") & ~e["str"].rlike(r"^\s"), F.concat(a, F.lit(" "), e["str"])).otherwise(F.concat(a, e["str"])))
    lines = parts.select("page", "page_no", "line", F.trim(glue).alias("t")).where("t != ''")
    return lines.groupBy("page", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("text"))
