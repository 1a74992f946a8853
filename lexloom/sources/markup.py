"""HTML pages to block streams, and block streams' pages from table-of-contents dumps.

The tokenizer accepts what is commonly broken: unclosed paragraphs, tags inside scripts, stray end
tags. It runs in Python, Arrow batch by Arrow batch, one page at a time; all that follows is plain
column work.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators.numbering import numbered
from lexloom.tables import Scratch

BLOCKS = "page string, pos bigint, kind string, depth int, text string, anchor string, label string, extra map<string,string>"
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids if isinstance(k, str) or k.tag not in ("script", "style"))

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tag: str) -> None:
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and any(True for _ in self._open("p")):
            self._close("p")
        if tag in ("dt", "dd"):
            for t in ("dt", "dd"):
                if self.at.tag == t:
                    self._close(t)
        if tag == "li" and self.at.tag == "li":
            self._close("li")
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def _open(self, tag: str) -> Iterator[Node]:
        n = self.at
        while n is not None:
            if n.tag == tag:
                yield n
            n = n.up

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if any(True for _ in self._open(tag)):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _inside(n: Node, cls: str) -> str:
    return "".join(k.text() for k in n.walk() if cls in k.classes()).strip()


def code_page(html: str) -> list[tuple]:
    """Headings, paragraphs, definitions and amendment records of a page in document order."""
    out: list[tuple] = []
    for n in parse(html).walk():
        record = "amendment-record" in n.classes() or (n.tag == "aside" and "amendment" in n.classes())
        text = n.text().strip() if n.tag in _HEADINGS or n.tag == "p" or record else ""
        if n.tag in _HEADINGS:
            if text:
                anchor = f"#{n.attrs['id']}" if n.attrs.get("id") else None
                out.append(("heading", _HEADINGS[n.tag], text, anchor, None, {}))
        elif n.tag == "p":
            if text:
                out.append(("paragraph", None, text, None, n.attrs.get("data-subsection"), {}))
        elif n.tag == "dl":
            terms = [k for k in n.kids if isinstance(k, Node) and k.tag == "dt"]
            meanings = [k for k in n.kids if isinstance(k, Node) and k.tag == "dd"]
            for t, m in zip(terms, meanings):
                if t.text().strip() and m.text().strip():
                    out.append(("definition", None, m.text().strip(), None, t.text().strip(), {}))
        elif record:
            ordinance = _inside(n, "ordinance-id")
            if ordinance or text:
                out.append(("amendment-record", None, text, None, ordinance, {"effective_date": _inside(n, "effective-date"), "authority": _inside(n, "authority")}))
    return out


def section_page(html: str) -> list[tuple]:
    """Pages of ``.section`` elements: the first ``.heading`` at depth 3, then ``.body p``."""
    out: list[tuple] = []
    for sec in parse(html).walk():
        if "section" not in sec.classes():
            continue
        head = next((k.text().strip() for k in sec.walk() if "heading" in k.classes()), "")
        if head:
            out.append(("heading", 3, head, f"#{sec.attrs['id']}" if sec.attrs.get("id") else None, None, {}))
        for body in sec.walk():
            if "body" in body.classes():
                out += [("paragraph", None, p.text().strip(), None, None, {}) for p in body.walk() if p.tag == "p" and p.text().strip()]
    return out


#: Distance of the positions of two parts of a page.
PART = 1 << 24
READERS = {"code": code_page, "section": section_page}


def html_blocks(pages: DataFrame, layout: str = "code") -> DataFrame:
    """Block stream of ``pages (page string, html string)``. A null page gives no blocks. References
    stand in their own rows right after their paragraph; see ``with_references``. Where there is a
    column ``part`` a page comes in several rows, numbered from 1: each is read by itself, and its
    blocks are numbered from ``part`` times ``PART`` on."""
    read = READERS[layout]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, at * PART + i, *block) for p, at, html in zip(b["page"], b["part"], b["html"]) for i, block in enumerate(read(html or ""))]
            yield pd.DataFrame(rows, columns=["page", "pos", "kind", "depth", "text", "anchor", "label", "extra"]).astype({"depth": "Int32"})

    part = F.col("part").cast("bigint") if "part" in pages.columns else F.lit(0).cast("bigint")
    return pages.select("page", part.alias("part"), "html").mapInPandas(run, BLOCKS)


#: How citations look in paragraphs of HTML, of page text (three passes in this
#: order) and of model-code text.
CITATIONS = {
    "html": (r"(?i)§\s*([\w.()-]+)",),
    "page": (r"(?i)(?:§|Sec(?:tion)?\.?)\s*(\d[\w.()-]*)", r"(?i)(?<![A-Za-z0-9_])Article\s+(\d[\w.-]*)", r"(?i)(?<![A-Za-z0-9_])Chapter\s+(\d[\w.-]*)"),
    "model": (r"(?<![A-Za-z0-9_])(?:Sections?|Tables?|Chapters?|§)\s+([A-Z]?\d[\w.()-]*)",),
}


def citations(text: Column, style: str) -> Column:
    """Array of structs ``(whole, target)`` in the order of the passes. Page and model targets lose
    trailing punctuation."""
    found = []
    for p in CITATIONS[style]:
        whole, part = (F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in (0, 1))
        found.append(F.arrays_zip(whole.alias("whole"), part.alias("target")))
    both = F.concat(*found) if len(found) > 1 else found[0]
    if style == "html":
        return both
    return F.transform(both, lambda c: F.struct((I.no_end_marks(c["whole"]) if style == "model" else c["whole"]).alias("whole"), I.no_end_marks(c["target"]).alias("target")))


def with_references(blocks: DataFrame, style: str = "html") -> DataFrame:
    """The stream with a ``cross-reference`` row after its paragraph for each citation. Positions
    become pairs ``(pos, sub)``; text is the citation, label its target, extra the context."""
    own = blocks.withColumn("sub", F.lit(0))
    refs = blocks.where("kind = 'paragraph'").select("*", F.posexplode(citations(F.col("text"), style)).alias("k", "c")).where("c.target != ''")
    phrases = I.MODEL_REFERENCE_PHRASES if style == "model" else I.REFERENCE_PHRASES
    extra = F.create_map(F.lit("context"), F.col("text"), F.lit("reference_type"), I.reference_type(F.col("text"), phrases))
    refs = refs.select("page", "pos", F.lit("cross-reference").alias("kind"), F.lit(None).cast("int").alias("depth"), F.col("c.whole").alias("text"), F.lit(None).cast("string").alias("anchor"), F.col("c.target").alias("label"), extra.alias("extra"), (F.col("k") + 1).alias("sub"))
    return own.unionByName(refs)


def discover(pages: DataFrame, base_url: str, region: str) -> DataFrame:
    """Code references behind the anchors of index pages whose address holds ``/codes/``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for html in b["html"]:
                for a in parse(html or "").walk():
                    href, name = a.attrs.get("href", "") if a.tag == "a" else "", a.text().strip()
                    if "/codes/" in href and name:
                        rows.append((href, name))
            yield pd.DataFrame(rows, columns=["href", "name"])

    x = pages.select("html").mapInPandas(run, "href string, name string")
    return x.select(
        F.regexp_extract("href", r"^.*?/codes/(.*?)/?$", 1).alias("source_id"), I.slug(F.concat("name", F.lit(f"-{region.lower()}"))).alias("jurisdiction_tenant"),
        F.col("name").alias("edition_label"), F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base_url), "href")).alias("source_url"),
    ).where("source_id != ''")


def page_metadata(pages: DataFrame) -> DataFrame:
    """Publication date and jurisdiction name from meta tags; empty and null where absent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page"], b["html"]):
                meta = {n.attrs.get("name"): n.attrs.get("content") for n in parse(html or "").walk() if n.tag == "meta"}
                rows.append((page, meta.get("publication-date") or "", meta.get("jurisdiction-name")))
            yield pd.DataFrame(rows, columns=["page", "publication_date", "jurisdiction_name"])

    return pages.select("page", "html").mapInPandas(run, "page string, publication_date string, jurisdiction_name string")


def _escape(c: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fragments(docs: DataFrame, scratch: Scratch | None) -> DataFrame:
    """``(page, part, html)`` from ``docs`` as ``assemble_html`` takes them: the same page as parts
    that are each one document, the first of a node after the node's heading. No page is ever one
    value, so that it may hold any number of documents."""
    some = docs.where("coalesce(content, '') != ''")
    nodes = docs.groupBy("page", "node_ord", "node_id").agg(F.any_value("node_heading").alias("node_heading"))
    heading = F.concat(F.lit('<h2 id="'), _escape(F.col("node_id"), True), F.lit('">'), _escape(F.col("node_heading")), F.lit("</h2>"))
    body = F.concat(F.lit('<h3 id="'), _escape(F.col("doc_id"), True), F.lit('">'), _escape(F.col("title")), F.lit("</h3>\n"), "content")
    none = F.lit(None).cast(dict(docs.dtypes)["doc_ord"])
    rows = nodes.select("page", "node_ord", F.lit(0).alias("rank"), none.alias("doc_ord"), heading.alias("html")).unionByName(some.select("page", "node_ord", F.lit(1).alias("rank"), "doc_ord", body.alias("html")))
    return numbered(rows, ["page"], ["node_ord", "rank", "doc_ord", "html"], "part", scratch, "fragments").select("page", "part", "html")


def assemble_html(docs: DataFrame) -> DataFrame:
    """``(page, html)`` from ``docs (page, node_ord, node_id, node_heading, doc_ord, doc_id, title,
    content)``: a level-2 heading per node, a level-3 heading and the content per document with
    content. The page is one value; for those without bound see ``fragments``."""
    body = F.concat(F.lit('<h3 id="'), _escape(F.col("doc_id"), True), F.lit('">'), _escape(F.col("title")), F.lit("</h3>\n"), "content")
    per_node = docs.groupBy("page", "node_ord", "node_id", "node_heading").agg(F.array_sort(F.collect_list(F.when(F.coalesce("content", F.lit("")) != "", F.struct("doc_ord", body.alias("h"))))).alias("d"))
    node = F.concat(F.lit('<h2 id="'), _escape(F.col("node_id"), True), F.lit('">'), _escape(F.col("node_heading")), F.lit("</h2>"), F.array_join(F.transform("d", lambda s: s["h"]), "\n"))
    whole = per_node.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("node_ord", node.alias("h")))).alias("n"))
    return whole.select("page", F.concat(F.lit("<!doctype html><html><body>"), F.array_join(F.transform("n", lambda s: s["h"]), "\n"), F.lit("</body></html>")).alias("html"))


def library_url(base: str, place: Column, node: Column) -> Column:
    """Canonical address of a library, with the node's id where there is one."""
    url = F.concat(F.lit(base), place)
    return F.when(node.isNotNull(), F.concat(url, F.lit("?nodeId="), I.url_component(node))).otherwise(url)
