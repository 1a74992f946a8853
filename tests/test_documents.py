"""Readers, trees and records on re-authored pages."""

from pyspark.sql import functions as F

from lexloom.operators import atomize, migrate, modelcode, references, store, tree
from lexloom.operators.numbering import numbered
from lexloom.sources import files, markup, pages
from lexloom.tables import Scratch

PAGE = """<html><head><meta name="publication-date" content="2021-05-01"><meta name="jurisdiction-name" content="Rivertown"></head><body>
<h1 id="c1">Chapter 1 General</h1><h3 id="s1">§ 1.01 — Purpose</h3><p>This code applies. See § 1.02(a) for terms.<p data-subsection="(a)">Second paragraph.
<script>var x = "</p><p>not text</p>";</script><dl><dt>Shed</dt><dd>A small building.</dd><dt>Empty</dt><dd> </dd></dl>
<h3 id="s2">§ 1.02 — Terms</h3><p>Terms are set.</p>
<aside class="amendment"><span class="ordinance-id">ORD-7</span><span class="effective-date">2022-01-01</span><span class="authority">Council</span> Amends § 1.01 and section 9.99.</aside></body></html>"""
META = [("p", "rivertown", "Rivertown", "2021 Code", "2021-05-01", "2021-06-01T00:00:00Z", "html", "https://x.example", None)]


def built(spark, html=PAGE):
    b = markup.html_blocks(spark.createDataFrame([("p", html), ("none", None)], "page string, html string"))
    return tree.build_tree(markup.with_references(b)), spark.createDataFrame(META, atomize.META)


def test_blocks(spark):
    b = markup.html_blocks(spark.createDataFrame([("p", PAGE)], "page string, html string")).orderBy("pos").collect()
    assert [(r.kind, r.depth) for r in b] == [("heading", 1), ("heading", 3), ("paragraph", None), ("paragraph", None), ("definition", None), ("heading", 3), ("paragraph", None), ("amendment-record", None)]
    assert b[3].label == "(a)" and "not text" not in b[3].text and b[4].label == "Shed"
    assert b[7].label == "ORD-7" and b[7].extra["effective_date"] == "2022-01-01"
    m = markup.page_metadata(spark.createDataFrame([("p", PAGE)], "page string, html string")).first()
    assert (m.publication_date, m.jurisdiction_name) == ("2021-05-01", "Rivertown")


def test_records_end_to_end(spark):
    t, meta = built(spark)
    secs = atomize.sections(t, meta)
    s = {r.section_number: r for r in secs.collect()}
    assert s["1.01"].entity_id == "rivertown/2021-code/1-01"
    assert s["1.01"].title == "Purpose" and s["1.01"].body_text.startswith("This code applies. See § 1.02(a) for terms.\nSecond")
    x = atomize.cross_references(t, secs, meta).collect()
    assert [(r.from_section_id, r.to_section_id, r.reference_type) for r in x] == [("rivertown/2021-code/1-01", "rivertown/2021-code/1-02", "see")]
    d = atomize.definitions(t, secs, meta).first()
    assert (d.term, d.scope, d.defining_section_id) == ("Shed", "section", "rivertown/2021-code/1-01")
    amends = atomize.amendments(t, secs, meta)
    a = amends.first()
    assert a.affected_section_ids == ["rivertown/2021-code/1-01"] and a.entity_id == "rivertown/ord-7"
    e = atomize.editions(secs, amends, meta).first()
    assert e.section_ids == ["rivertown/2021-code/1-01", "rivertown/2021-code/1-02"] and e.effective_from == "2021-05-01" and len(e.content_hash) == 64
    kinds = sorted(r.link_type for r in atomize.links(secs, atomize.definitions(t, secs, meta), atomize.cross_references(t, secs, meta), amends, atomize.corpora(meta)).collect())
    assert kinds == ["amends", "contains", "contains", "contains", "defines", "see-also"]
    q = tree.quality(t).where("page = 'p'").first()
    assert (q.sections, q.cross_references, q.definitions, q.amendments, q.viable) == (2, 1, 1, 1, True)


def test_ids_shared_by_anchors_are_rekeyed(spark):
    html = "".join(f'<h2 id="a{i}">Article {i} X</h2><h3 id="CH1_ART{i}_S1">Sec. 1. Same</h3><p>t{i}</p>' for i in (1, 2))
    t, meta = built(spark, html)
    ids = {r.entity_id for r in atomize.sections(t, meta).collect()}
    assert ids == {"rivertown/2021-code/ch1-art1/1", "rivertown/2021-code/ch1-art2/1"}
    same = html.replace("ART2_S1", "ART1_S1")
    t, meta = built(spark, same)
    assert {r.entity_id for r in atomize.sections(t, meta).collect()} == {"rivertown/2021-code/1"}


def test_subsections(spark):
    t, meta = built(spark, "<h4>lost text</h4><p>gone</p><h3>§ 2.1 Title</h3><p>own</p><h4>a. Part</h4><p>below</p>")
    got = {(r.section_number, r.subsection_path, r.body_text) for r in atomize.sections(t, meta).collect()}
    assert got == {("2.1", None, "own"), ("2.1a.", "a.", "below")}


def test_section_layout_and_discovery(spark):
    html = '<div class="section" id="x1"><div class="heading">1-1 Name</div><div class="body"><p>One</p><p> </p><p>Two</p></div></div><a href="/codes/river/">River</a><a href="/other/">No</a>'
    df = spark.createDataFrame([("p", html)], "page string, html string")
    assert [r.text for r in markup.html_blocks(df, "section").orderBy("pos").collect()] == ["1-1 Name", "One", "Two"]
    r = markup.discover(df, "https://h.example", "TX").collect()
    assert [(x.source_id, x.jurisdiction_tenant, x.source_url) for x in r] == [("river", "river-tx", "https://h.example/codes/river/")]


def walk(spark, texts, convention, ignore=None):
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "page string, page_no int, text string")
    return [(r.kind, r.depth, r.text, r.label) for r in pages.page_blocks(df, convention, ignore).orderBy("pos").collect()]


def test_capital_pages(spark):
    one = "CHAPTER 1 GENERAL\n1 of 2\nCHAPTER 1 - GENERAL\nARTICLE 1.1 SCOPE\nAND REACH\nSEC. 1.1.001 TITLE\nSEC. 1.1.002 OTHER 12\n(a) First rule.\n(1) Under it.\n(b) Second."
    got = walk(spark, [one, "CHAPTER 1 GENERAL\nplain words"], "caps-prefixed")
    assert got == [
        ("heading", 1, "Chapter 1 GENERAL", None), ("heading", 2, "Article 1.1 SCOPE AND REACH", None), ("heading", 3, "Sec. 1.1.001 TITLE", None),
        ("paragraph", None, "First rule.", "(a)"), ("paragraph", None, "Under it.", "(a)(1)"), ("paragraph", None, "Second.", "(b)"), ("paragraph", None, "plain words", None),
    ]


def test_decimal_pages(spark):
    got = walk(spark, ["Contents\n10.101 Title 4\n10.102 Other 5", "Chapter 10 Rules § 10.101\n10.101 Title\nBody text.\n17", "Chapter 10 Rules § 10.2\nmore\nChapter 11 Next § 1\nlast"], "decimal-numbered")
    assert got == [("heading", 1, "Chapter 10 Rules", None), ("heading", 3, "10.101 Title", None), ("paragraph", None, "Body text.", None), ("paragraph", None, "more", None), ("heading", 1, "Chapter 11 Next", None), ("paragraph", None, "last", None)]


def test_chapter_decimal_pages(spark):
    got = walk(spark, ["TABLE OF CONTENTS\n1.1 Scope 2\nCHAPTER 1 - GENERAL 2", "CHAPTER 1 - GENERAL\n1.1 Scope\n1 - 3\n2.5 acres\nWords.", "CHAPTER 2 - NEXT\n2.1 More"], "chapter-decimal")
    assert got == [("heading", 1, "Chapter 1 GENERAL", None), ("heading", 3, "1.1 Scope", None), ("paragraph", None, "2.5 acres", None), ("paragraph", None, "Words.", None), ("heading", 1, "Chapter 2 NEXT", None), ("heading", 3, "2.1 More", None)]


def test_model_code(spark):
    sec = '{"sectionId":"s%d","sectionNumber":"%s","heading":"%s","viewerUrl":null,"content":[{"kind":"prose","text":"%s"},{"kind":"table","caption":"T","headers":["h"],"rows":[["1"]]}],"definedTerms":[{"term":"Deck","definition":"A floor."}]}'
    one, two = sec % (1, "R201", "Terms", "Build in accordance with Section R301.1(2)."), sec % (2, "R301.1", "Loads", "See Table R999.")
    doc = f'{{"title":{{"codeAbbrev":"RC","name":"Home Code","year":2021}},"chapters":[{{"chapter":{{"chapterId":"c2","chapterNumber":"2","heading":"Definitions"}},"sections":[{one}]}},{{"chapter":{{"chapterId":"c3","chapterNumber":"3","heading":"Planning"}},"sections":[{two}]}}]}}'
    docs = modelcode.read_documents(spark.createDataFrame([("d", doc), ("bad", None)], "doc string, body string"))
    flat = modelcode.flat_sections(docs, "model", "https://v.example/")
    s = {r.section_number: r for r in modelcode.sections(flat).collect()}
    assert s["R201"].entity_id == "model/2021-home-code/r201" and s["R201"].verbatim_text_deep_link == "https://v.example/RC2021#R201"
    assert "1 table" in s["R201"].body_text and "defines 1 term (Deck)" in s["R201"].body_text and "Build" not in s["R201"].body_text
    x = {r.reference_text: (r.to_section_id, r.reference_type, r.link_type) for r in modelcode.cross_references(flat).collect()}
    assert x == {"Section R301.1(2)": ("model/2021-home-code/r301-1", "subject-to", "subject-to"), "Table R999": ("", "see", "see-also")}
    assert {(r.scope) for r in modelcode.definitions(flat).collect()} == {"code", "section"}
    assert [r.kind for r in modelcode.blocks(docs).where("page = 'd'").orderBy("pos").collect()] == ["heading", "heading", "paragraph", "table", "definition"] + ["heading", "heading", "paragraph", "table", "definition"]


def test_line_rebuild(spark):
    rows = [("d", 1, 1, "Sec. 1", 700.0), ("d", 1, 2, "Title", 699.0), ("d", 1, 3, "next", 680.0), ("d", 1, 4, " line", None), ("d", 1, 5, None, 1.0), ("d", 1, 6, "end", 650.0)]
    got = pages.rebuild_lines(spark.createDataFrame(rows, "page string, page_no int, item_no int, str string, y double")).first()
    assert got.text == "Sec. 1 Title\nnext line\nend"


def test_null_and_empty(spark):
    empty = spark.createDataFrame([], "page string, html string")
    assert markup.html_blocks(empty).count() == 0
    t = tree.build_tree(markup.with_references(markup.html_blocks(empty)))
    assert atomize.sections(t, spark.createDataFrame(META, atomize.META)).count() == 0
    assert tree.quality(t).count() == 0


def test_references_in_bodies(spark):
    body = "See § 1-2(a) and, subject to section 1-2, also § 9-9. Section 1-3 is amended."
    rows = [("t/e/1-1", "t/e", "§ 1-1", body, 1), ("t/e/1-2", "t/e", "Sec. 1-2", None, 2), ("t/e/1-3", "t/e", "1-3", "", 3), ("u/e/9-9", "u/e", "9-9", "none", 4)]
    good, bad = references.sniff(spark.createDataFrame(rows, "entity_id string, code_edition_id string, section_number string, body_text string, seq int"))
    got = {r.reference_text: r for r in good.collect()}
    assert {k: r.to_section_id for k, r in got.items()} == {"§ 1-2(a)": "t/e/1-2", "Section 1-3": "t/e/1-3"}
    assert got["§ 1-2(a)"].reference_context == body[: 4 + 8 + 60].strip() and got["§ 1-2(a)"].reference_type == "subject-to"
    assert sorted(r.entity_id for r in good.collect()) == ["t/e/t-e-1-1/xref-1", "t/e/t-e-1-1/xref-2"]
    assert [(r.from_section_id, r.label) for r in bad.collect()] == [("t/e/1-1", "9-9")]
    links = spark.createDataFrame([("code-section", "a", "code-section", "b", "cites", None), ("code-edition", "e", "code-section", "b", "contains", None)], "from_type string, from_id string, to_type string, to_id string, link_type string, context string")
    assert sorted(r.link_type for r in references.replace_links(links, good).collect()) == sorted(["contains", *(r.link_type for r in got.values())])


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    got = files.read_blocks(spark, f"file://{tmp_path}/*.html")
    assert got.count() == 8 and got.where("kind = 'definition'").first().label == "Shed"
    raw = spark.createDataFrame([("good", b"one|two"), ("scan", b""), ("bad", b"!"), ("null", None)], "path string, content binary")
    rows = files.extract_pages(raw, lambda b: [x for x in b.decode().split("|")] if b != b"!" else 1 / 0, lambda b: "ocr").collect()
    assert sorted((r.page, r.page_no, r.text) for r in rows if r.text) == [("good", 1, "one"), ("good", 2, "two"), ("scan", 1, "ocr")]
    assert [r.page for r in rows if r.error] == ["bad"]


def test_units_ranges_and_status(spark):
    one = spark.range(2)
    df, why = migrate.run_units({"a": lambda: one, "b": lambda: one.limit(0), "c": lambda: 1 / 0, "d": lambda: one.withColumn("x", one["id"])})
    assert df.groupBy("unit_id").count().count() == 2 and why == {"b": "no rows", "c": "division by zero"}
    r = spark.createDataFrame([("4",), ("2-6",), ("x",), (None,)], "s string").select("s", migrate.page_range(F.col("s")).alias("p")).collect()
    assert {x.s: tuple(x.p) for x in r} == {"4": (4, 4), "2-6": (2, 6), "x": (1, 3), None: (1, 3)}
    q = spark.createDataFrame([("q1", "draft", None, None), ("q2", "draft", "old", "t0")], "query_id string, status string, human_reviewed_by string, human_reviewed_at string")
    u = spark.createDataFrame([("q1", "approved", "me", "t1"), ("q2", "rejected", None, "t2"), ("none", "x", "y", "z")], "query_id string, status string, reviewer string, reviewed_at string")
    assert sorted(tuple(x) for x in store.set_status(q, u, "query_id").collect()) == [("q1", "approved", "me", "t1"), ("q2", "rejected", "old", "t0")]


def test_numbers_of_large_groups(spark):
    """Numbers along sorted partitions are those of one window; null keys are a group."""
    x = spark.range(0, 3000, 1, 5).selectExpr("if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('g', id % 7))) as g", "(id * 7919) % 3000 as o", "id as payload")
    got = numbered(x, ["g"], ["o"], "n", Scratch(spark, "t"))
    want = numbered(x, ["g"], ["o"], "n", None)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
    assert numbered(x.limit(0), ["g"], ["o"], "n", Scratch(spark, "t")).count() == 0


def test_parts_of_a_page_make_the_same_tree(spark):
    """Read in parts or as one value, a page gives the same headings over each block."""
    docs = [("p", n, f"n{n}", f"Article {n}", i, f"d{n}{i}", f"§ {n}-{i} — Uses", f"<p>(a) See § {n}-1 of it.<p>More." if i % 3 else "") for n in range(3) for i in range(5)]
    df = spark.createDataFrame(docs, "page string, node_ord int, node_id string, node_heading string, doc_ord int, doc_id string, title string, content string")
    shape = lambda t: [(r.kind, r.text, [h.title for h in r.path], r.near_section) for r in t.orderBy("pos", "sub").collect()]
    whole = tree.build_tree(markup.with_references(markup.html_blocks(markup.assemble_html(df))))
    parts = tree.build_tree(markup.with_references(markup.html_blocks(markup.fragments(df, Scratch(spark, "t")))))
    assert shape(parts) == shape(whole) and len(shape(whole)) > 30
