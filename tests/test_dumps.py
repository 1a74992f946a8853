"""Dumps, curated queries, model-code hooks and whole migrations on small cases."""

from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators import curated, evaluate, graph, migrate, modelcode, search, store
from lexloom.sources import dumps, markup
from lexloom.tables import Scratch


def test_products_jobs_and_placeholders(spark):
    two = '[{"productName": "Code of Ordinances", "productId": 1}, {"productName": "Unified Development Code", "productId": 2, "publicationId": null}]'
    c = spark.createDataFrame([("a", two), ("b", "[]"), ("c", None), ("d", "no json")], "client string, body string")
    assert [tuple(r) for r in dumps.choose_products(c).collect()] == [("a", 1, "Code of Ordinances")]
    assert [r.product_id for r in dumps.choose_products(c, "(?i)unified").collect()] == [2] and dumps.choose_products(c, "zoning").count() == 0
    j = spark.createDataFrame([(1, "j1", "old", 1), (1, "j2", "new", 2), (2, "j3", None, None)], "product_id int, job_id string, name string, w int")
    assert {r.product_id: r.job_id for r in dumps.latest_jobs(j, [F.col("w"), F.col("job_id")]).collect()} == {1: "j2", 2: "j3"}
    p = spark.createDataFrame([("a", "<p>x</p>"), ("b", None), ("c", " ")], "page string, html string")
    got = {r.page: r.html for r in dumps.with_placeholder(p, "gone").collect()}
    assert got["a"] == "<p>x</p>" and got["b"] == got["c"] == "<html><body><!-- gone --></body></html>"


def test_envelopes_to_blocks(spark):
    doc = lambda i, t, c, o: f'{{"Id": "{i}", "Title": "{t}", "Content": {c}, "DocOrderId": {o}}}'
    env = [
        ("p", 0, "n0", "Article 1", f'{{"Docs": [{doc("d2", "§ 2 — Second", chr(34) + "<p>Two." + chr(34), 2)}, {doc("d1", "§ 1 — First", chr(34) + "<p>One. See § 2." + chr(34), 1)}, {doc("d0", "Empty", "null", 0)}]}}'),
        ("p", 1, "n1", "Article 2", f'{{"Docs": [{doc("d2", "§ 2 — Second", chr(34) + "<p>Two again." + chr(34), 2)}, {doc("d3", "§ 3 — Third", chr(34) + "<p>Three." + chr(34), 3)}]}}'),
        ("q", 0, "n0", "Nothing", None), ("r", 0, "n0", "Broken", "{"),
    ]
    docs = dumps.envelope_docs(spark.createDataFrame(env, "page string, node_ord int, node_id string, node_heading string, body string"))
    blocks = markup.html_blocks(markup.fragments(docs, Scratch(spark, "t"))).orderBy("page", "pos").collect()
    assert [b.text for b in blocks] == ["Article 1", "§ 1 — First", "One. See § 2.", "§ 2 — Second", "Two.", "Article 2", "§ 3 — Third", "Three."]


def test_curated_drafts(spark):
    d = spark.createDataFrame([("t", "udc", "2020", "§ 1-1(a)", "q1", None), ("t", "ord", "2020", None, "q2", "lookup"), ("u", "udc", "2020", "2", "q3", None)], "tenant string, book string, edition string, section_number string, query_text string, query_type string")
    every = {r.query_text: r for r in curated.compile_drafts(d, ["query_text"], Scratch(spark, "t")).collect()}
    assert every["q1"].query_id == "seed-t-udc-1" and every["q1"].expected_atom_did == "did:lex:code-section:t/udc-2020/1-1" and every["q2"].query_type == "lookup" and every["q3"].query_id == "seed-u-udc-3"
    some = curated.compile_drafts(d, ["query_text"], None, "t", ["ord"]).collect()
    assert [r.query_id for r in some] == ["seed-t-ord-1"] and curated.compile_drafts(d, ["query_text"], None, "nobody").count() == 0
    toc = spark.createDataFrame([("t", 1, "Fences"), ("t", 2, "Walls"), ("u", 1, "Sheds")], "tenant string, line_no bigint, heading string")
    ask = lambda x: x.assign(query_text=x["heading"] + "?", query_type="retrieval")
    counts = {r.jurisdiction_tenant: tuple(r)[1:] for r in curated.author_counts(curated.author(toc, ask, True, Scratch(spark, "t"))).collect()}
    assert counts == {"t": (2, 2, 2), "u": (1, 1, 0 + 1)}
    assert {r.status for r in curated.author(toc, ask, False, None).collect()} == {"approved"}


def test_model_code_edition_and_hook(spark):
    body = '{"title": {"codeAbbrev": "RC", "name": "Residential Code", "year": 2021}, "chapters": [{"chapter": {"chapterId": "c1", "chapterNumber": "1", "heading": "Scope"}, "sections": [{"sectionId": "s1", "sectionNumber": "R101", "heading": "Title", "content": [{"kind": "prose", "text": "One. See Section R102."}, {"kind": "table"}, {"kind": "prose", "text": "Two."}]}, {"sectionId": "s2", "sectionNumber": "R102", "heading": "More"}]}]}'
    docs = modelcode.read_documents(spark.createDataFrame([("d", body), ("bad", "{")], "doc string, body string"))
    flat = modelcode.flat_sections(docs, "model", "https://x/")
    plain = modelcode.sections(flat)
    e = {r.entity_id: r for r in modelcode.edition(docs, plain, "model", "https://x/").collect()}
    assert e["model/2021-residential-code"].section_ids == ["model/2021-residential-code/r101", "model/2021-residential-code/r102"] and e["model/2021-residential-code"].effective_from == "2021-01-01" and e["model/2021-residential-code"].amendment_ids == []
    own = {r.section_number: r.body_text for r in modelcode.sections(modelcode.reasoned(flat, lambda b: b["heading"] + "|" + b["text"])).collect()}
    assert own == {"R101": "Title|One. See Section R102.\n\nTwo.", "R102": "More|"}
    assert "One." not in {r.section_number: r.body_text for r in plain.collect()}["R101"]


def test_migration_report(spark):
    rows = spark.createDataFrame(
        [("1", "s", "t", "udc", "2020", "1-1", "A", "See § 1-2 and § 9-9.", "u", 2), ("2", "s", "t", "udc", "2020", "1-2", "B", "Text.", "u", 1), ("3", "s", "t", "udc", "2020", "1-2", "B later", "Text.", "u", 3), ("4", "x", "t", "udc", "2020", None, "C", "Text.", "u", 1), ("5", "x", "t", "old", "1999", "7", "D", " ", "u", 1)],
        "id string, source_id string, jurisdiction_key string, code_book string, edition string, section_number string, section_title string, body string, source_url string, fetched_at int",
    ).withColumn("fetched_at", F.timestamp_seconds("fetched_at"))
    sources = spark.createDataFrame([("s", "web")], "id string, source_name string")
    out = migrate.run(rows, sources, Scratch(spark, "t"))
    r = out["report"].first().asDict()
    assert r == {"sections_transformed": 2, "section_collisions": 1, "editions_synthesized": 1, "corpora_synthesized": 1, "cross_references_resolved": 1, "cross_references_unresolved_skipped": 1, "links_emitted": 4, "sections_dropped_null_section": 1, "sections_dropped_empty_body": 1}
    assert [tuple(x) for x in out["status"].select("jurisdiction_tenant", "atom_count", "quality_bar").collect()] == [("t", 2, "not-evaluated")]
    assert {x.title for x in out["sections"].collect()} == {"A", "B"}
    empty = migrate.run(rows.limit(0), sources, Scratch(spark, "t"), ["udc"])
    assert set(empty["report"].first().asDict().values()) == {0}


def test_links_shares_jobs_pins_and_samples(spark):
    l = spark.createDataFrame([("a", "derives-from"), ("b", "derived-from"), ("c", None)], "did string, link_type string")
    assert {r.did for r in graph.unknown_links(l).collect()} == {"b", "c"}
    e = spark.createDataFrame([("d1", "w", "x", "y", 1), ("d2", "w", "y", "z", 2), ("d3", "v", "z", "x", 2), ("d0", "w", "x", None, 2)], "did string, workspace_did string, from_user_did string, to_user_did string, shared_at int")
    assert [r.did for r in graph.shares(e, "w", "x").collect()] == ["d0", "d1"] and [r.did for r in graph.shares(e, user="z").collect()] == ["d2", "d3"] and graph.shares(e).count() == 4
    j = spark.createDataFrame([("1", "queued", "t"), ("2", "failed", "t"), ("3", "queued", None)], "id string, state string, jurisdiction_tenant string")
    assert [r.id for r in store.jobs_of(j, "queued", "t").collect()] == ["1"] and store.jobs_of(j).count() == 3
    p = store.pins(spark.createDataFrame([("c1", 2, "later"), ("c1", 1, "first"), ("c2", 1, "x")], "cid string, w int, body string"), "cid", [F.col("w")])
    assert {r.cid: r.body for r in p.collect()} == {"c1": "first", "c2": "x"}
    atoms = spark.createDataFrame([("t", "code-section", f"d{i}", i) for i in range(150)] + [("u", "code-edition", "e", 1)], "jurisdiction_tenant string, entity_type string, did string, seq int")
    assert evaluate.samples(atoms, 1000).count() == 101 and {r.did for r in evaluate.samples(atoms, 2).collect()} == {"d0", "d1", "e"}
    c = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", None, "c"), ("t", "", "d"), ("u", "1", "a")], "jurisdiction_tenant string, section_number string, did string")
    held = spark.createDataFrame([("t", "1", "a"), ("t", "2", "z"), ("t", None, "c"), ("t", "", "d"), ("t", "1", "a")], "jurisdiction_tenant string, section_number string, did string")
    assert {(r.jurisdiction_tenant, r.did): r.retrievable for r in evaluate.retrievable(c, held).collect()} == {("t", "a"): True, ("t", "b"): False, ("t", "c"): False, ("t", "d"): False, ("u", "a"): False}
    assert [r.total_candidates for r in search.with_total(atoms.limit(3)).collect()] == [3, 3, 3] and search.with_total(atoms.limit(0)).count() == 0
    s = spark.createDataFrame([("https://x.org/Docs/B3 Code (2025).PDF",), ("plain",), (None,)], "u string")
    assert [r[0] for r in s.select(I.file_slug(F.col("u"))).collect()] == ["docs-b3-code-2025", "plain", None]
