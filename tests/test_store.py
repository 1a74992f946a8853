"""Store, search, rules, folds, streams and the facade on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexloom import streaming
from lexloom.api import Engine
from lexloom.functions import ids as I
from lexloom.operators import drift, fold, graph, rules, search, store, summaries, validate


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dedupe_family(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "yyy"), ("a", 3, "zzz"), ("b", 1, None), (None, 1, "n")], "k string, t int, v string")
    assert values(store.upsert_last(df, ["k"], [F.col("t")]).where("k is not null"), "k", "v") == [("a", "zzz"), ("b", None)]
    assert values(store.keep_first(df, ["k"], [F.col("t")]).where("k = 'a'"), "v") == [("x",)]
    assert values(store.keep_longest(df, ["k"], "v", [F.col("t")]).where("k = 'a'"), "v") == [("yyy",)]
    assert store.upsert_last(df.limit(0), ["k"], [F.col("t")]).count() == 0
    log = spark.createDataFrame([("k", "r1", 1, 20), ("k", "r2", 2, 10), ("k", "r3", 3, 10), ("l", "r4", 1, 1)], "k string, id string, w int, age int")
    assert values(store.collision_log(log, "k", "id", [F.col("w")], [F.col("age")]), "kept_id", "dropped_id") == [("r2", "r1"), ("r2", "r3")]


def test_ids(spark):
    got = spark.range(1).select(
        I.slug(F.lit("Éa  B--c!")).alias("a"), I.normal_label(F.lit("5.04(b)(2) ")).alias("b"), I.bare_label(F.lit("Sec. 5.1")).alias("c"), I.anchor_path(F.lit("#CH1_ART2_S3")).alias("d"), I.anchor_path(F.lit("#")).alias("e"),
        I.effective_from(F.lit("rev. 13/16"), F.lit("f")).alias("f"), I.effective_from(F.lit("Code of 1998"), F.lit("f")).alias("g"), I.effective_from(F.lit("none"), F.lit("f")).alias("h"), I.url_component(F.lit("1.1 (a)~*")).alias("i"),
        I.did_parts(F.lit("did:lex:code-section:t/e/1:2")).alias("j"), I.did_parts(F.lit("did:x")).alias("k"),
    ).first()
    assert got[:9] == ("a-b-c", "5.04", "5.1", "ch1-art2", None, "2016-12-01T00:00:00.000Z", "1998-01-01T00:00:00.000Z", "f", "1.1%20(a)~*")
    assert got.j.entity_id == "t/e/1:2" and got.k is None


ATOM = "did string, entity_type string, entity_id string, jurisdiction_tenant string, section_number string, snippet string, seq long, content_hash string"


@pytest.fixture()
def atoms(spark):
    s = "code-section"
    return spark.createDataFrame(
        [("d1", s, "1", "t", "2.", "2. Short rule", 5, "h1"), ("d2", s, "2", "t", "9", "9 long " + "2 rule " * 50, 1, "h2"), ("d3", s, "3", "t", "4.4#part1", "4.4#part1 rule", 2, "h3"), ("d4", "code-edition", "4", "u", None, "Rule book", 3, "h4"), ("d5", s, "5", "t", None, None, 4, "h5")], ATOM
    )


def test_search(spark, atoms):
    dids = lambda *a, **k: [(r.did, round(r.score, 3)) for r in search.search(atoms, *a, **k).collect()]
    assert dids("2 rule", tenant="t")[0] == ("d1", 1.25)
    assert dids("4.4 rule")[0] == ("d3", 1.25)
    assert dids("rule") == [("d2", 1.0), ("d3", 1.0), ("d4", 1.0), ("d1", 1.0)]
    assert dids("a ( i )") == [] and len(dids("")) == 5 and len(dids("  ", limit=0)) == 1
    assert dids("rule", kind="code-edition") == [("d4", 1.0)]
    q = spark.createDataFrame([("q1", "t", "rule 9"), ("q2", "u", None), ("q3", "none", "x")], "query_id string, tenant string, q string")
    assert values(search.search_many(atoms, q, 2), "query_id", "did", "place") == [("q1", "d2", 1), ("q1", "d3", 2), ("q2", "d4", 1)]


def test_engine_and_snapshot(spark, atoms, tmp_path):
    links = spark.createDataFrame([("d4", "d1", "contains"), ("d4", "gone", "cites")], "from_did string, to_did string, link_type string")
    status = spark.createDataFrame([("t", "passing", None), ("u", "failing", "tenant-private")], "jurisdiction_tenant string, quality_bar string, access_policy string")
    path = f"file://{tmp_path}/snap"
    store.write_snapshot(path, {"atoms": atoms, "links": links, "status": status}, "2024-01-01T00:00:00Z", ["unit"])
    e = Engine.load(spark, path)
    assert e.ready()[0] == 200 and e.search("rule").count() == 4
    assert values(e.traverse("d4"), "to_did", "found") == [("d1", True), ("gone", False)]
    assert len(e.atom("d4").first().composition) == 2 and e.atom("none").count() == 0
    assert e.jurisdictions("tenant-private, what").count() == 1 and e.jurisdictions("what").count() == 2 and e.jurisdictions(passing_only=True).count() == 1
    assert values(graph.dangling(links, atoms), "to_did") == [("gone",)]
    for bad in ({"kind": "x"}, {"limit": 0}):
        with pytest.raises(ValueError):
            e.search("q", **bad)
    store.write_snapshot(f"{path}2", {"atoms": atoms}, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        Engine.load(spark, f"{path}2")


def test_effective_rules(spark):
    base = spark.createDataFrame([("t", "b1", "1", "One", "e"), ("t", "b2", "2", "Two", "e")], "jurisdiction_tenant string, base_id string, section_number string, title string, code_edition_id string")
    a = [("t", ["b1"], "2022-01-01", 2, "modify", "o2", "jurisdictional-overlay"), ("t", ["b1"], "2021-01-01", 1, "replace", "o1", "jurisdictional-overlay"), ("t", ["new"], "2021-01-01", 3, "add", "o3", "jurisdictional-overlay"), ("t", ["b2"], "2021-01-01", 4, "delete", "o4", "temporal")]
    got = {r.base_id: r for r in rules.effective_rules(base, spark.createDataFrame(a, "jurisdiction_tenant string, affected_section_ids array<string>, effective_date string, seq int, overlay_operation string, ordinance_id string, amendment_scope string")).collect()}
    assert (got["b1"].resolution, got["b1"].base_governs, got["b1"].n_overlays) == ("modified", False, 2)
    assert got["b1"].note == "§1 One: modified for t by 2 overlays (latest: ordinance o2, modify, effective 2022-01-01)."
    assert (got["b2"].resolution, got["b2"].base_governs) == ("base-only", True) and (got["new"].resolution, got["new"].base_governs) == ("added", False)


def test_drift_fold_nest(spark):
    a, b = (spark.createDataFrame(x, "section_id string, hash string") for x in ([("s", "1"), ("c", "1"), ("r", "1"), ("e", "")], [("s", "1"), ("c", "2"), ("n", "1"), ("e", "2")]))
    assert values(drift.diff(a, b), "section_id", "change") == [("c", "changed"), ("n", "added"), ("r", "removed")]
    ev = spark.createDataFrame([("k", 1, "queued", None), ("k", 2, "run", 5), ("k", 3, "done", None), ("l", 1, "done", 1)], "k string, t int, s string, v int")
    f = fold.fold_events(ev, "k", [F.col("t")], "s", ["v"], F.col("s") == "run", F.col("s") == "done")
    assert values(f, "k", "s", "v", "started", "ended")[0] == ("k", "done", 5, 2, 3)
    legal = spark.createDataFrame([("queued", "run")], "from_state string, to_state string")
    assert values(fold.illegal_transitions(ev, "k", [F.col("t")], "s", legal), "from_state", "to_state") == [("run", "done")]
    n = fold.nest(spark.createDataFrame([("p",), ("q",)], "id string"), "id", kids=(spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "id string, o int, v string"), [F.col("o")]))
    assert {r.id: [k.v for k in r.kids] for r in n.collect()} == {"p": ["a", "b"], "q": []}


def test_validate_and_summaries(spark):
    df = spark.createDataFrame([("e", "t", "", "h", "ed", None, "ftp:/x")], "entity_id string, jurisdiction_tenant string, title string, content_hash string, code_edition_id string, fetched_at string, source_url string").withColumn("verbatim_text_deep_link", F.lit(None).cast("string"))
    ok, bad = validate.split_valid(df, validate.rules_for("code-section"))
    assert ok.count() == 0 and set(bad.first().errors) == {"title is empty", "source_url is no address", "fetched_at is no time"}
    s = spark.createDataFrame([("1", "1.2", "T", "B", "t", "h")], "entity_id string, section_number string, title string, body_text string, jurisdiction_tenant string, content_hash string")
    asked = spark.createDataFrame([("1",), ("2",)], "entity_id string")
    got = {r.entity_id: r for r in summaries.summarize(s, "code-section", "user", asked).collect()}
    assert got["1"].prose == "1.2 T" and got["1"].provenance == "1@h" and got["2"].prose == "Atom not found: code-section/2"


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-01 02:00:00", "z"), ("b", "2024-01-01 01:00:00", "y"), (None, "2024-01-01 01:00:00", "y")]
    spark.createDataFrame(rows, "key string, at string, state string").selectExpr("key", "cast(at as timestamp) at", "state").write.parquet(src)
    stream = spark.readStream.schema("key string, at timestamp, state string").parquet(src)
    q = streaming.event_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("states"), "key", "state", "n_events") == [("a", "z", 2), ("b", "y", 1)]
    w = streaming.keep_latest(stream.where("key is not null"), f"{tmp_path}/t", ["key"], "at", f"{tmp_path}/c").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert values(streaming.current(spark, f"{tmp_path}/t"), "key", "state") == [("a", "z"), ("b", "y")]


def test_table_of_latest_versions_batch_by_batch(spark, tmp_path):
    """Batches that come again, several versions, and faults that are no first batch."""
    schema = "key string, at timestamp, state string"
    batch = lambda *rows: spark.createDataFrame([(k, datetime(2024, 1, d), s) for k, d, s in rows], schema)
    (tmp_path / "in").mkdir()
    path, held = f"{tmp_path}/t", {}
    for n, rows in enumerate([[("a", 1, "x"), ("b", 1, "x")], [("a", 3, "y")], [("a", 2, "late"), ("c", 1, "z")], [("a", 4, "w")]]):
        batch(*rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streaming.keep_latest(stream, path, ["key"], "at", f"{tmp_path}/c", buckets=4).trigger(availableNow=True).start().awaitTermination()
        for k, d, s in rows:
            held[k] = max(held.get(k, (0, "")), (d, s))
        assert {r.key: r.state for r in streaming.current(spark, path).collect()} == {k: s for k, (_, s) in held.items()}
    assert max(map(len, streaming._versions(spark, path).values())) <= 3
    (tmp_path / "file").write_text("no folder")
    with pytest.raises(Exception):
        streaming.current(spark, f"{tmp_path}/file").count()
