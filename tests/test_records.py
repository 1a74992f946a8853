"""Orphans, hierarchies and snapshot changes on small cases: nulls, ties, copies, empty tables."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.hierarchy import descendants, hierarchy
from lexloom.operators.orphans import broken_references
from lexloom.operators.snapshots import snapshot_changes
from lexloom.plans import records
from lexloom.tables import Scratch
from tests.compare import connect

CHILD = "parent_table string, scope string, ref string, at timestamp, child string, extra int"
PARENT = "parent_table string, scope string, ref string, since timestamp, until timestamp"


def day(n):
    return datetime(2024, 1, n)


def test_broken_references(spark):
    parents = spark.createDataFrame(
        [("t", "s", "a", day(2), None), ("t", "s", "a", day(4), None), ("t", "s", "b", day(1), day(5)), ("t", None, "c", day(1), None), ("t", "s", None, day(1), None)], PARENT
    )
    children = spark.createDataFrame(
        [
            ("t", "s", "a", day(3), "held", 1), ("t", "s", "a", day(1), "early", 1), ("t", "s", "b", day(5), "gone", 1), ("t", "s", "b", day(4), "still", 1), ("t", None, "c", day(2), "null scope", 1),
            ("t", "s", "c", day(2), "other scope", 1), ("t", "s", None, day(2), "no ref", 1), ("t", "s", "x", None, "no time", 1), ("t", "s", "a", None, "no time but held", 1),
        ],
        CHILD,
    )
    got = {(r.child, r.reason) for r in broken_references(children, parents).collect()}
    assert got == {("early", "late"), ("gone", "deleted"), ("other scope", "missing"), ("no time", "missing")}
    assert broken_references(children.limit(0), parents).count() == 0
    assert {r.reason for r in broken_references(children, parents.limit(0)).collect()} == {"missing"}


def test_columns_of_the_same_name(spark):
    children = spark.createDataFrame([("t", "s", "x", day(1), "a", day(9), "why")], "parent_table string, scope string, ref string, at timestamp, child string, since timestamp, reason string")
    got = broken_references(children, spark.createDataFrame([], PARENT)).first()
    assert (got.child, got.since, got.reason) == ("a", day(9), "missing")


def test_one_hot_key(spark):
    children = spark.range(3000).select(F.lit("t").alias("parent_table"), F.lit("s").alias("scope"), F.lit("hot").alias("ref"), F.lit(day(1)).alias("at"), F.col("id").cast("string").alias("child"))
    assert broken_references(children, spark.createDataFrame([], PARENT)).count() == 3000


def brute(parent):
    out = {}
    ids = set(parent)
    for n in ids:
        chain, seen, cur = [n], {n}, parent[n]
        while cur in ids and cur not in seen:
            chain.append(cur)
            seen.add(cur)
            cur = parent[cur]
        if cur not in ids:
            out[n] = ("ok", chain[-1], len(chain) - 1, ">".join(reversed(chain)))
        else:
            out[n] = ("cycle" if cur == n else "below-cycle", "", -1, "")
    return out


def run(spark, parent):
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    return hierarchy(df, Scratch(spark, "t")).collect()


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(4)
    parent = {f"n{i}": rng.choice([None, "gone", *(f"n{j}" for j in range(max(1, i)))]) for i in range(150)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(40)}
    parent |= {"r0": "r1", "r1": "r2", "r2": "r0", "self": "self", "b1": "r0", "b2": "b1", "b3": "self"}
    got = run(spark, parent)
    want = brute(parent)
    assert {r.id: (r.state, r.root_id, r.depth, r.path) for r in got} == want
    by = {r.id: r for r in got}
    for a in got:
        if a.state != "ok":
            assert a.n_descendants == -1
            continue
        below = {b.id for b in got if b.state == "ok" and b.root_id == a.root_id and a.lft < b.lft <= a.rgt}
        assert below == {n for n, w in want.items() if w[0] == "ok" and n != a.id and a.id in w[3].split(">")}
        assert a.n_descendants == len(below)
    assert by["self"].state == "cycle" and by["b3"].state == "below-cycle"


def test_descendants_of_every_node(spark):
    rng = random.Random(7)
    parent = {f"n{i}": rng.choice([None, *(f"n{j}" for j in range(max(1, i)))]) for i in range(200)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(33)} | {f"k{i}": "c32" for i in range(40)} | {"n0": None}
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    places = hierarchy(df, Scratch(spark, "t")).where("state = 'ok'").withColumn("ancestor", F.lit(1))
    got = [tuple(r) for r in descendants(places.select("root_id", "id", "lft", "rgt"), ["root_id"]).select("ancestor", "descendant").collect()]
    want = {(a, n) for n, w in brute(parent).items() for a in w[3].split(">")[:-1]}
    assert len(got) == len(set(got)) and set(got) == want
    assert descendants(places.limit(0).select("root_id", "id", "lft", "rgt"), ["root_id"]).count() == 0


def test_hierarchy_of_nothing_of_a_star_and_of_rings(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent string"), Scratch(spark, "t")).count() == 0
    star = run(spark, {"root": None} | {f"k{i}": "root" for i in range(400)})
    assert {r.id: r.n_descendants for r in star}["root"] == 400
    assert sorted(r.lft for r in star) == list(range(401))
    assert {r.state for r in run(spark, {"a": "b", "b": "a", "c": None})} == {"cycle", "ok"}


SNAP = "owner string, n int, k string, h string, at string, extra string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    out = snapshot_changes(df, owner=F.col("owner"), snapshot=F.col("n"), key=F.col("k"), version=T.hash_key(F.col("h")), order=T.instant(F.col("at")))
    return {tuple(r) for r in out.collect()}


def test_snapshot_changes(spark):
    t = "2024-01-01T00:00:00Z"
    rows = [
        ("o", 1, "same", "A", t, ""), ("o", 1, "new hash", "a", t, ""), ("o", 1, "leaves", "a", t, ""), ("o", 1, "to null", "a", t, ""), ("o", 1, "notation", "SHA256:aB", t, ""),
        ("o", 3, "same", "a", t, ""), ("o", 3, "new hash", "b", t, ""), ("o", 3, "joins", None, t, ""), ("o", 3, "to null", "", t, ""), ("o", 3, "notation", "ab", t, ""),
        ("o", 3, "same", "z", "2023-12-31T23:00:00-05:00", ""), ("o", 3, "same", "a", "2024-01-02T00:00:00+00:00", ""), ("p", 2, "only", "a", t, ""), (None, 1, "n", "a", t, ""), (None, 2, "m", "a", t, ""), ("o", None, "x", "a", t, ""), ("o", 3, None, "a", t, ""),
    ]
    want = {(3, "new hash", "changed"), (3, "leaves", "removed"), (3, "joins", "added"), (2, "n", "removed"), (2, "m", "added")}
    assert changes(spark, rows + rows) == want
    assert changes(spark, []) == set()


def test_labels(spark):
    labels = {"§ 5.04(b)": "5.04", "Sec. 1-2.": "1-2", " SECTION 1–2 ": "1-2", "R3.9(a)(2),": "r3.9", "section 1‑2": "1-2", "(a)": None, "": None}
    df = spark.createDataFrame(list(labels), "string").select("value", T.section_key(F.col("value")).alias("k"))
    assert {r.value: r.k for r in df.collect()} == labels
    outline = {"Chapter 1": "1", "CH. 2.": "2", " § 1-2.1 ": "1-2.1", "Sec. 1-2": "1-2", None: None}
    df = spark.createDataFrame([(k,) for k in outline], "value string").select("value", T.outline_key(F.col("value")).alias("k"))
    assert {r.value: r.k for r in df.collect()} == outline


def test_ranges_hold_the_descendants_of_inner_nodes(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    f = records.p4_ranges(spark, folder).toPandas()
    got = {
        (t, a.node_id, b.node_id)
        for (t, _), tree in f.groupby(["node_table", "root_id"]) for a in tree.itertuples() for b in tree.itertuples() if a.lft < b.lft <= a.rgt
    }
    want = connect(folder).sql(records.P4 + "SELECT t, unnest(chain[:-2]) AS a, node AS b FROM ok").fetchall()
    assert got == set(want) and len(want) == len(got)
    roots = set(f[f.lft == 0].node_id)
    assert any(a not in roots for _, a, _ in got)
