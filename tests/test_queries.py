"""Every core query against its SQL twin, on the smallest data folder."""

import os

import pytest

from lexloom.plans.catalogue import registries
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: (f, r.sql.get(n)) for r in registries() for n, f in r.queries.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    f, sql = QUERIES[name]
    got = f(spark, FOLDER).toPandas()
    if sql is not None:
        cols, mine = rows(got)
        other_cols, theirs = rows(con.sql(sql).df())
        assert cols == other_cols
        assert mine == theirs


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p6_found", "curated_top3", "edition_rollup", "heading_stack_tree"])
def test_same_rows_under_other_partitionings(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(rows(QUERIES[name][0](spark, FOLDER).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_groups_by_number_and_effective_rules_leave_no_tenant_or_part_out(spark, con):
    groups = QUERIES["section_number_groups"][0](spark, FOLDER).toPandas()
    assert set(groups["jurisdiction_tenant"]) == {r[0] for r in con.sql("SELECT DISTINCT jurisdiction_tenant FROM code_sections WHERE section_number IS NOT NULL").fetchall()}
    pairs = con.sql("SELECT count(*) FROM (SELECT DISTINCT a.jurisdiction_tenant, a.section_number, a.entity_id, b.entity_id FROM code_sections a JOIN code_sections b ON a.jurisdiction_tenant = b.jurisdiction_tenant AND a.section_number = b.section_number)").fetchall()[0][0]
    assert groups["n_sections"].sum() == pairs
    rules = QUERIES["effective_rule_all"][0](spark, FOLDER).toPandas()
    n_parts, most = con.sql("SELECT count(*), max(p_partkey) FROM part").fetchall()[0]
    named = rules[~rules["note"].str.startswith("(no base section)")]
    assert most >= 150 and len(named) == 7 * n_parts
