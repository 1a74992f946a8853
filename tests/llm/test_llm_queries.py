"""Every query runs over whole tables of the smallest folder and repeats its rows."""

import os

import pytest

from lexloom.llm.queries import R
from tests.compare import rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["entity_id_a", "entity_id_b"], "p5_found": ["entity_id", "repair_kind", "item"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "query_id"], "p9_found": ["doc_id", "kind"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query(spark, name):
    df = R.queries[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    first = rows(df.toPandas())
    assert max(first[1].values(), default=1) == 1
    assert rows(R.queries[name](spark, FOLDER).toPandas()) == first
