import pytest

from corvane.llm.queries import ORACLES, QUERIES

FOUND = {"p1_found": ["chunk_id"], "p2_found": ["file_id"], "p3_found": ["file_id"], "p5_found": ["symbol_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name] and len(rows) == len(set(rows))
    assert set(ORACLES) <= set(QUERIES)
