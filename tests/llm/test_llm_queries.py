import pytest

from timberline.llm import queries

COLUMNS = {
    "p2_found": ["record_table", "record_key", "line_no", "pii_type"],
    "p3_found": ["record_table", "id_a", "id_b"],
    "p6_found": ["id_a", "id_b"],
    "p7_found": ["file_id", "first_line", "last_line"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    assert df.count() > 0
    if name in ("p3_found", "p6_found"):
        assert df.where("id_a >= id_b").count() == 0
