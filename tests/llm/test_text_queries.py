"""The pN_ queries run over whole tables; those with SQL give its rows."""

import pytest
from compare import differences, duck
from storyloom.llm import queries as q

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": {"src_table", "id_a", "id_b"}, "p3_found": {"id_a", "id_b"}, "p4_found": {"chapter_id"}, "p5_found": {"id_a", "id_b"}, "p6_found": {"id", "type_code"}, "p7_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id", "kind", "start_pos", "end_pos"},
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    df = q.queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        df.count()
    if name in q.oracle_sql():
        assert differences(spark, SMALL, name, q.queries()[name], q.oracle_sql()[name], duck(SMALL)) == ""
