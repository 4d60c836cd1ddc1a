"""Every query of the training-data operators on the smallest tables, against its SQL where there is some."""

import os

import duckdb
import pytest

from maieutic.llm import queries

COLUMNS = {
    "p1_found": ["task_id_a", "task_id_b"],
    "p2_found": ["pair_source", "pair_id", "defect"],
    "p3_found": ["topic_key", "example_id"],
    "p4_found": ["field_name", "episode_id"],
    "p5_found": ["task_id"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    sql = queries.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for f in os.listdir(sf_dir):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        k = c.execute(sql)
        assert [d[0] for d in k.description] == df.columns
        assert sorted(map(str, rows)) == sorted(map(str, k.fetchall()))
