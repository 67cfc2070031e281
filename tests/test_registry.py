"""Registered queries: every key is complete, and a sample agrees with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["txt25_extract_keywords", "flt2_meaningful_sessions", "agg1_audit_stats", "agg3_session_rollup", "mrg4_merge_faq_group", "mrg11_unique_names",
          "jon10_link_closure", "top7_bucket_hits", "str2_match_cancels", "str4_session_state"]


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    df = entry.queries()[name](spark, FOLDER)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())
