import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

DATA = "/root/testdata/sf0.001"
# One query per area; check_oracles.py runs all of them.
SAMPLE = ["asof_symbol_version", "halt_status", "candidate_key", "barrier_outcomes", "clusters", "graph_edges",
          "duplicate_check", "content_hash", "news_dedup", "lifecycle_fold"]


def test_every_query_has_sql():
    from chronotape.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and len(catalog.QUERIES) > 90
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 9 and "class_entropy" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ok, text = compare(spark, con, name, DATA)
    assert ok, text
