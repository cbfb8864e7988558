"""A selection of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lanecost.plans.workload import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "candidate_rule", "compile_notes", "structured_recall", "evidence_gate", "decide_verdict", "packet_notes",
    "final_output", "mix_rate_decomposition", "operational_leads", "metric_comparison", "tfidf_sparse", "rank_fusion",
    "grounding_validation", "usage_report", "load_bundle", "route_timeline", "dataset_fingerprint",
])
def test_query_equals_oracle(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want
