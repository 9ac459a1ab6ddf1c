"""A cross-section of registered queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tidewatch import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "smart_merge", "merged_daily_metrics", "dimension_stats", "compute_analysis", "recommendations", "item_type_performance", "error_cooccurrence",
    "fact_activity", "fact_user_metrics", "top_workspaces", "measure_change_pct", "user_rank", "access_summary", "merge_inventory", "hub_items",
    "build_dependency_edges", "node_depths", "chain_stats", "deep_chains", "source_failure_reach", "cross_workspace_edges", "incremental_facts",
    "dimension_scd2", "stream_facts", "load_activities_csv", "domain_of_documents", "tables_of_connections",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    message, _, good = check_queries.compare(spark, con, SF, name, catalog.load()[name])
    assert good, message


def test_contract():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 300
    assert set(catalog.load()) <= set(oracles), "every query outside the corpus operators has SQL"
