"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import pytest
from check_oracle import compare, connect

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = [
    "clean_exact_marks", "clean_id_collisions", "clean_fingerprint", "evidence_findings", "evidence_issues", "chain_requirements",
    "search_app", "search_hybrid", "usage_rollup", "usage_budget_crossing", "usage_stage_timing", "prune_runs_kept", "report_changes",
    "eval_predictions", "infer_cache_lookup", "ingest_rejects", "ingest_store_feed", "alerts_fired",
    "clean_duplicates_resolved", "clean_language_fill", "search_vectors", "chain_trace_rollup", "report_summary", "masked_reviews", "redacted_messages",
    "ingest_app_urls", "ingest_social_posts", "csv_round_trip", "read_agent_events", "read_eval_history", "stages_pending", "stage_rows_read", "stream_corpus", "stream_late_rows",
    "jaccard_members", "corpus_compacted", "compare_rows", "compare_tree", "infer_audit_rows", "infer_requirement_rows", "log_streamed", "embeddings_refused", "maintenance_rewritten",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = catalog.QUERIES[name]
    n, problem = compare(spark, con, q, catalog.expand(q.sql), SF)
    assert problem == "" and n > 0


def test_every_survey_family_is_registered():
    ids = {s for q in catalog.QUERIES.values() for s in q.survey}
    counts = {"SRC": 11, "SNK": 6, "PRJ": 8, "CLN": 12, "EVD": 21, "RET": 16, "INF": 7, "USE": 12, "WIN": 11, "SET": 4, "EVL": 12, "STR": 8}
    for family, last in counts.items():
        missing = {f"{family}-{i}" for i in range(1, last + 1)} - ids
        assert not missing, missing
