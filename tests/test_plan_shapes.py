"""Physical plans of the registered queries: what must and must not be in them."""

import os
import re

import pytest

from prefrank.catalog.registry import load_all

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="check tables are absent")

ROW_WISE = (
    "redact_documents", "redact_documents_portuguese", "pii_types", "pseudonymize_users", "normalize_documents",
    "audit_lines", "struct_features", "pad_encoding", "softmax_winner", "loss_terms", "validate_feedback",
    "validate_results", "detect_intent", "reasoning_prompt", "parse_generated", "submission_rows",
    "answer_interactions", "retention",
)
# These run a job while they are built.
EAGER = {"train_classifier", "train_epochs", "training_objective", "evaluate_triples", "audit_file_tree", "audit_strict",
         "gate_report", "submission_csv", "epoch_order", "feedback_matches", "feedback_accuracy",
         "latency_percentiles", "price_percentiles", "psi_drift", "psi_shifted", "alerts", "cache_compaction", "pii_gate", "rule_file", "read_preferences",
         "read_preferences_limited", "read_for_validation", "required_columns"}


@pytest.fixture(scope="module")
def plan(spark):
    """Executed plan as a large table would get it: nothing small enough to broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: load_all()[0][name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(plan, name):
    assert "Exchange" not in plan(name)


def test_no_query_pairs_all_rows(plan):
    for name in load_all()[0]:
        if name.startswith("stream_") or name in EAGER:
            continue
        text = plan(name)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_scans_read_only_what_they_need(plan):
    schemas = {
        "redact_documents": "struct<doc_id:bigint,text:string>",
        "pii_by_source": "struct<text:string,source:string>",
        "turn_counts": "struct<conv_id:bigint>",
    }
    for name, schema in schemas.items():
        assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan(name))) == {schema}, name


def test_filters_reach_the_scan(plan):
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan("detect_intent")
    assert "EqualTo(event_type,view)" in plan("cache_lookup")


def test_counters_combine_before_the_shuffle(plan):
    for name in ("inference_counts", "latency_histogram", "pii_by_source", "calibration_bins"):
        text = plan(name)
        assert text.count("Exchange") == 1 and "partial_count" in text, name
