"""Registered queries against their SQL. ``EVIDENCE_ORACLE=all`` runs every one of them."""

import os

import pytest

import oracle_check

import __spark_entry__ as entry

QUICK = """flagship_alert_groups conform_unified security_flags word_parity_bits severity_and_risk labels_and_themes question_routes
canonical_hashes payload_roundtrip zscores severity_trend top_reason_themes arrival_rate rolling_count correlate_latest audit_entries
verify_chain diff_log merkle_root_of_log verify_checkpoints graph_edges_all ranked_snippets replay_timeline stream_trend sql_functions""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("EVIDENCE_ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, sf, name):
    assert oracle_check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_plan_prunes_and_uses_no_nested_loop(spark, sf):
    plan = entry.queries()["flagship_alert_groups"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "ts:timestamp" not in plan  # columns the query does not need are not read
