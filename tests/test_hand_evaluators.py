"""Conditions of the evaluators against rules written out by hand, on every combination of what they look at."""

import itertools

from pyspark.sql import functions as F

from tallyforge.operators import evaluation

YES_NO = (True, False, None)


def run(spark, rows, schema, metrics):
    found = evaluation.evaluated(spark.createDataFrame(rows, schema), metrics).collect()
    return {(r.run_id, r.metric): (r.passed, r.score, r.reason) for r in found}


def check(found, rows, names, rules):
    for row in rows:
        c = dict(zip(names, row))
        for metric, (rule, reason) in rules.items():
            passed = bool(rule(c))
            assert found[c["run_id"], metric] == (passed, float(passed), None if passed else reason), (metric, c)


def test_base_evaluators(spark):
    names = "run_id route expected_route trajectory expected_trajectory policy_allowed budget_exceeded tenant_isolated guardrail_passed sensitive_content result_verified".split()
    rows = [
        (i, r, "a", t, ["s", "e"], *flags)
        for i, (r, t, *flags) in enumerate(itertools.chain(
            itertools.product(("a", "b", None), (["s", "e"], ["e", "s"], [], None), *[(x,) for x in (True, False, True, True, False, True)]),
            itertools.product(("a",), (["s", "e"],), YES_NO, YES_NO, YES_NO, YES_NO, YES_NO, (True,)),
            itertools.product(("a",), (["s", "e"],), (True,), (False,), (True,), (True,), (False,), YES_NO),
        ))
    ]
    schema = "run_id long, route string, expected_route string, trajectory array<string>, expected_trajectory array<string>, " + ", ".join(f"{n} boolean" for n in names[5:])
    rules = {
        "route_correct": (lambda c: c["route"] == "a", "route_mismatch"),
        "trajectory_in_order": (lambda c: c["trajectory"] == ["s", "e"], "trajectory_mismatch"),
        "policy_allowed": (lambda c: c["policy_allowed"], "policy_denied_execution"),
        "within_budget": (lambda c: c["budget_exceeded"] is False, "agent_budget_exceeded"),
        "tenant_isolated": (lambda c: c["tenant_isolated"], "tenant_isolation_failed"),
        "guardrail_passed": (lambda c: c["guardrail_passed"], "guardrail_failed"),
        "response_sanitized": (lambda c: c["sensitive_content"] is False, "response_sensitive_content"),
        "result_verified": (lambda c: c["result_verified"], "unverified_result"),
    }
    assert rules.keys() == evaluation.BASE_METRICS.keys()
    check(run(spark, rows, schema, None), rows, names, rules)


def test_extended_evaluators(spark):
    names = "run_id catalog_loaded catalog_first evidence_version selection_matches control_plane_invoked privacy_gate_invoked guardrail_invoked error_code duration_ms retrieval_attempts".split()
    rows = [
        (i, *x)
        for i, x in enumerate(itertools.chain(
            itertools.product(YES_NO, YES_NO, ("v", None), YES_NO, (False,), (False,), (False,), ("e", None), (0.0, 5.0, -1.0, None), (-1, 0, None)),
            itertools.product((True,), (True,), ("v",), (True,), (True, False), (True, False), (True, False), (None,), (1.0,), (1,)),
        ))
    ]
    schema = "run_id long, catalog_loaded boolean, catalog_first boolean, evidence_version string, selection_matches boolean, control_plane_invoked boolean, privacy_gate_invoked boolean, guardrail_invoked boolean, error_code string, duration_ms double, retrieval_attempts int"
    told = lambda c: c["catalog_loaded"] and c["evidence_version"] is not None
    rules = {
        "structured_catalog_and_evidence": (told, "structured_catalog_or_evidence_missing"),
        "kg_catalog_before_jev_and_evidence": (lambda c: told(c) and c["catalog_first"], "kg_catalog_or_evidence_missing"),
        "kg_fixture_selection_matches": (lambda c: c["selection_matches"], "kg_fixture_selection_mismatch"),
        "baseline_ungated_shape": (lambda c: not (c["control_plane_invoked"] or c["privacy_gate_invoked"] or c["guardrail_invoked"]), "baseline_gate_was_invoked"),
        "baseline_model_completed": (lambda c: c["error_code"] is None, "baseline_model_error"),
        "baseline_duration_recorded": (lambda c: c["duration_ms"] is not None and c["duration_ms"] >= 0, "baseline_duration_missing"),
        "baseline_retrieval_attempts_recorded": (lambda c: c["retrieval_attempts"] is not None and c["retrieval_attempts"] >= 0, "baseline_retrieval_attempts_missing"),
    }
    metrics = {**evaluation.STRUCTURED_METRICS, **evaluation.GRAPH_METRICS, **evaluation.BASELINE_METRICS}
    assert rules.keys() == metrics.keys()
    check(run(spark, rows, schema, metrics), rows, names, rules)


def test_totals_and_completeness(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,), (True,)], "passed boolean")
    assert tuple(evaluation.matrix_totals(rows).first()) == (4, 2, 2)
    runs = spark.createDataFrame([(1, "p", *[True] * 7), (2, "q", *[None] * 6, False)], "run_id long, pipeline string, " + ", ".join(f"{c} boolean" for c in evaluation.COMPLETENESS))
    found = evaluation.completeness(runs).groupBy("run_id").agg(F.count_if("passed").alias("n"), F.count("*").alias("all")).collect()
    assert sorted(map(tuple, found)) == [(1, 7, 7), (2, 0, 7)]
