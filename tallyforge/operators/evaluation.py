"""Evaluation metrics of runs, comparison of two workflows, policy decisions and escalations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: metrics of the base evaluator, their conditions and the reasons given for a failure
BASE_METRICS = {
    "route_correct": ("route = expected_route", "route_mismatch"),
    "trajectory_in_order": ("trajectory = expected_trajectory", "trajectory_mismatch"),
    "policy_allowed": ("policy_allowed", "policy_denied_execution"),
    "within_budget": ("NOT budget_exceeded", "agent_budget_exceeded"),
    "tenant_isolated": ("tenant_isolated", "tenant_isolation_failed"),
    "guardrail_passed": ("guardrail_passed", "guardrail_failed"),
    "response_sanitized": ("NOT sensitive_content", "response_sensitive_content"),
    "result_verified": ("result_verified", "unverified_result"),
}


def evaluated(contexts: DataFrame, metrics: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(run_id, metric, passed, score, reason): one row for each metric of a context; a null condition fails."""
    rows = []
    for name, (condition, reason) in (metrics or BASE_METRICS).items():
        passed = F.coalesce(F.expr(condition), F.lit(False))
        rows.append(F.struct(F.lit(name).alias("metric"), passed.alias("passed"), passed.cast("double").alias("score"), F.when(~passed, reason).alias("reason")))
    return contexts.select("run_id", F.explode(F.array(*rows)).alias("x")).select("run_id", "x.*")


# fixed values: metrics of the structured, graph and baseline evaluators, their conditions and reasons
STRUCTURED_METRICS = {
    "structured_catalog_and_evidence": ("catalog_loaded AND evidence_version IS NOT NULL", "structured_catalog_or_evidence_missing"),
}
GRAPH_METRICS = {
    "kg_catalog_before_jev_and_evidence": ("catalog_loaded AND catalog_first AND evidence_version IS NOT NULL", "kg_catalog_or_evidence_missing"),
    "kg_fixture_selection_matches": ("selection_matches", "kg_fixture_selection_mismatch"),
}
BASELINE_METRICS = {
    "baseline_ungated_shape": ("NOT (control_plane_invoked OR privacy_gate_invoked OR guardrail_invoked)", "baseline_gate_was_invoked"),
    "baseline_model_completed": ("error_code IS NULL", "baseline_model_error"),
    "baseline_duration_recorded": ("duration_ms >= 0", "baseline_duration_missing"),
    "baseline_retrieval_attempts_recorded": ("retrieval_attempts >= 0", "baseline_retrieval_attempts_missing"),
}
#: The checks of a run's technical completeness, each on a column of a run record.
COMPLETENESS = ("answered", "route_known", "latency_measured", "cost_measured", "trace_linked", "policy_recorded", "verified")


def matrix_totals(results: DataFrame) -> DataFrame:
    """One row: results of a golden matrix, how many passed and how many failed; a null counts as failed."""
    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    return results.agg(F.count("*").alias("results"), passed.alias("passed"), (F.count("*") - passed).alias("failed"))


def completeness(runs: DataFrame) -> DataFrame:
    """(run_id, pipeline, check, passed): a row for each of the COMPLETENESS columns of a run; a null fails."""
    parts = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(False)).alias("passed")) for c in COMPLETENESS]
    return runs.select("run_id", "pipeline", F.explode(F.array(*parts)).alias("x")).select("run_id", "pipeline", "x.*")


def workflow_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("pipeline").agg(
        F.round(F.avg("score"), 3).alias("avg_score"),
        F.count_if("passed").alias("pass_count"),
        F.count_if(~F.col("passed")).alias("fail_count"),
        F.round(F.avg(F.col("passed").cast("double")), 3).alias("pass_rate"),
    )


def paired_summary(results: DataFrame, by: list[str] | None = None, band: float = 0.001) -> DataFrame:
    """Scenarios with a score of both workflows: how often each is higher, ties, mean difference B - A."""
    keys = [*(by or []), "scenario_id"]
    score = lambda p: F.max(F.when(F.col("pipeline") == p, F.col("score")))
    both = results.groupBy(*keys).agg(score("baseline").alias("a"), score("controlled").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    delta = F.col("b") - F.col("a")
    return both.groupBy(*(by or [])).agg(
        F.count_if(delta > band).alias("b_higher"),
        F.count_if(delta < -band).alias("a_higher"),
        F.count_if(F.abs(delta) <= band).alias("tied"),
        F.round(F.avg(delta), 3).alias("avg_delta"),
    )


# fixed values: role names and what each action asks for
ROLES = {"client": "client", "customer": "client", "operator": "operator", "backoffice": "operator"}
ACTIONS = {
    "transaction.read": ("ALLOW", ("client", "operator"), "dispute.transaction.read"),
    "dispute.read": ("ALLOW", ("client", "operator"), "dispute.read"),
    "escalation.request": ("REQUIRE_APPROVAL", ("client",), "dispute.escalation.request"),
    "dispute.submit": ("DENY", (), ""),
    "dispute.cancel": ("DENY", (), ""),
}


def decided(requests: DataFrame) -> DataFrame:
    """requests (role, action, capability) with outcome and reason.

    No action is informational and allowed; an action that is not listed is denied.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = roles[F.lower("role")]
    outcome: Column = F.when(F.col("action").isNull(), "ALLOW")
    reason: Column = F.when(F.col("action").isNull(), "informational_no_dispute_operation")
    for name, (result, allowed, capability) in ACTIONS.items():
        here = F.col("action") == name
        if result == "DENY":
            outcome, reason = outcome.when(here, "DENY"), reason.when(here, "bank_dispute_action_not_supported")
            continue
        permitted = F.coalesce(role.isin(*allowed) & (F.col("capability") == capability), F.lit(False))
        outcome = outcome.when(here & permitted, result)
        reason = reason.when(here & permitted, name)
    return requests.withColumn("outcome", outcome.otherwise("DENY")).withColumn("reason", reason.otherwise("capability_or_role_denied"))


def escalation_states(events: DataFrame) -> DataFrame:
    """Final state of each case from its events in order: open, pending_approval, escalated or denied.

    A request moves an open case to approval; the first decision after that settles it; other events
    change nothing. Both points in time are minima, so nothing is folded row by row.
    """
    requested = F.min(F.when(F.col("event") == "request", F.col("at")))
    first = events.groupBy("case_id").agg(requested.alias("requested"))
    decisions = events.where(F.col("event").isin("approve", "deny")).select("case_id", "at", "event")
    later = decisions.join(first, "case_id").where(F.col("at") > F.col("requested"))
    settled = later.groupBy("case_id").agg(F.min(F.struct("at", "event"))["event"].alias("decision"))
    state = F.when(F.col("requested").isNull(), "open").when(F.col("decision").isNull(), "pending_approval")
    state = state.when(F.col("decision") == "approve", "escalated").otherwise("denied")
    return first.join(settled, "case_id", "left").select("case_id", state.alias("state"))


def gated(signals: DataFrame, threshold: float = 0.85) -> DataFrame:
    """route: the hint where its confidence reaches the threshold, else clarify; out-of-domain is rejected."""
    sure = F.col("confidence") >= threshold
    route = F.when((F.col("domain") == "out_of_domain") & sure, "reject").when(sure, F.col("route_hint")).otherwise("clarify")
    return signals.withColumn("route", route)


def retrieved(chunks: DataFrame, tenant: str, source: str, most: int) -> DataFrame:
    """The best chunks of each query; a query with any chunk of another tenant or source is blocked whole."""
    foreign = F.max(((F.col("tenant") != tenant) | (F.col("source") != source)).cast("int")).over(W.partitionBy("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return chunks.withColumn("blocked", foreign == 1).withColumn("rank", rank).where((F.col("rank") <= most) & ~F.col("blocked"))
