"""The rule graph as node and edge tables, its operations, and the difference between two versions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.operators.rules import METRICS


def item_nodes(catalog: DataFrame, population: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(id, kind, population, feature, value) and (source, target, relation) of a population's item catalog (item)."""
    split = catalog.select(F.split_part("item", F.lit("="), F.lit(1)).alias("feature"), F.regexp_extract("item", "=(.*)$", 1).alias("value"))
    name = F.lit(population)
    root = F.concat(F.lit("population:"), name)
    is_target = F.col("feature") == target
    value_id = F.concat_ws(":", F.when(is_target, "target").otherwise("value"), name, F.concat_ws("=", "feature", "value"))
    feature_id = F.concat_ws(":", F.lit("feature"), name, "feature")
    spark = catalog.sparkSession
    nodes = spark.range(1).select(root.alias("id"), F.lit("population").alias("kind"), name.alias("population"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value"))
    features = split.where(~is_target).select(feature_id, F.lit("feature"), name, "feature", F.lit(None).cast("string")).distinct()
    values = split.select(value_id, F.when(is_target, "target").otherwise("feature_value"), name, "feature", "value")
    edges = split.where(is_target).select(root.alias("source"), value_id.alias("target"), F.lit("has_target").alias("relation"))
    edges = edges.unionAll(split.where(~is_target).select(root, feature_id, F.lit("has_feature")).distinct())
    edges = edges.unionAll(split.where(~is_target).select(feature_id, value_id, F.lit("has_value")))
    return nodes.unionAll(features).unionAll(values), edges


def canonical_rule_id(population: str, antecedents: list[str], consequent: str, support: float, confidence: float, lift: float) -> str:
    """The identity that artifacts carry: a digest of the rule as canonical JSON, metrics included."""
    body = {"antecedents": antecedents, "confidence": confidence, "consequent": consequent, "lift": lift, "population": population, "support": support}
    return f"rule:{population}:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_rule_id(rules: DataFrame, population: str) -> DataFrame:
    """rule_id, the same in every run; numbers have to print as in JSON, which has no built-in, and rules are few."""

    @F.pandas_udf("string")
    def named(antecedents: pd.Series, consequent: pd.Series, support: pd.Series, confidence: pd.Series, lift: pd.Series) -> pd.Series:
        rows = zip(antecedents, consequent, support.tolist(), confidence.tolist(), lift.tolist())
        return pd.Series([canonical_rule_id(population, list(a), c, *m) for a, c, *m in rows], dtype=object)

    return rules.withColumn("rule_id", named("antecedents", "consequent", *METRICS))


def rule_nodes(rules: DataFrame, population: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, population, antecedent_count) and edges (source, target, relation, support, confidence, lift) of rules."""
    named = with_rule_id(rules, population)
    nodes = named.select(F.col("rule_id").alias("id"), F.lit("rule").alias("kind"), F.lit(population).alias("population"), F.size("antecedents").alias("antecedent_count"))
    empty = [F.lit(None).cast("double").alias(m) for m in METRICS]
    into = named.select(F.explode("antecedents").alias("item"), "rule_id").select(
        F.concat(F.lit(f"value:{population}:"), "item").alias("source"), F.col("rule_id").alias("target"), F.lit("antecedent").alias("relation"), *empty
    )
    out = named.select(F.col("rule_id").alias("source"), F.concat(F.lit(f"target:{population}:"), "consequent").alias("target"), F.lit("predicts").alias("relation"), *METRICS)
    return nodes, into.unionAll(out)


def conflicts(nodes: DataFrame) -> DataFrame:
    """Ids that stand for two different nodes; an empty result is what a publication needs."""
    return nodes.distinct().groupBy("id").count().where("count > 1").select("id")


def is_acyclic(edges: DataFrame) -> bool:
    """Take away edges into nodes that nothing leaves until none is left or none can be taken away."""
    left = cut(edges.select("source", "target").distinct())
    size = left.count()
    while size:
        rest = cut(left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
        now = rest.count()
        if now == size:
            return False
        left, size = rest, now
    return True


def checked_consensus(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules that a graph may be compiled from; the first fault found is an error.

    Items are in the catalog (item) and in order, metrics in their domains, no rule occurs twice.
    """
    items = rules.select(F.explode(F.array_append("antecedents", F.col("consequent"))).alias("item"))
    inside = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    faults = {
        "an item is not in the catalog": items.join(catalog, "item", "left_anti"),
        "antecedents are missing, repeated or out of order": rules.where((F.size("antecedents") < 1) | (F.array_sort(F.array_distinct("antecedents")) != F.col("antecedents"))),
        "the consequent is among the antecedents": rules.where(F.array_contains("antecedents", F.col("consequent"))),
        "a metric lies outside its domain": rules.where(~inside("support") | ~inside("confidence") | ~F.coalesce((F.col("lift") >= 0) & (F.col("lift") < float("inf")), F.lit(False))),
        "a rule occurs twice": rules.groupBy("antecedents", "consequent").count().where("count > 1"),
        "there are no rules": rules.limit(1).agg(F.count("*").alias("n")).where("n = 0"),
    }
    for message, rows in faults.items():
        if not rows.isEmpty():
            raise ValueError(message)
    return rules


# fixed values: the reviewed cases, what each predicts, and whether it may be used
CASES = (
    ("C1", "sla_breached", "exploratory_not_promoted"),
    ("C2", "resolution_days", "exploratory_not_promoted"),
    ("C3", "is_fraud", "exploratory_not_promoted"),
    ("C4", "requires_followup|was_escalated", "exploratory_not_promoted"),
    ("C5", "main_score", "exploratory_not_promoted"),
    ("C6", None, "blocked"),
    ("C7", None, "blocked"),
    ("C8", None, "blocked"),
)


def with_cases(nodes: DataFrame, edges: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Case nodes for all CASES, a model_run node for each row of runs (case_id, run_id, sha256, manifest_sha256) and the edge between.

    A run whose digest differs from its manifest's, or of a case that is not listed or blocked, is an error.
    """
    spark = nodes.sparkSession
    listed = spark.createDataFrame(list(CASES), "case_id string, target string, status string")
    if not runs.where("NOT (sha256 <=> manifest_sha256)").isEmpty():
        raise ValueError("a model run is not what its manifest describes")
    if not runs.join(listed.where("status <> 'blocked'"), "case_id", "left_anti").isEmpty():
        raise ValueError("a run belongs to no case that may have one")
    none = F.lit(None).cast("string")
    case = F.concat(F.lit("case:"), "case_id")
    run = F.concat_ws(":", F.lit("model_run"), "case_id", "run_id")
    out = nodes.unionAll(listed.select(case, F.lit("case"), none, "target", "status"))
    out = out.unionAll(runs.select(run, F.lit("model_run"), none, F.lit("sha256"), "sha256"))
    return out, edges.unionAll(runs.select(case, run, F.lit("evaluated_by")))


def case_summary(nodes: DataFrame, edges: DataFrame, case_id: str) -> DataFrame:
    """The case's node with the runs that evaluated it, one row a run, or one row without."""
    found = nodes.where(F.col("id") == f"case:{case_id}").select("id", F.col("feature").alias("predicts"), F.col("value").alias("status"))
    runs = edges.where("relation = 'evaluated_by'").select(F.col("source").alias("id"), F.col("target").alias("run"))
    digests = nodes.where("kind = 'model_run'").select(F.col("id").alias("run"), F.col("value").alias("sha256"))
    return found.join(runs.join(digests, "run"), "id", "left")


def operations(nodes: DataFrame) -> DataFrame:
    """(kind, allowed): the values that each kind of node offers to the operations, sorted; kinds are of the closed schema."""
    return nodes.groupBy("kind").agg(F.array_sort(F.collect_set("id")).alias("allowed"))


def population_summary(edges: DataFrame, population: str) -> DataFrame:
    """Edges of each relation that leave a population's node or belong to its rules."""
    mine = F.col("source").contains(f":{population}:") | (F.col("source") == f"population:{population}")
    return edges.where(mine).groupBy("relation").agg(F.count("*").alias("n"))


def rules_by_target(rules: DataFrame, target: str) -> DataFrame:
    out = rules.where(F.col("consequent") == target)
    return out.select(F.concat_ws(" ∧ ", F.array_sort("antecedents")).alias("antecedents"), "consequent", *METRICS)


def rules_by_item(rules: DataFrame, item: str) -> DataFrame:
    out = rules.where(F.array_contains("antecedents", item))
    return out.select(F.concat_ws(" ∧ ", F.array_sort("antecedents")).alias("antecedents"), "consequent", *METRICS)


def difference(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """Each rule of two versions as kept, added or removed, with the change of its metrics."""
    keys = ["antecedents", "consequent"]
    a = previous.select(*keys, *[F.col(m).alias(f"old_{m}") for m in METRICS], F.lit(True).alias("old"))
    b = candidate.select(*keys, *[F.col(m).alias(f"new_{m}") for m in METRICS], F.lit(True).alias("new"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept")
    return both.select(*keys, change.alias("change"), *[F.round(F.col(f"new_{m}") - F.col(f"old_{m}"), 6).alias(f"{m}_delta") for m in METRICS])


def row_deltas(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """(population, row_count) of two versions -> counts, their difference and its share of the previous count."""
    both = previous.withColumnRenamed("row_count", "old").join(candidate.withColumnRenamed("row_count", "new"), "population", "full").na.fill(0, ["old", "new"])
    delta = F.col("new") - F.col("old")
    return both.select("population", "old", "new", delta.alias("delta"), F.round(F.abs(delta) / F.greatest("old", F.lit(1)), 6).alias("ratio"))


def support_snapshot(supports: DataFrame, counts: DataFrame) -> DataFrame:
    """(population, row_count, item, support): what a version holds of its populations, for later comparison."""
    return supports.join(counts, "population").select("population", "row_count", "item", F.round("support", 6).alias("support"))


def gate(
    diff: DataFrame, deltas: DataFrame | None = None, holdout: DataFrame | None = None,
    least_jaccard: float = 0.8, most_removed: float = 0.2, most_added: float = 0.5, most_delta: float = 0.5, least_stable: float = 0.5,
) -> DataFrame:
    """One row: counts, Jaccard, the greatest change of a population, the least share of stable rules, and whether the
    candidate may be published. Changes come from row_deltas(); holdout is (population, stable boolean), a row a rule."""
    out = diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("kept", "added", "removed")])
    total, old = F.col("kept") + F.col("added") + F.col("removed"), F.col("kept") + F.col("removed")
    out = out.withColumn("jaccard", F.when(total == 0, 1.0).otherwise(F.round(F.col("kept") / total, 6)))
    ratio = lambda c: F.col(c) / F.greatest(old, F.lit(1))
    passed = (F.col("jaccard") >= least_jaccard) & (ratio("removed") <= most_removed) & (ratio("added") <= most_added)
    if deltas is not None:
        out = out.join(deltas.agg(F.max("ratio").alias("row_delta")), F.lit(True))
        passed = passed & (F.coalesce("row_delta", F.lit(0.0)) <= most_delta)
    if holdout is not None:
        shares = holdout.groupBy("population").agg(F.avg(F.col("stable").cast("double")).alias("share"))
        out = out.join(shares.agg(F.round(F.min("share"), 6).alias("stable")), F.lit(True))
        passed = passed & (F.coalesce("stable", F.lit(1.0)) >= least_stable)
    return out.withColumn("passed", passed)
