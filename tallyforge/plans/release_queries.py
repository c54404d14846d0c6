"""Registered queries of what a release needs: validation in folds, baselines of cases, the graph and its gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.operators import bayes, evaluation, graph, items, mining, rules, sampling
from tallyforge.plans import bank_queries as bank
from tallyforge.plans import comparison as sql
from tallyforge.plans.catalogue import register
from tallyforge.sources.canonical import cte, view

# mining: parity, rule order, lengths
register(
    "m8_parity",
    lambda s, d: parity(bank.baskets(s, d, "complaints")),
    "SELECT 0 AS different",
)


def parity(rows: DataFrame) -> DataFrame:
    """How many itemsets the hybrid miner and Apriori do not agree on; the run fails if there are any."""
    a, b = mining.hybrid(rows, sql.SUPPORT, sql.LONGEST), cut(mining.apriori(rows, sql.SUPPORT, sql.LONGEST))
    mining.assert_parity(a, b)
    return a.exceptAll(b).agg(F.count("*").cast("int").alias("different"))


register(
    "a17_lengths",
    lambda s, d: rules.histogram(bank.refined_rules(s, d)),
    f"{bank.MINED} SELECT len(antecedents) AS antecedent_length, count(*) AS n FROM refined GROUP BY 1",
)
register(
    "l6_top_conviction",
    lambda s, d: bank.joined(rules.enriched(bank.refined_rules(s, d)), "antecedents")
    .select("antecedents", "consequent", "conviction", "lift")
    .orderBy(F.desc_nulls_last("conviction"), F.desc("lift"), "antecedents", "consequent")
    .limit(10),
    f"""{bank.MINED}, e AS (SELECT array_to_string(antecedents, ',') AS antecedents, consequent, lift,
CASE WHEN confidence < 1 - 1e-12 THEN round((1 - confidence / lift) / (1 - confidence), 6) END AS conviction FROM refined)
SELECT antecedents, consequent, conviction, lift FROM e ORDER BY conviction DESC NULLS LAST, lift DESC, antecedents, consequent LIMIT 10""",
)

# validation in blocked folds
FOLDS = 3
STABLE_DELTA = 0.1


def folds(spark, d) -> DataFrame:
    """For each block in time: consensus rules mined without it, their share that is stable on it, and what all folds share."""
    p = items.POPULATIONS["complaints"]
    rows = cut(bank.mining_rows(spark, d, "complaints").withColumn("__b", sampling.block_number(p.time, bank.START, bank.END, FOLDS)))
    found, lines = [], []
    for b in range(FOLDS):
        train, held = (bank.basketed(rows.where(condition), "complaints") for condition in (F.col("__b") != b, F.col("__b") == b))
        strategies = (mining.apriori, mining.fpgrowth, mining.eclat)
        mined = [rules.mined(train, p, sql.SUPPORT, sql.LONGEST, sql.CONFIDENCE, sql.LIFT, f) for f in strategies]
        agreed = rules.strict_consensus(*mined)
        stable = rules.evaluated(agreed, held, sql.LIFT, STABLE_DELTA).agg(F.count("*").alias("rules"), F.round(F.avg(F.col("stable").cast("double")), 6).alias("stable_fraction"))
        count = lambda x, name: x.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias(name))
        sizes = count(train, "train_rows").join(count(held, "holdout_rows"), F.lit(True))
        lines.append(stable.join(sizes, F.lit(True)).withColumn("fold", F.lit(b)))
        found.append(agreed)
    shared = rules.multi_jaccard(found).select("shared", F.col("jaccard").alias("multi_fold_jaccard"))
    return reduce(DataFrame.unionAll, lines).join(shared, F.lit(True))


def _fold_sql(b: int) -> str:
    span = f"epoch_us(TIMESTAMP '{bank.END}') / 1e6 - epoch_us(TIMESTAMP '{bank.START}') / 1e6"
    block = f"CAST(least(floor((epoch_us(creation_date) / 1e6 - epoch_us(TIMESTAMP '{bank.START}') / 1e6) / ({span}) * {FOLDS}), {FOLDS - 1}) AS INTEGER)"
    inside = f"upper(category) = 'TRANSACTIONS' AND creation_date >= TIMESTAMP '{bank.START}' AND creation_date < TIMESTAMP '{bank.END}'"
    return f"""t{b} AS (SELECT * FROM cur_complaints WHERE {inside} AND {block} <> {b}), h{b} AS (SELECT * FROM cur_complaints WHERE {inside} AND {block} = {b}),
{sql.item_rows('complaints', f't{b}', f'i{b}')}, {sql.item_rows('complaints', f'h{b}', f'j{b}')}, {sql.itemsets(f'i{b}', f'p{b}')}, {sql.rules('complaints', f'p{b}')},
bk{b} AS (SELECT key, list(item) AS items FROM j{b} GROUP BY key), bn{b} AS (SELECT count(*) AS total FROM bk{b}),
ev{b} AS (SELECT r.antecedents, r.consequent, r.confidence, count(k.key) AS nl, count_if(list_contains(k.items, r.consequent)) AS nb FROM p{b}refined r LEFT JOIN bk{b} k ON list_has_all(k.items, r.antecedents) GROUP BY 1, 2, 3),
nr{b} AS (SELECT item, count(*) AS nr FROM j{b} GROUP BY 1),
ew{b} AS (SELECT e.*, CASE WHEN nl = 0 THEN 0 ELSE nb / nl END AS c, CASE WHEN nl = 0 OR nr IS NULL THEN 0 ELSE (nb / nl) / (nr / total) END AS l FROM ev{b} e LEFT JOIN nr{b} n ON n.item = e.consequent, bn{b}),
f{b} AS (SELECT {b} AS fold, count(*) AS rules, round(avg(CASE WHEN l >= {sql.LIFT} AND abs(c - confidence) <= {STABLE_DELTA} THEN 1.0 ELSE 0 END), 6) AS stable_fraction,
  (SELECT count(*) FROM t{b}) AS train_rows, (SELECT count(*) FROM h{b}) AS holdout_rows FROM ew{b})"""


EACH = " UNION ALL ".join(f"SELECT antecedents, consequent FROM p{b}refined" for b in range(FOLDS))
register(
    "m16_fold_validation",
    folds,
    f"{sql.tables('complaints')}, "
    + ", ".join(_fold_sql(b) for b in range(FOLDS))
    + f""", al AS (SELECT antecedents, consequent, count(*) AS n FROM ({EACH}) GROUP BY 1, 2),
mj AS (SELECT count_if(n = {FOLDS}) AS shared, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count_if(n = {FOLDS}) / count(*), 6) END AS multi_fold_jaccard FROM al)
SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM f{b}' for b in range(FOLDS))}), mj""",
)


# the graph of a release
def rule_ids(spark, d) -> DataFrame:
    rows = bank.baskets(spark, d, "complaints")
    found = graph.checked_consensus(bank.refined_rules(spark, d, rows=rows), items.support(rows).select("item"))
    return bank.joined(graph.with_rule_id(found, "complaints").select("rule_id", "antecedents", "consequent"), "antecedents")


JSON = """'{"antecedents":[' || array_to_string(list_transform(antecedents, lambda x: '"' || x || '"'), ',') || '],"confidence":' || CAST(confidence AS VARCHAR) || ',"consequent":"' || consequent
|| '","lift":' || CAST(lift AS VARCHAR) || ',"population":"complaints","support":' || CAST(support AS VARCHAR) || '}'"""
register(
    "g2_rule_ids",
    rule_ids,
    f"{bank.MINED} SELECT 'rule:complaints:' || sha256({JSON}) AS rule_id, array_to_string(antecedents, ',') AS antecedents, consequent FROM refined",
)


def acyclic(spark, d) -> DataFrame:
    rows = bank.baskets(spark, d, "complaints")
    found = bank.refined_rules(spark, d, rows=rows)
    catalog, own = bank.catalog_graph(spark, d, rows)[1], graph.rule_nodes(found, "complaints")[1].select("source", "target", "relation")
    return spark.createDataFrame([(graph.is_acyclic(catalog.unionAll(own)),)], "acyclic boolean")


register("g3_acyclic", acyclic, "SELECT true AS acyclic")
RUNS = [("C1", "r1", "aa", "aa"), ("C1", "r2", "bb", "bb"), ("C3", "r1", "cc", "cc")]


def case_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    runs = spark.createDataFrame(RUNS, "case_id string, run_id string, sha256 string, manifest_sha256 string")
    return graph.with_cases(*bank.catalog_graph(spark, d), runs)


def case_summaries(spark, d, *cases) -> DataFrame:
    made = [cut(x, "cases") for x in case_graph(spark, d)]  # once for all
    return reduce(DataFrame.unionAll, [graph.case_summary(*made, c) for c in cases])


register(
    "k1_case_summary",
    lambda s, d: case_summaries(s, d, "C1", "C2", "C7", "C9"),
    """SELECT * FROM (VALUES ('case:C1', 'sla_breached', 'exploratory_not_promoted', 'model_run:C1:r1', 'aa'), ('case:C1', 'sla_breached', 'exploratory_not_promoted', 'model_run:C1:r2', 'bb'),
('case:C2', 'resolution_days', 'exploratory_not_promoted', NULL, NULL), ('case:C7', NULL, 'blocked', NULL, NULL)) AS t(id, predicts, status, run, sha256)""",
)
register(
    "g8_operations",
    lambda s, d: graph.operations(bank.catalog_nodes(s, d, 0)).select("kind", F.size("allowed").alias("n"), F.element_at("allowed", 1).alias("first")),
    f"""{bank.GRAPH}, nd AS (SELECT 'population' AS kind, 'population:complaints' AS id UNION SELECT 'feature', 'feature:complaints:' || f FROM g WHERE f <> 'status'
UNION SELECT CASE f WHEN 'status' THEN 'target' ELSE 'feature_value' END, CASE f WHEN 'status' THEN 'target' ELSE 'value' END || ':complaints:' || item FROM g)
SELECT kind, CAST(count(DISTINCT id) AS INTEGER) AS n, min(id) AS first FROM nd GROUP BY 1""",
)
EARLY_COUNT = f"count_if(upper(category) = 'TRANSACTIONS' AND epoch_us(creation_date) / 1e6 < {bank.CUT})"


def population_counts(spark, d, early: bool, rows: DataFrame | None = None) -> DataFrame:
    rows = bank.mining_rows(spark, d, "complaints") if rows is None else rows
    if early:
        rows = rows.where(~sampling.holdout_side(rows, "creation_date", bank.START, bank.END, sql.FRACTION))
    return rows.agg(F.count("*").alias("row_count")).select(F.lit("complaints").alias("population"), "row_count")


register(
    "a28_row_deltas",
    lambda s, d: graph.row_deltas(population_counts(s, d, True), population_counts(s, d, False)),
    f"""{sql.tables('complaints')}, n AS (SELECT {EARLY_COUNT} AS a, count_if(upper(category) = 'TRANSACTIONS') AS b FROM cur_complaints)
SELECT 'complaints' AS population, a AS old, b AS new, b - a AS delta, round(abs(b - a) / greatest(a, 1), 6) AS ratio FROM n""",
)
register(
    "m18_snapshot",
    lambda s, d: snapshot(s, d),
    f"""{sql.tables('complaints')}, {sql.population_rows('complaints')}, {sql.item_rows('complaints')}
SELECT 'complaints' AS population, (SELECT count(*) FROM rows_complaints) AS row_count, item, round(count(*) / (SELECT count(DISTINCT key) FROM it), 6) AS support FROM it GROUP BY item""",
)


def snapshot(spark, d) -> DataFrame:
    rows = bank.baskets(spark, d, "complaints")
    counts = rows.agg(F.sum("weight").alias("row_count")).select(F.lit("complaints").alias("population"), "row_count")
    return graph.support_snapshot(items.support(rows).withColumn("population", F.lit("complaints")), counts)


def full_gate(spark, d) -> DataFrame:
    """The gate with all of its conditions: rules of the early part against all rows, rows, and stability on the late part."""
    rows = cut(bank.mining_rows(spark, d, "complaints"), "curated")  # once for all
    old, new = bank.versions(spark, d, rows)
    held = rules.evaluated(old, bank.side_rows(spark, d, "complaints", True, rows), sql.LIFT, STABLE_DELTA).select(F.lit("complaints").alias("population"), "stable")
    deltas = graph.row_deltas(population_counts(spark, d, True, rows), population_counts(spark, d, False, rows))
    return graph.gate(graph.difference(old, new), deltas, held)


register(
    "g6_full_gate",
    full_gate,
    f"""{bank.VERSIONS}, {bank.LATE}, {sql.item_rows('complaints', 'late', 'lt')}, bk AS (SELECT key, list(item) AS items FROM lt GROUP BY key), bn AS (SELECT count(*) AS total FROM bk),
nr AS (SELECT item, count(*) AS nr FROM lt GROUP BY 1),
ev AS (SELECT r.antecedents, r.consequent, r.confidence, count(k.key) AS nl, count_if(list_contains(k.items, r.consequent)) AS nb FROM orefined r LEFT JOIN bk k ON list_has_all(k.items, r.antecedents) GROUP BY 1, 2, 3),
ew AS (SELECT e.*, CASE WHEN nl = 0 THEN 0 ELSE nb / nl END AS c, CASE WHEN nl = 0 OR nr IS NULL THEN 0 ELSE (nb / nl) / (nr / total) END AS l FROM ev e LEFT JOIN nr n ON n.item = e.consequent, bn),
st AS (SELECT round(avg(CASE WHEN l >= {sql.LIFT} AND abs(c - confidence) <= {STABLE_DELTA} THEN 1.0 ELSE 0 END), 6) AS stable FROM ew),
dl AS (SELECT round(abs(b - a) / greatest(a, 1), 6) AS row_delta FROM (SELECT (SELECT count(*) FROM rows_complaints) AS a, (SELECT count(*) FROM every) AS b)),
c AS (SELECT count_if(change = 'kept') AS kept, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed FROM df),
j AS (SELECT *, CASE WHEN kept + added + removed = 0 THEN 1.0 ELSE round(kept / (kept + added + removed), 6) END AS jaccard FROM c)
SELECT j.*, row_delta, stable, jaccard >= 0.8 AND removed / greatest(kept + removed, 1) <= 0.2 AND added / greatest(kept + removed, 1) <= 0.5 AND row_delta <= 0.5 AND coalesce(stable, 1) >= 0.5 AS passed FROM j, st, dl""",
)

# baselines of two cases
FRAUD_SPLIT = ("1999-01-01", "2000-01-01")
FRAUD_FEATURES = ["transaction_type", "transaction_category", "currency", "channel", "merchant_category", "transaction_status", "response_code"]
FRAUD_LEVELS, FRAUD_QUANTILES = ("LOW", "MEDIUM", "HIGH"), (0.5, 0.9)
SAMPLE = (150, 450)


def fraud_baseline(spark, d) -> DataFrame:
    """Weighted naive Bayes with the population's priors and weighted Platt calibration, beside the calibrated score of the source."""
    rows = cut(view(spark, d, "transactions").where("is_fraud IS NOT NULL"))
    t = F.col("transaction_date")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in FRAUD_SPLIT)
    sides = {"train": t < a, "calibration": (t >= a) & (t < b), "test": t >= b}
    populations, samples = {}, {}
    for part, side in sides.items():
        own = rows.where(side)
        populations[part] = {r["is_fraud"]: r["n"] for r in own.groupBy("is_fraud").agg(F.count("*").alias("n")).collect()}  # two rows
        # rows of one key are told apart before they are drawn, so that a draw has no ties
        named = own.withColumn("transaction_id", F.concat_ws("-", "transaction_id", F.xxhash64(*own.columns)))
        samples[part] = cut(sampling.prevalence_weights(sampling.stratified(named, "is_fraud", "transaction_id", *SAMPLE), "is_fraud", populations[part]))
    limits = cut(bayes.amount_limits(samples["train"], "amount", FRAUD_QUANTILES))
    made = {
        part: cut(bayes.records(x, "transaction_id", F.col("is_fraud"), FRAUD_FEATURES, ("transaction_date", "transaction"), "amount", limits, FRAUD_LEVELS))
        for part, x in samples.items()
    }
    model = bayes.fit(made["train"], population=populations["train"])
    weights = {part: x.select(F.col("transaction_id").alias("key"), "weight", (F.col("fraud_score") / 100).alias("own")) for part, x in samples.items()}
    scored = {part: cut(bayes.predict(made[part], *model).where("class").select("key", "label", "probability").join(weights[part], "key")) for part in ("calibration", "test")}

    def measured(name: str, probability: str, rows: dict[str, DataFrame]) -> DataFrame:
        rows = {part: x.where(F.col(probability).isNotNull()).withColumn("probability", F.col(probability)) for part, x in rows.items()}
        fitted = bayes.platt(rows["calibration"], "weight")
        test = rows["test"].withColumn("probability", bayes.calibrated(F.col("probability"), *fitted))
        return bayes.binary_metrics(bank.coarse(test), "weight").withColumn("model", F.lit(name))

    return measured("naive_bayes", "probability", scored).unionAll(measured("fraud_score", "own", scored))


register("n5_fraud_baseline", fraud_baseline, None)
RISK_SPLIT = ("2024-01-15", "2024-01-20")


def risk_baselines(spark, d) -> DataFrame:
    """One calibrated naive Bayes for each of two targets of a call, measured on later calls."""
    rows = cut(view(spark, d, "call_center_interactions").where("reason_category = 'Transaccional'"))
    t = F.col("interaction_date")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in RISK_SPLIT)
    sides = {"train": t < a, "calibration": (t >= a) & (t < b), "test": t >= b}
    out = []
    for target in ("requires_followup", "was_escalated"):
        make = lambda x: bayes.records(x, "interaction_id", F.col(target), ["interaction_type", "channel"], ("interaction_date", "interaction"))  # noqa: B023, E731
        known = rows.where(F.col(target).isNotNull())
        model = bayes.fit(cut(make(known.where(sides["train"]))))
        scored = {part: cut(bayes.predict(make(known.where(sides[part])), *model).where("class")) for part in ("calibration", "test")}
        fitted = bayes.platt(scored["calibration"])
        test = scored["test"].withColumn("probability", bayes.calibrated(F.col("probability"), *fitted))
        out.append(bayes.binary_metrics(bank.coarse(test)).withColumn("target", F.lit(target)))
    return reduce(DataFrame.unionAll, out)


register("n6_risk_baselines", risk_baselines, None)

# evaluators beyond the base ones
EXTENDED = {**evaluation.STRUCTURED_METRICS, **evaluation.GRAPH_METRICS, **evaluation.BASELINE_METRICS}
CONTEXT = """o_orderkey AS run_id, o_orderkey % 5 > 0 AS catalog_loaded, o_orderkey % 3 > 0 AS catalog_first, CASE WHEN o_orderkey % 7 > 0 THEN 'v1' END AS evidence_version,
CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 2 = 0 END AS selection_matches, o_orderkey % 6 = 0 AS control_plane_invoked, o_orderkey % 10 = 0 AS privacy_gate_invoked, o_orderkey % 15 = 0 AS guardrail_invoked,
CASE WHEN o_orderkey % 9 = 0 THEN 'timeout' END AS error_code, CASE WHEN o_orderkey % 8 > 0 THEN o_totalprice END AS duration_ms, o_orderkey % 12 - 1 AS retrieval_attempts FROM"""
register(
    "e1_extended",
    lambda s, d: evaluation.evaluated(s.sql(f"SELECT {CONTEXT} {{o}}", o=s.read.parquet(f"{d}/orders.parquet")), EXTENDED).groupBy("metric", "reason").agg(F.count("*").alias("n")),
    f"WITH c AS (SELECT {CONTEXT} orders), r AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, coalesce({condition}, false) AS ok, '{reason}' AS why FROM c" for m, (condition, reason) in EXTENDED.items())
    + ") SELECT metric, CASE WHEN NOT ok THEN why END AS reason, count(*) AS n FROM r GROUP BY 1, 2",
)
register(
    "a26_matrix_totals",
    lambda s, d: evaluation.matrix_totals(evaluation.evaluated(bank.contexts(s, d))),
    f"WITH {bank.CONTEXTS}, r AS ("
    + " UNION ALL ".join(f"SELECT coalesce({'same' if m == 'trajectory_in_order' else condition}, false) AS ok FROM c" for m, (condition, _) in evaluation.BASE_METRICS.items())
    + ") SELECT count(*) AS results, count_if(ok) AS passed, count_if(NOT ok) AS failed FROM r",
)
CHECKS = ", ".join(f"CASE WHEN o_orderkey % {i + 2} > 0 THEN true WHEN o_orderkey % 3 = 0 THEN false END AS {c}" for i, c in enumerate(evaluation.COMPLETENESS))
RUN = f"o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'controlled' END AS pipeline, {CHECKS} FROM"
register(
    "a27_completeness",
    lambda s, d: evaluation.completeness(s.sql(f"SELECT {RUN} {{o}}", o=s.read.parquet(f"{d}/orders.parquet"))).groupBy("pipeline", "check").agg(F.count_if("passed").alias("passed"), F.count("*").alias("n")),
    f"WITH c AS (SELECT {RUN} orders), r AS ("
    + " UNION ALL ".join(f"SELECT pipeline, '{c}' AS \"check\", coalesce({c}, false) AS ok FROM c" for c in evaluation.COMPLETENESS)
    + ') SELECT pipeline, "check", count_if(ok) AS passed, count(*) AS n FROM r GROUP BY 1, 2',
)

# windows and closed queries whose limits bind
register(
    "w7_last_three_turns",
    lambda s, d: sampling.last_turns(s.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", 3).select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3",
)


def one_product(spark, d) -> DataFrame:
    """The status of the first product that a customer of the table has."""
    owner, product = view(spark, d, "products").agg(F.min(F.struct("customer_id", "product_id")).alias("x")).select("x.*").first()
    return bank.closed(spark, d, "product_status@1", {"product_id": product}, owner)


register(
    "q2_own_product",
    one_product,
    f"WITH {cte('products')} SELECT product_id, product_status FROM products ORDER BY customer_id, product_id LIMIT 1",
)
