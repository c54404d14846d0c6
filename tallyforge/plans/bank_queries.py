"""The registered queries over the bank tables, each beside the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.lineage import cut
from tallyforge.operators import bayes, cohorts, evaluation, graph, items, mining, prepare, profile, reports, rules, sampling
from tallyforge.plans import closed_queries
from tallyforge.plans import comparison as sql
from tallyforge.plans.catalogue import register
from tallyforge.sources.canonical import TIEBREAKS, cte, view
from tallyforge.sources.contracts import CONTRACTS

START, END = sql.START, sql.END
PERIOD = f"category = 'Transactions' AND creation_date >= TIMESTAMP '{START}' AND creation_date < TIMESTAMP '{END}'"


def staged(spark, d, name):
    return prepare.staged(view(spark, d, name), CONTRACTS[name], TIEBREAKS.get(name, ()))


def curated(spark, d, name, mode="canonical"):
    return prepare.imputed(staged(spark, d, name), CONTRACTS[name], prepare.RULES[name], mode)


def mining_rows(spark, d, name):
    rows = curated(spark, d, name)
    return rows.where(F.upper("category") == "TRANSACTIONS") if name == "complaints" else rows


def basketed(rows, name):
    """Distinct baskets with their weights. Lineage is cut: bounds go over the rows before the items, and every strategy over the items several times."""
    return cut(items.weighted(mined_columns(rows, name), items.POPULATIONS[name], sql.MOST), "baskets")


def mined_columns(rows, name):
    p = items.POPULATIONS[name]
    return cut(rows.select(*dict.fromkeys((p.key, p.time, p.target, *p.categorical, *p.boolean, *p.numeric))), "mined-columns")


def baskets(spark, d, name):
    return basketed(mining_rows(spark, d, name), name)


def period(spark, d):
    return reports.population(view(spark, d, "complaints"), START, END)


def rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def joined(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    return df.withColumn(column, F.concat_ws(sep, column))


# reports and profiles
register(
    "a1_motive_share",
    lambda s, d: reports.motive_share(period(s, d)),
    f"""WITH {cte('complaints')}, c AS (SELECT coalesce(subcategory, 'UNKNOWN') AS motive, coalesce(case_type, 'UNKNOWN') AS case_type, count(*) AS complaint_count
FROM complaints WHERE {PERIOD} GROUP BY 1, 2) SELECT *, round(complaint_count / sum(complaint_count) OVER (), 6) AS share FROM c""",
)
register(
    "a2_denominator",
    lambda s, d: reports.denominators(period(s, d)),
    f"WITH {cte('complaints')} SELECT count(*) AS population_count, "
    + ", ".join(f"count_if(priority = '{p}') AS priority_{p.lower()}" for p in reports.PRIORITIES)
    + ", "
    + ", ".join(f"count_if(status = '{x}') AS status_{x.lower().replace(' ', '_')}" for x in reports.STATUSES)
    + f", count(reception_channel) AS with_reception_channel FROM complaints WHERE {PERIOD}",
)
register(
    "a3_monthly",
    lambda s, d: reports.monthly(period(s, d)),
    f"""WITH {cte('complaints')} SELECT strftime(creation_date - INTERVAL 5 HOUR, '%Y-%m') AS year_month, count(*) AS volume,
count_if(priority IN ('High', 'Critical')) AS high_or_critical_count, count_if(status = 'Escalated') AS escalated_count, count_if(sla_breached) AS sla_breached_count,
round(avg(CASE WHEN status IN ('Resolved', 'Closed') THEN resolution_days END), 4) AS mean_resolution_days_terminal FROM complaints WHERE {PERIOD} GROUP BY 1""",
)
register(
    "a4_resolution_kpi",
    lambda s, d: reports.resolution_baseline(period(s, d)),
    f"""WITH {cte('complaints')} SELECT count(*) AS terminal_population, count(resolution_days) AS with_resolution_days, round(avg(resolution_days), 6) AS mean_resolution_days,
quantile_cont(resolution_days, 0.5) AS p50_resolution_days, quantile_cont(resolution_days, 0.9) AS p90_resolution_days, count_if(sla_breached) AS sla_breached_count,
round(count_if(sla_breached) / count(*), 6) AS sla_breach_rate FROM complaints WHERE {PERIOD} AND status IN ('Resolved', 'Closed') AND resolution_days IS NOT NULL""",
)
register(
    "a6_profile",
    lambda s, d: profile.source_profile(view(s, d, "transactions"), CONTRACTS["transactions"]),
    f"""WITH {cte('transactions')} SELECT count(*) AS row_count, count(DISTINCT transaction_id) AS distinct_primary_keys,
count(*) - count(DISTINCT transaction_id) AS duplicate_primary_key_count, min(transaction_date) AS freshness_min, max(transaction_date) AS freshness_max, """
    + ", ".join(f"count_if({f.name} IS NULL) AS null_{f.name}" for f in CONTRACTS["transactions"].fields)
    + " FROM transactions",
)
register(
    "a7_frame_profile",
    lambda s, d: profile.numeric_profile(view(s, d, "complaints"), ["claimed_amount", "resolution_days"]),
    f"WITH {cte('complaints')}, "
    + "q AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v FROM complaints" for c in ("claimed_amount", "resolution_days")
    )
    + """), s AS (SELECT col, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM q GROUP BY col)
SELECT q.col AS "column", count_if(v IS NULL) AS null_count, count(DISTINCT v) AS distinct_count, round(min(v), 6) AS min_value, round(any_value(s.q)[1], 6) AS q1,
round(any_value(s.q)[2], 6) AS median, round(any_value(s.q)[3], 6) AS q3, round(max(v), 6) AS max_value,
count_if(v < s.q[1] - 1.5 * (s.q[3] - s.q[1]) OR v > s.q[3] + 1.5 * (s.q[3] - s.q[1])) AS outlier_count FROM q JOIN s ON q.col = s.col GROUP BY q.col""",
)
register(
    "a12_mode",
    lambda s, d: prepare.modes(view(s, d, "complaints"), "subcategory", ("category",)),
    f"""WITH {cte('complaints')} SELECT category, subcategory AS mode_value FROM (SELECT category, subcategory,
row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, subcategory) AS rn FROM complaints WHERE subcategory IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
)
register(
    "a14_class_counts",
    lambda s, d: view(s, d, "transactions").groupBy("is_fraud").agg(F.count("*").alias("row_count")),
    f"WITH {cte('transactions')} SELECT is_fraud, count(*) AS row_count FROM transactions GROUP BY 1",
)

# preparation
register(
    "w1_latest_dedupe",
    lambda s, d: rounded(staged(s, d, "transactions")).select("transaction_id", "transaction_date", "amount", "transaction_type"),
    f"WITH {cte('transactions')}, {sql.staged('transactions')} SELECT transaction_id, transaction_date, round(amount, 6) AS amount, transaction_type FROM stg_transactions",
)
for name in ("transactions", "complaints", "call_center_interactions", "satisfaction_surveys"):
    fields = CONTRACTS[name].fields
    numeric = {f.name for f in fields if "FLOAT64" in f.types}
    listed = ", ".join(f"round({f.name}, 6) AS {f.name}" if f.name in numeric else f.name for f in fields)
    flags = [r.column for r in prepare.RULES[name]]
    register(
        f"i1_stg_{name}",
        lambda s, d, n=name: rounded(staged(s, d, n)),
        f"WITH {cte(name)}, {sql.staged(name)} SELECT {listed} FROM stg_{name}",
    )
    if flags:
        register(
            f"i2_aux_{name}",
            lambda s, d, n=name: rounded(prepare.flagged(staged(s, d, n), prepare.RULES[n])),
            f"WITH {cte(name)}, {sql.staged(name)} SELECT {listed}, {', '.join(f'({c} IS NULL) AS {c}_is_null' for c in flags)} FROM stg_{name}",
        )
        for mode in ("canonical", "strict"):
            register(
                f"{'i3_cur' if mode == 'canonical' else 'i6_strict'}_{name}",
                lambda s, d, n=name, m=mode: rounded(curated(s, d, n, m)),
                f"WITH {cte(name)}, {sql.staged(name)}, {sql.curated(name, mode)} SELECT {listed}, {', '.join(f'{c}_was_imputed' for c in flags)} FROM cur_{name}",
            )

# samples, splits, joins
register(
    "l1_hash_sample",
    lambda s, d: sampling.hash_sample(view(s, d, "complaints"), "complaint_id", 500).select("complaint_id", "status"),
    f"WITH {cte('complaints')} SELECT complaint_id, status FROM complaints ORDER BY md5(complaint_id), complaint_id LIMIT 500",
)
register(
    "w5_stratified",
    lambda s, d: sampling.stratified(view(s, d, "complaints"), "sla_breached", "complaint_id", 100, 400).select("complaint_id", "sla_breached"),
    f"""WITH {cte('complaints')} SELECT complaint_id, sla_breached FROM (SELECT *, row_number() OVER (PARTITION BY sla_breached ORDER BY md5(complaint_id), complaint_id) AS rn
FROM complaints WHERE sla_breached IS NOT NULL) WHERE rn <= CASE WHEN sla_breached THEN 100 ELSE 400 END""",
)
register(
    "l3_weights",
    lambda s, d: sampling.prevalence_weights(
        sampling.stratified(view(s, d, "complaints"), "sla_breached", "complaint_id", 100, 400), "sla_breached", {True: 1000, False: 9000}
    ).groupBy("sla_breached").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")),
    f"""WITH {cte('complaints')}, r AS (SELECT sla_breached, row_number() OVER (PARTITION BY sla_breached ORDER BY md5(complaint_id), complaint_id) AS rn FROM complaints),
k AS (SELECT sla_breached, count(*) AS n FROM r WHERE rn <= CASE WHEN sla_breached THEN 100 ELSE 400 END GROUP BY 1)
SELECT sla_breached, n, round(n * (CASE WHEN sla_breached THEN 1000 ELSE 9000 END / n), 6) AS weight FROM k""",
)
CUT = f"epoch_us(TIMESTAMP '{START}') / 1e6 + (epoch_us(TIMESTAMP '{END}') - epoch_us(TIMESTAMP '{START}')) / 1e6 * (1 - {sql.FRACTION})"
register(
    "l9_holdout_split",
    lambda s, d: view(s, d, "complaints").groupBy(sampling.holdout_side(None, "creation_date", START, END, sql.FRACTION).alias("holdout")).agg(F.count("*").alias("n")),
    f"WITH {cte('complaints')} SELECT epoch_us(creation_date) / 1e6 >= {CUT} AS holdout, count(*) AS n FROM complaints GROUP BY 1",
)
register(
    "l10_blocks",
    lambda s, d: view(s, d, "complaints").groupBy(sampling.block_number("creation_date", START, END, 4).alias("block")).agg(F.count("*").alias("n")),
    f"""WITH {cte('complaints')}, b AS (SELECT epoch_us(TIMESTAMP '{START}') / 1e6 AS a, epoch_us(TIMESTAMP '{END}') / 1e6 AS z)
SELECT CAST(least(floor((epoch_us(creation_date) / 1e6 - a) / (z - a) * 4), 3) AS INTEGER) AS block, count(*) AS n FROM complaints, b
WHERE creation_date >= TIMESTAMP '{START}' AND creation_date < TIMESTAMP '{END}' GROUP BY 1""",
)
register(
    "w7_last_turns",
    lambda s, d: sampling.last_turns(s.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", 20).select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20",
)
register(
    "j1_survey_join",
    lambda s, d: sampling.hash_sample(
        view(s, d, "call_center_interactions").join(view(s, d, "satisfaction_surveys"), "interaction_id").where("reason_category = 'Transaccional' AND main_score IS NOT NULL"),
        "interaction_id", 2000,
    ).select("interaction_id", "interaction_type", "channel", "main_score"),
    f"""WITH {cte('call_center_interactions', 'satisfaction_surveys')} SELECT interaction_id, interaction_type, channel, main_score FROM call_center_interactions
JOIN satisfaction_surveys USING (interaction_id) WHERE reason_category = 'Transaccional' AND main_score IS NOT NULL ORDER BY md5(interaction_id), interaction_id LIMIT 2000""",
)

# closed queries
CATALOG = closed_queries.load(closed_queries.ENTRIES)


def closed(spark, d, key, given, customer):
    entry = CATALOG[key]
    session = {"customer_id": customer}
    return closed_queries.execute(spark, entry, closed_queries.of_owner(entry, view(spark, d, entry.table), session), given, session, "client")


register(
    "q1_products",
    lambda s, d: closed(s, d, "customer_products@1", {}, "77"),
    f"WITH {cte('products')} SELECT product_id, product_type, currency, current_balance, product_status, opening_date FROM products WHERE customer_id = '77' ORDER BY opening_date DESC, product_id LIMIT 50",
)
register(
    "q2_product",
    lambda s, d: closed(s, d, "product_status@1", {"product_id": "1"}, "77"),
    f"WITH {cte('products')} SELECT product_id, product_status FROM products WHERE customer_id = '77' AND product_id = '1' LIMIT 1",
)
register(
    "q3_recent_tx",
    lambda s, d: closed(s, d, "recent_transactions@1", {"date_from": "1996-01-01", "date_to": "2001-12-31"}, "77"),
    f"""WITH {cte('transactions')} SELECT transaction_id, transaction_date, amount, currency, transaction_status FROM transactions WHERE customer_id = '77'
AND CAST(transaction_date AS DATE) >= DATE '1996-01-01' AND CAST(transaction_date AS DATE) <= DATE '2001-12-31' ORDER BY transaction_date DESC, transaction_id, amount LIMIT 20""",
)
register(
    "q4_cohort",
    lambda s, d: closed_queries.demo_cohort(view(s, d, "transactions"), view(s, d, "complaints")),
    f"""WITH {cte('transactions', 'complaints')} SELECT t.customer_id FROM transactions t LEFT JOIN complaints c USING (customer_id) WHERE t.customer_id IS NOT NULL
GROUP BY t.customer_id HAVING count(*) >= 3 AND count_if(c.category = 'Transactions') >= 1 ORDER BY md5(t.customer_id), t.customer_id LIMIT 3""",
)

# items, itemsets, rules
for name in ("complaints", "transactions"):
    register(
        f"m4_item_support_{name}",
        lambda s, d, n=name: items.support(baskets(s, d, n)).select("item", "n", F.round("support", 6).alias("support")),
        f"{sql.tables(name)}, {sql.population_rows(name)}, {sql.item_rows(name)} SELECT item, count(*) AS n, round(count(*) / (SELECT count(DISTINCT key) FROM it), 6) AS support FROM it GROUP BY item",
    )
register(
    "m1_items",
    lambda s, d: joined(items.baskets(mined_columns(mining_rows(s, d, "complaints"), "complaints"), items.POPULATIONS["complaints"], sql.MOST).select("key", "items"), "items"),
    f"{sql.tables('complaints')}, {sql.population_rows('complaints')}, {sql.item_rows('complaints')} SELECT key, string_agg(item, ',' ORDER BY item) AS items FROM it GROUP BY key",
)
SETS = f"{sql.tables('complaints')}, {sql.population_rows('complaints')}, {sql.item_rows('complaints')}, {sql.itemsets()} SELECT array_to_string(items, ',') AS items, n FROM sets"
for key, strategy in (("m5_apriori", mining.apriori), ("m6_fpgrowth", mining.fpgrowth), ("m7_eclat", mining.eclat), ("m8_hybrid", mining.hybrid)):
    register(key, lambda s, d, f=strategy: joined(f(baskets(s, d, "complaints"), sql.SUPPORT, sql.LONGEST), "items"), SETS)
register(
    "m5_apriori_transactions",
    lambda s, d: joined(mining.apriori(baskets(s, d, "transactions"), sql.SUPPORT, sql.LONGEST), "items"),
    SETS.replace(sql.tables("complaints"), sql.tables("transactions")).replace(sql.population_rows("complaints"), sql.population_rows("transactions")).replace(sql.item_rows("complaints"), sql.item_rows("transactions")),
)
register(
    "m9_maximal",
    lambda s, d: joined(mining.maximal(mining.apriori(baskets(s, d, "complaints"), sql.SUPPORT, sql.LONGEST)), "items"),
    SETS + " a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.k = a.k + 1 AND list_has_all(b.items, a.items))",
)


def raw_rules(spark, d, name="complaints", rows=None):
    rows = baskets(spark, d, name) if rows is None else rows
    found = mining.apriori(rows, sql.SUPPORT, sql.LONGEST)
    return rules.rules(found, items.size(rows), items.POPULATIONS[name].target, sql.CONFIDENCE, sql.LIFT)


def refined_rules(spark, d, name="complaints", rows=None):
    return rules.refined(raw_rules(spark, d, name, rows), items.POPULATIONS[name].hierarchy)


def strategy_rules(spark, d, *strategies):
    p, rows = items.POPULATIONS["complaints"], baskets(spark, d, "complaints")  # once for all
    return [rules.mined(rows, p, sql.SUPPORT, sql.LONGEST, sql.CONFIDENCE, sql.LIFT, f) for f in strategies]


MINED = sql.mined("complaints")
RULE = "array_to_string(antecedents, ',') AS antecedents, consequent, support, confidence, lift"
register("m10_rules", lambda s, d: joined(raw_rules(s, d), "antecedents"), f"{MINED} SELECT {RULE} FROM raw")
register("m11_no_hierarchy", lambda s, d: joined(rules.without_hierarchy(raw_rules(s, d), items.POPULATIONS["complaints"].hierarchy), "antecedents"), f"{MINED} SELECT {RULE} FROM flat")
register(
    "m12_han",
    lambda s, d: joined(rules.without_descendants(rules.without_hierarchy(raw_rules(s, d), (("category", "subcategory"),)), (("category", "subcategory"),)), "antecedents"),
    f"{MINED} SELECT {RULE} FROM han",
)
register("m13_refined", lambda s, d: joined(refined_rules(s, d), "antecedents"), f"{MINED} SELECT {RULE} FROM refined")
register(
    "m14_consensus",
    lambda s, d: joined(rules.consensus(*strategy_rules(s, d, mining.apriori, mining.fpgrowth, mining.eclat)), "antecedents"),
    f"{MINED} SELECT {RULE} FROM refined",
)
register(
    "m17_enrich",
    lambda s, d: joined(rules.enriched(refined_rules(s, d)), "antecedents"),
    f"""{MINED} SELECT {RULE}, round(confidence / lift, 6) AS consequent_prevalence, CASE WHEN confidence < 1 - 1e-12 THEN round((1 - confidence / lift) / (1 - confidence), 6) END AS conviction,
round(support * (1 - 1 / lift), 6) AS leverage, len(antecedents) AS antecedent_length FROM refined""",
)
register(
    "a17_feature_frequency",
    lambda s, d: refined_rules(s, d).select(F.explode("antecedents").alias("i")).groupBy(F.split_part("i", F.lit("="), F.lit(1)).alias("feature")).agg(F.count("*").alias("n")),
    f"{MINED} SELECT split_part(i, '=', 1) AS feature, count(*) AS n FROM (SELECT unnest(antecedents) AS i FROM refined) GROUP BY 1",
)
register(
    "a16_lift_distribution",
    lambda s, d: refined_rules(s, d).groupBy("consequent").agg(
        F.count("*").alias("n"), F.min("lift").alias("low"), F.round(F.percentile("lift", 0.5), 6).alias("p50"), F.round(F.percentile("lift", 0.9), 6).alias("p90"),
        F.max("lift").alias("high"), F.round(F.avg("lift"), 6).alias("mean"),
    ),
    f"""{MINED} SELECT consequent, count(*) AS n, min(lift) AS low, round(quantile_cont(lift, 0.5), 6) AS p50, round(quantile_cont(lift, 0.9), 6) AS p90, max(lift) AS high, round(avg(lift), 6) AS mean
FROM refined GROUP BY 1""",
)
register(
    "l6_top_lift",
    lambda s, d: joined(refined_rules(s, d), "antecedents").orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequent").limit(10),
    f"{MINED} SELECT {RULE} FROM refined ORDER BY lift DESC, confidence DESC, support DESC, 1, consequent LIMIT 10",
)


def side_rows(spark, d, name, later, rows=None):
    rows = mining_rows(spark, d, name) if rows is None else rows
    p = items.POPULATIONS[name]
    side = sampling.holdout_side(rows, p.time, START, END, sql.FRACTION)
    return basketed(rows.where(side if later else ~side), name)


def holdout(spark, d):
    rows = cut(mining_rows(spark, d, "complaints"), "curated")
    found = refined_rules(spark, d, rows=side_rows(spark, d, "complaints", False, rows))
    return joined(rules.evaluated(found, side_rows(spark, d, "complaints", True, rows), sql.LIFT, 0.1), "antecedents")


EARLY = f"rows_complaints AS (SELECT * FROM cur_complaints WHERE upper(category) = 'TRANSACTIONS' AND epoch_us(creation_date) / 1e6 < {CUT})"
LATE = f"late AS (SELECT * FROM cur_complaints WHERE upper(category) = 'TRANSACTIONS' AND epoch_us(creation_date) / 1e6 >= {CUT})"
EVALUATED = f"""{sql.tables('complaints')}, {EARLY}, {LATE}, {sql.item_rows('complaints')}, {sql.item_rows('complaints', 'late', 'lt')}, {sql.itemsets()}, {sql.rules('complaints')},
bk AS (SELECT key, list(item) AS items FROM lt GROUP BY key), bn AS (SELECT count(*) AS total FROM bk),
ev AS (SELECT r.*, (SELECT count(*) FROM bk WHERE list_has_all(items, r.antecedents)) AS nl, (SELECT count(*) FROM bk WHERE list_has_all(items, r.antecedents) AND list_contains(items, r.consequent)) AS nb,
  (SELECT count(*) FROM bk WHERE list_contains(items, r.consequent)) AS nr, total FROM refined r, bn),
ew AS (SELECT *, nb / total AS s, CASE WHEN nl = 0 THEN 0 ELSE nb / nl END AS c, CASE WHEN nl = 0 OR nr = 0 THEN 0 ELSE (nb / nl) / (nr / total) END AS l FROM ev)"""
register(
    "m15_holdout",
    holdout,
    f"""{EVALUATED} SELECT array_to_string(antecedents, ',') AS antecedents, consequent, support AS train_support, confidence AS train_confidence, lift AS train_lift, round(s, 6) AS holdout_support,
round(c, 6) AS holdout_confidence, round(l, 6) AS holdout_lift, round(abs(c - confidence), 6) AS confidence_delta, (l >= {sql.LIFT} AND abs(c - confidence) <= 0.1) AS stable FROM ew""",
)


def folds(spark, d, blocks=2):
    """Rules mined without each block in time, and how many of them each pair of folds shares."""
    p = items.POPULATIONS["complaints"]
    rows = cut(mining_rows(spark, d, "complaints"), "curated").withColumn("__b", sampling.block_number(p.time, START, END, blocks))
    found = [refined_rules(spark, d, rows=basketed(rows.where(F.col("__b") != b), "complaints")) for b in range(blocks)]
    return rules.jaccard(found[0], found[1])


BLOCK = f"CAST(least(floor((epoch_us(creation_date) / 1e6 - epoch_us(TIMESTAMP '{START}') / 1e6) / (epoch_us(TIMESTAMP '{END}') / 1e6 - epoch_us(TIMESTAMP '{START}') / 1e6) * 2), 1) AS INTEGER)"
register(
    "m16_folds",
    folds,
    f"{sql.tables('complaints')}, "
    + ", ".join(
        f"b{b} AS (SELECT * FROM cur_complaints WHERE upper(category) = 'TRANSACTIONS' AND creation_date >= TIMESTAMP '{START}' AND creation_date < TIMESTAMP '{END}' AND {BLOCK} <> {b}), "
        f"{sql.item_rows('complaints', f'b{b}', f'i{b}')}, {sql.itemsets(f'i{b}', f'p{b}')}, {sql.rules('complaints', f'p{b}')}"
        for b in (0, 1)
    )
    + """, x AS (SELECT a.antecedents AS l, b.antecedents AS r FROM p0refined a FULL JOIN p1refined b ON a.antecedents = b.antecedents AND a.consequent = b.consequent)
SELECT count_if(l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) AS total, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count_if(l IS NOT NULL AND r IS NOT NULL) / count(*), 6) END AS jaccard FROM x""",
)

# baselines
SPLIT = ("1999-01-01", "2000-01-01")
FEATURES = ["case_type", "category", "subcategory", "reception_channel", "priority", "currency", "is_repeat_complainer"]
LEVELS = ("LOW", "MEDIUM", "HIGH", "EXTREME")


def breach_records(spark, d, *parts):
    """Records of the parts named; the amount's bounds come from the training rows."""
    rows = cut(mining_rows(spark, d, "complaints").where("sla_breached IS NOT NULL"))
    t = F.col("creation_date")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in SPLIT)
    side = {"train": t < a, "calibration": (t >= a) & (t < b), "test": t >= b}
    limits = cut(bayes.amount_limits(rows.where(side["train"]), "claimed_amount", items.QUANTILES))
    made = lambda x: bayes.records(x, "complaint_id", F.col("sla_breached"), FEATURES, ("creation_date", "creation"), "claimed_amount", limits, LEVELS)
    return [cut(made(rows.where(side[part]))) for part in parts]


def breach_scores(spark, d, *parts):
    train, *others = breach_records(spark, d, "train", *parts)
    model = bayes.fit(train)
    return [cut(bayes.predict(x, *model).where("class").select("key", "label", "probability")) for x in others]


def record_sql(part: str) -> str:
    when = {"train": f"creation_date < TIMESTAMP '{SPLIT[0]}'", "test": f"creation_date >= TIMESTAMP '{SPLIT[1]}'"}[part]
    boolean = "CASE WHEN is_repeat_complainer THEN 'TRUE' WHEN NOT is_repeat_complainer THEN 'FALSE' END"
    values = {f: sql.sanitized(boolean if f == "is_repeat_complainer" else f) for f in FEATURES}
    values["creation_month"] = "strftime(creation_date, 'M%m')"
    values["creation_weekday"] = "'D' || CAST(isodow(creation_date) - 1 AS VARCHAR)"
    a = "abs(claimed_amount)"
    values["claimed_amount_bucket"] = f"CASE WHEN claimed_amount IS NULL THEN 'MISSING' WHEN {a} <= q[1] THEN 'LOW' WHEN {a} <= q[2] THEN 'MEDIUM' WHEN {a} <= q[3] THEN 'HIGH' ELSE 'EXTREME' END"
    parts = [f"SELECT complaint_id AS key, sla_breached AS label, '{f}' AS feature, {v} AS value FROM rows_complaints, lim WHERE sla_breached IS NOT NULL AND {when}" for f, v in values.items()]
    return f"{part}_r AS ({' UNION ALL '.join(parts)})"


NB = f"""{sql.tables('complaints')}, {sql.population_rows('complaints')},
lim AS (SELECT quantile_cont(abs(claimed_amount), [0.5, 0.9, 0.99]) AS q FROM rows_complaints WHERE sla_breached IS NOT NULL AND creation_date < TIMESTAMP '{SPLIT[0]}'),
{record_sql('train')}, {record_sql('test')},
tot AS (SELECT label, count(DISTINCT key) AS total FROM train_r GROUP BY 1),
pri AS (SELECT label, total, ln((total + 1.0) / (sum(total) OVER () + count(*) OVER ())) AS lp FROM tot),
cnt AS (SELECT label, feature, value, count(*) AS n FROM train_r GROUP BY 1, 2, 3),
dom AS (SELECT DISTINCT feature, value FROM train_r), siz AS (SELECT feature, count(*) AS size FROM dom GROUP BY 1),
lik AS (SELECT p.label, d.feature, d.value, ln((coalesce(n, 0) + 1.0) / (total + size)) AS ll FROM pri p CROSS JOIN dom d JOIN siz USING (feature)
  LEFT JOIN cnt c ON c.label = p.label AND c.feature = d.feature AND c.value = d.value),
ks AS (SELECT DISTINCT key, label FROM test_r),
sco AS (SELECT k.key, k.label, p.label AS class, any_value(p.lp) + coalesce(sum(l.ll), 0) AS s FROM ks k CROSS JOIN pri p
  LEFT JOIN test_r t ON t.key = k.key LEFT JOIN lik l ON l.label = p.label AND l.feature = t.feature AND l.value = t.value GROUP BY 1, 2, 3),
pr AS (SELECT key, label, class, exp(s - max(s) OVER (PARTITION BY key)) / sum(exp(s - max_s)) OVER (PARTITION BY key) AS probability FROM (SELECT *, max(s) OVER (PARTITION BY key) AS max_s FROM sco)),
sc AS (SELECT key, label, probability FROM pr WHERE class)"""
register(
    "n2_nb_counts",
    lambda s, d: bayes.counts(breach_records(s, d, "train")[0]),
    f"{NB} SELECT label, feature, value, n FROM cnt",
)
register(
    "n2_nb_scores",
    lambda s, d: breach_scores(s, d, "test")[0].select("key", "label", F.round("probability", 6).alias("probability")),
    f"{NB} SELECT key, label, round(probability, 6) AS probability FROM sc",
)
register(
    "a20_bins",
    lambda s, d: bayes.calibration_bins(breach_scores(s, d, "test")[0]),
    f"""{NB} SELECT CAST(least(floor(probability * 10), 9) AS INTEGER) AS bin, count(*) AS count, round(avg(probability), 6) AS mean_probability,
round(avg(CASE WHEN label THEN 1.0 ELSE 0.0 END), 6) AS observed_rate FROM sc GROUP BY 1""",
)
register(
    "a21_confusion",
    lambda s, d: bayes.confusion(breach_scores(s, d, "test")[0]),
    f"{NB} SELECT label, probability >= 0.5 AS predicted, count(*) AS n FROM sc GROUP BY 1, 2",
)


def coarse(scores: DataFrame) -> DataFrame:
    """Both engines sum logarithms in their own order; ten digits make ties the same in both."""
    return scores.withColumn("probability", F.round("probability", 10))


register(
    "a22_ap_brier",
    lambda s, d: bayes.binary_metrics(coarse(breach_scores(s, d, "test")[0])),
    f"""{NB}, r AS (SELECT label, round(probability, 10) AS p FROM sc), st AS (SELECT p, count(*) AS w, count_if(label) AS hit FROM r GROUP BY p),
ap AS (SELECT sum(hit * prec) AS area FROM (SELECT hit, sum(hit) OVER (ORDER BY p DESC) / sum(w) OVER (ORDER BY p DESC) AS prec FROM st))
SELECT count(*) AS row_count, round(count_if(label) / count(*), 6) AS weighted_prevalence, round(any_value(area) / nullif(count_if(label), 0), 6) AS pr_auc,
round(avg(pow(p - CASE WHEN label THEN 1 ELSE 0 END, 2)), 6) AS brier_score, round(coalesce(count_if(label AND p >= 0.5) / nullif(count_if(label), 0), 0), 6) AS recall_at_0_5 FROM r, ap""",
)


def platt(spark, d):
    calibration, scores = breach_scores(spark, d, "calibration", "test")
    coefficient, intercept = bayes.platt(calibration)
    return scores.select("key", "label", F.round(bayes.calibrated(F.col("probability"), coefficient, intercept), 6).alias("probability"))


register("n3_platt", platt, None)


def survey_rows(spark, d):
    both = view(spark, d, "call_center_interactions").join(view(spark, d, "satisfaction_surveys"), "interaction_id")
    return both.where("reason_category = 'Transaccional' AND main_score IS NOT NULL")


def survey_predictions(spark, d):
    rows = survey_rows(spark, d)
    part = F.col("interaction_date") < F.lit("2024-01-20").cast("timestamp_ntz")
    make = lambda x: bayes.records(x, "interaction_id", F.col("main_score"), ["interaction_type", "channel"], ("interaction_date", "interaction"))
    return bayes.ordinal_predictions(bayes.predict(make(rows.where(~part)), *bayes.fit(make(rows.where(part)))))


ORDINAL = f"""WITH {cte('call_center_interactions', 'satisfaction_surveys')},
al AS (SELECT interaction_id AS key, main_score AS label, interaction_date < TIMESTAMP '2024-01-20' AS early, unnest([
  {{'f': 'interaction_type', 'v': {sql.sanitized('interaction_type')}}}, {{'f': 'channel', 'v': {sql.sanitized('channel')}}},
  {{'f': 'interaction_month', 'v': strftime(interaction_date, 'M%m')}}, {{'f': 'interaction_weekday', 'v': 'D' || CAST(isodow(interaction_date) - 1 AS VARCHAR)}}]) AS x
  FROM call_center_interactions JOIN satisfaction_surveys USING (interaction_id) WHERE reason_category = 'Transaccional' AND main_score IS NOT NULL),
tr AS (SELECT key, label, x.f AS feature, x.v AS value FROM al WHERE early), te AS (SELECT key, label, x.f AS feature, x.v AS value FROM al WHERE NOT early),
tot AS (SELECT label, count(DISTINCT key) AS total FROM tr GROUP BY 1),
pri AS (SELECT label, total, ln((total + 1.0) / (sum(total) OVER () + count(*) OVER ())) AS lp FROM tot),
cnt AS (SELECT label, feature, value, count(*) AS n FROM tr GROUP BY 1, 2, 3), dom AS (SELECT DISTINCT feature, value FROM tr), siz AS (SELECT feature, count(*) AS size FROM dom GROUP BY 1),
lik AS (SELECT p.label, d.feature, d.value, ln((coalesce(n, 0) + 1.0) / (total + size)) AS ll FROM pri p CROSS JOIN dom d JOIN siz USING (feature)
  LEFT JOIN cnt c ON c.label = p.label AND c.feature = d.feature AND c.value = d.value),
ks AS (SELECT DISTINCT key, label FROM te),
sco AS (SELECT k.key, k.label, p.label AS class, any_value(p.lp) + coalesce(sum(l.ll), 0) AS s FROM ks k CROSS JOIN pri p
  LEFT JOIN te t ON t.key = k.key LEFT JOIN lik l ON l.label = p.label AND l.feature = t.feature AND l.value = t.value GROUP BY 1, 2, 3),
pr AS (SELECT key, label, class, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY key) AS probability FROM (SELECT *, max(s) OVER (PARTITION BY key) AS m FROM sco)),
op AS (SELECT key, label, sum(class * probability) AS expected, arg_min(class, {{'p': -round(probability, 12), 'c': class}}) AS predicted FROM pr GROUP BY 1, 2)"""
register(
    "n7_ordinal",
    lambda s, d: survey_predictions(s, d).select("key", "label", F.round(F.round("expected", 9), 6).alias("expected"), "predicted"),  # the order of a sum cannot decide a tie
    f"{ORDINAL} SELECT key, label, round(round(expected, 9), 6) AS expected, predicted FROM op",
)
register(
    "a24_kappa",
    lambda s, d: bayes.ordinal_metrics(survey_predictions(s, d)),
    f"""{ORDINAL}, g AS (SELECT unnest(range(1, 8)) AS c), f AS (SELECT c, (SELECT count(*) FROM op WHERE label = c AND predicted = c) AS hit, (SELECT count(*) FROM op WHERE label = c) AS a,
  (SELECT count(*) FROM op WHERE predicted = c) AS b FROM g),
e AS (SELECT sum(x.a * y.b * pow(x.c - y.c, 2)) AS e FROM f x, f y)
SELECT count(*) AS row_count, round(avg(abs(label - expected)), 6) AS mae_expected_score, round((SELECT avg(CASE WHEN a + b = 0 THEN 0 ELSE 2 * hit / (a + b) END) FROM f), 6) AS macro_f1,
round(coalesce(1 - sum(pow(label - predicted, 2)) / nullif((SELECT e FROM e) / count(*), 0), 0), 6) AS quadratic_weighted_kappa FROM op""",
)


def cohort_parts(spark, d):
    rows = mining_rows(spark, d, "complaints").where("status IN ('Resolved', 'Closed') AND resolution_days IS NOT NULL")
    early = F.col("creation_date") < F.lit(SPLIT[1]).cast("timestamp_ntz")
    return cohorts.prepared(rows.where(early)), cohorts.prepared(rows.where(~early))


def cohort_predictions(spark, d):
    train, test = cohort_parts(spark, d)
    return cohorts.predictions(test, cohorts.cohort_quantiles(train, 30))


COHORT = f"""{sql.tables('complaints')}, {sql.population_rows('complaints')},
pp AS (SELECT complaint_id, {sql.sanitized('priority')} AS priority, {sql.sanitized('reception_channel')} AS reception_channel, resolution_days AS target, creation_date < TIMESTAMP '{SPLIT[1]}' AS early
  FROM rows_complaints WHERE status IN ('Resolved', 'Closed') AND resolution_days IS NOT NULL),
a AS (SELECT priority, reception_channel, round(quantile_cont(target, 0.5), 6) AS p50, round(quantile_cont(target, 0.9), 6) AS p90 FROM pp WHERE early GROUP BY 1, 2 HAVING count(*) >= 30),
b AS (SELECT priority, round(quantile_cont(target, 0.5), 6) AS p50, round(quantile_cont(target, 0.9), 6) AS p90 FROM pp WHERE early GROUP BY 1 HAVING count(*) >= 30),
c AS (SELECT round(quantile_cont(target, 0.5), 6) AS p50, round(quantile_cont(target, 0.9), 6) AS p90 FROM pp WHERE early),
cp AS (SELECT complaint_id, target, coalesce(a.p50, b.p50, c.p50) AS p50, coalesce(a.p90, b.p90, c.p90) AS p90,
  CASE WHEN a.p50 IS NOT NULL THEN 'priority_channel' WHEN b.p50 IS NOT NULL THEN 'priority' ELSE 'global' END AS cohort_level
  FROM pp LEFT JOIN a USING (priority, reception_channel) LEFT JOIN b USING (priority), c WHERE NOT early)"""
register("n4_cohort_predict", lambda s, d: cohort_predictions(s, d).select("complaint_id", "p50", "p90", "cohort_level"), f"{COHORT} SELECT complaint_id, p50, p90, cohort_level FROM cp")
register(
    "a23_cohort_evaluation",
    lambda s, d: cohorts.evaluation(cohort_predictions(s, d)),
    f"""{COHORT} SELECT cohort_level, count(*) AS row_count, round(avg(abs(target - p50)), 6) AS mae_against_p50, round(avg(CASE WHEN target <= p50 THEN 1.0 ELSE 0 END), 6) AS p50_empirical_coverage,
round(avg(CASE WHEN target <= p90 THEN 1.0 ELSE 0 END), 6) AS p90_empirical_coverage FROM cp GROUP BY 1""",
)
register(
    "a11_cohort_quantiles",
    lambda s, d: cohorts.cohort_quantiles(cohort_parts(s, d)[0], 30)[0],
    f"{COHORT} SELECT * FROM a",
)


# graph
def catalog_graph(spark, d, rows=None):
    """Nodes and edges of the items; lineage is cut, as both are read many times."""
    catalog = cut(items.support(baskets(spark, d, "complaints") if rows is None else rows).select("item"), "catalog")
    return graph.item_nodes(catalog, "complaints", "status")


def catalog_nodes(spark, d, which):
    return catalog_graph(spark, d)[which]


GRAPH = f"""{sql.tables('complaints')}, {sql.population_rows('complaints')}, {sql.item_rows('complaints')}, g AS (SELECT DISTINCT item, split_part(item, '=', 1) AS f, regexp_extract(item, '=(.*)$', 1) AS v FROM it)"""
register(
    "g1_nodes",
    lambda s, d: catalog_nodes(s, d, 0),
    f"""{GRAPH} SELECT 'population:complaints' AS id, 'population' AS kind, 'complaints' AS population, NULL AS feature, NULL AS value
UNION ALL SELECT DISTINCT 'feature:complaints:' || f, 'feature', 'complaints', f, NULL FROM g WHERE f <> 'status'
UNION ALL SELECT CASE f WHEN 'status' THEN 'target' ELSE 'value' END || ':complaints:' || item, CASE f WHEN 'status' THEN 'target' ELSE 'feature_value' END, 'complaints', f, v FROM g""",
)
EDGES = f"""{GRAPH}, ed AS (SELECT 'population:complaints' AS source, 'target:complaints:' || item AS target, 'has_target' AS relation FROM g WHERE f = 'status'
UNION ALL SELECT DISTINCT 'population:complaints', 'feature:complaints:' || f, 'has_feature' FROM g WHERE f <> 'status'
UNION ALL SELECT 'feature:complaints:' || f, 'value:complaints:' || item, 'has_value' FROM g WHERE f <> 'status')"""
register("g1_edges", lambda s, d: catalog_nodes(s, d, 1), f"{EDGES} SELECT * FROM ed")
register("k2_population", lambda s, d: graph.population_summary(catalog_nodes(s, d, 1), "complaints"), f"{EDGES} SELECT relation, count(*) AS n FROM ed GROUP BY 1")
register(
    "g2_rule_edges",
    lambda s, d: graph.rule_nodes(refined_rules(s, d), "complaints")[1].groupBy("relation", F.when(F.col("relation") == "predicts", F.col("target")).otherwise(F.col("source")).alias("end")).agg(F.count("*").alias("n"), F.round(F.sum("lift"), 4).alias("lift")),
    f"""{MINED} SELECT 'predicts' AS relation, 'target:complaints:' || consequent AS "end", count(*) AS n, round(sum(lift), 4) AS lift FROM refined GROUP BY 2
UNION ALL SELECT 'antecedent', 'value:complaints:' || i, count(*), NULL FROM (SELECT unnest(antecedents) AS i FROM refined) GROUP BY 2""",
)
SHOWN = "array_to_string(antecedents, ' ∧ ') AS antecedents, consequent, support, confidence, lift"
register("k3_rules_by_target", lambda s, d: graph.rules_by_target(refined_rules(s, d), "status=OPEN"), f"{MINED} SELECT {SHOWN} FROM refined WHERE consequent = 'status=OPEN'")
register(
    "k4_rules_by_item",
    lambda s, d: graph.rules_by_item(refined_rules(s, d), "category=TRANSACTIONS"),
    f"{MINED} SELECT {SHOWN} FROM refined WHERE list_contains(antecedents, 'category=TRANSACTIONS')",
)


def versions(spark, d, rows=None):
    rows = cut(mining_rows(spark, d, "complaints"), "curated") if rows is None else rows  # once for both
    return refined_rules(spark, d, rows=side_rows(spark, d, "complaints", False, rows)), refined_rules(spark, d, rows=basketed(rows, "complaints"))


VERSIONS = f"""{sql.tables('complaints')}, {EARLY}, every AS (SELECT * FROM cur_complaints WHERE upper(category) = 'TRANSACTIONS'), {sql.item_rows('complaints', 'rows_complaints', 'io')}, {sql.itemsets('io', 'o')}, {sql.rules('complaints', 'o')},
{sql.item_rows('complaints', 'every', 'iw')}, {sql.itemsets('iw', 'w')}, {sql.rules('complaints', 'w')},
df AS (SELECT array_to_string(coalesce(a.antecedents, b.antecedents), ',') AS antecedents, coalesce(a.consequent, b.consequent) AS consequent,
  CASE WHEN a.consequent IS NULL THEN 'added' WHEN b.consequent IS NULL THEN 'removed' ELSE 'kept' END AS change, round(b.support - a.support, 6) AS support_delta,
  round(b.confidence - a.confidence, 6) AS confidence_delta, round(b.lift - a.lift, 6) AS lift_delta FROM orefined a FULL JOIN wrefined b ON a.antecedents = b.antecedents AND a.consequent = b.consequent)"""
register("g6_diff", lambda s, d: joined(graph.difference(*versions(s, d)), "antecedents"), f"{VERSIONS} SELECT * FROM df")
register(
    "g6_gate",
    lambda s, d: graph.gate(graph.difference(*versions(s, d))),
    f"""{VERSIONS}, c AS (SELECT count_if(change = 'kept') AS kept, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed FROM df),
j AS (SELECT *, CASE WHEN kept + added + removed = 0 THEN 1.0 ELSE round(kept / (kept + added + removed), 6) END AS jaccard FROM c)
SELECT *, jaccard >= 0.8 AND coalesce(removed / nullif(kept + removed, 0), 0) <= 0.2 AND coalesce(added / nullif(kept + removed, 0), 0) <= 0.5 AS passed FROM j""",
)

# text, evaluation, policy
register(
    "t1_sanitize",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", T.sanitized(F.col("p_name")).alias("name")),
    f"SELECT p_partkey, {sql.sanitized('p_name')} AS name FROM part",
)
register(
    "t2_pii_mask",
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.masked(F.col("text")).alias("text")),
    "SELECT conv_id, turn, " + "regexp_replace(regexp_replace(regexp_replace(text, '" + "', '[EMAIL_REDACTED]', 'g'), '".join(p for p, _ in T.MASKS[:1]) + "', '[EMAIL_REDACTED]', 'g'), '" + T.MASKS[1][0] + "', '[PHONE_REDACTED]', 'g'), '" + T.MASKS[2][0] + "', '[ACCOUNT_REDACTED]', 'g') AS text FROM conversations",
)
register("t3_nfkc", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.nfkc(F.col("text")).alias("text")), None)
register(
    "t4_intent",
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", T.intent(T.folded(F.col("text"))).alias("intent")),
    None,
)


def contexts(spark, d):
    """Runs made up from orders, for the evaluators."""
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey AS run_id", "o_orderstatus AS route", "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS expected_route",
        "array(o_orderstatus, 'end') AS trajectory", "array(CASE WHEN o_orderkey % 7 = 0 THEN 'Y' ELSE o_orderstatus END, 'end') AS expected_trajectory",
        "o_orderkey % 3 = 0 AS policy_allowed", "o_totalprice > 400000 AS budget_exceeded", "o_orderkey % 11 > 0 AS tenant_isolated",
        "CASE WHEN o_orderkey % 13 > 0 THEN true END AS guardrail_passed", "o_orderkey % 17 = 0 AS sensitive_content", "o_orderkey % 2 = 0 AS result_verified",
    )


CONTEXTS = """c AS (SELECT o_orderkey AS run_id, o_orderstatus AS route, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS expected_route, o_orderkey % 7 <> 0 AS same,
o_orderkey % 3 = 0 AS policy_allowed, o_totalprice > 400000 AS budget_exceeded, o_orderkey % 11 > 0 AS tenant_isolated, CASE WHEN o_orderkey % 13 > 0 THEN true END AS guardrail_passed,
o_orderkey % 17 = 0 AS sensitive_content, o_orderkey % 2 = 0 AS result_verified FROM orders)"""
register(
    "e1_evaluators",
    lambda s, d: evaluation.evaluated(contexts(s, d)).groupBy("metric", "reason").agg(F.count("*").alias("n"), F.sum("score").alias("score")),
    f"WITH {CONTEXTS}, r AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, coalesce({'same' if m == 'trajectory_in_order' else condition}, false) AS ok, '{reason}' AS why FROM c"
        for m, (condition, reason) in evaluation.BASE_METRICS.items()
    )
    + ") SELECT metric, CASE WHEN NOT ok THEN why END AS reason, count(*) AS n, sum(CASE WHEN ok THEN 1.0 ELSE 0 END) AS score FROM r GROUP BY 1, 2",
)


def ab_results(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 2").selectExpr(
        "l_orderkey AS scenario_id", "CASE l_linenumber WHEN 1 THEN 'baseline' ELSE 'controlled' END AS pipeline",
        "CASE WHEN l_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity", "l_quantity / 50 AS score", "l_quantity > 25 AS passed",
    )


AB = """r AS (SELECT l_orderkey AS scenario_id, CASE l_linenumber WHEN 1 THEN 'baseline' ELSE 'controlled' END AS pipeline, CASE WHEN l_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity,
l_quantity / 50 AS score, l_quantity > 25 AS passed FROM lineitem WHERE l_linenumber <= 2)"""
register(
    "a25_ab_summary",
    lambda s, d: evaluation.workflow_summary(ab_results(s, d)),
    f"WITH {AB} SELECT pipeline, round(avg(score), 3) AS avg_score, count_if(passed) AS pass_count, count_if(NOT passed) AS fail_count, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 3) AS pass_rate FROM r GROUP BY 1",
)
register(
    "j11_ab_pairs",
    lambda s, d: evaluation.paired_summary(ab_results(s, d), ["polarity"]),
    f"""WITH {AB}, p AS (SELECT polarity, scenario_id, max(CASE WHEN pipeline = 'controlled' THEN score END) - max(CASE WHEN pipeline = 'baseline' THEN score END) AS x FROM r GROUP BY 1, 2)
SELECT polarity, count_if(x > 0.001) AS b_higher, count_if(x < -0.001) AS a_higher, count_if(abs(x) <= 0.001) AS tied, round(avg(x), 3) AS avg_delta FROM p WHERE x IS NOT NULL GROUP BY 1""",
)
ROLE = "CASE o_orderkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'backoffice' WHEN 2 THEN 'client' ELSE 'guest' END"
ACTION = "CASE o_orderkey % 6 WHEN 0 THEN 'transaction.read' WHEN 1 THEN 'dispute.read' WHEN 2 THEN 'escalation.request' WHEN 3 THEN 'dispute.submit' WHEN 4 THEN 'other' END"
CAPABILITY = "CASE o_orderkey % 5 WHEN 0 THEN 'none' ELSE 'dispute.' || CASE o_orderkey % 6 WHEN 0 THEN 'transaction.read' WHEN 1 THEN 'read' ELSE 'escalation.request' END END"
register(
    "e3_policy",
    lambda s, d: evaluation.decided(s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{ROLE} AS role", f"{ACTION} AS action", f"{CAPABILITY} AS capability")).select("o_orderkey", "outcome", "reason"),
    f"""WITH q AS (SELECT o_orderkey, {ROLE} AS role, {ACTION} AS action, {CAPABILITY} AS capability FROM orders),
m(action, result, roles, needs) AS (VALUES ('transaction.read', 'ALLOW', ['client', 'customer', 'operator', 'backoffice'], 'dispute.transaction.read'),
  ('dispute.read', 'ALLOW', ['client', 'customer', 'operator', 'backoffice'], 'dispute.read'), ('escalation.request', 'REQUIRE_APPROVAL', ['client', 'customer'], 'dispute.escalation.request')),
x AS (SELECT q.*, m.result, list_contains(m.roles, role) AND capability = m.needs AS ok FROM q LEFT JOIN m USING (action))
SELECT o_orderkey, CASE WHEN action IS NULL THEN 'ALLOW' WHEN ok THEN result ELSE 'DENY' END AS outcome, CASE WHEN action IS NULL THEN 'informational_no_dispute_operation'
  WHEN action IN ('dispute.submit', 'dispute.cancel') THEN 'bank_dispute_action_not_supported' WHEN ok THEN action ELSE 'capability_or_role_denied' END AS reason FROM x""",
)
EVENT = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'deny' WHEN 'click' THEN 'request' ELSE 'note' END"
register(
    "e4_escalation",
    lambda s, d: evaluation.escalation_states(s.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS case_id", "event_id AS at", f"{EVENT} AS event")),
    f"""WITH e AS (SELECT user_id AS case_id, event_id AS seq, {EVENT} AS event FROM events), f AS (SELECT case_id, min(CASE WHEN event = 'request' THEN seq END) AS q FROM e GROUP BY 1),
s AS (SELECT e.case_id, arg_min(event, seq) AS d FROM e JOIN f USING (case_id) WHERE event IN ('approve', 'deny') AND seq > q GROUP BY 1)
SELECT f.case_id, CASE WHEN q IS NULL THEN 'open' WHEN d IS NULL THEN 'pending_approval' WHEN d = 'approve' THEN 'escalated' ELSE 'denied' END AS state FROM f LEFT JOIN s USING (case_id)""",
)
SIGNAL = "event_id, CASE WHEN event_id % 9 = 0 THEN 'out_of_domain' ELSE 'in_domain' END AS domain, event_type AS route_hint, value / 100 AS confidence"
register(
    "e5_gate",
    lambda s, d: evaluation.gated(s.read.parquet(f"{d}/events.parquet").selectExpr(*[x.strip() for x in SIGNAL.split(", ")])).groupBy("route").agg(F.count("*").alias("n")),
    f"""WITH g AS (SELECT {SIGNAL} FROM events) SELECT CASE WHEN domain = 'out_of_domain' AND confidence >= 0.85 THEN 'reject' WHEN confidence >= 0.85 THEN route_hint ELSE 'clarify' END AS route, count(*) AS n
FROM g GROUP BY 1""",
)
CHUNK = "l_orderkey AS query_id, l_linenumber * 1000000000 + l_partkey AS chunk_id, l_extendedprice AS score, CASE WHEN l_discount > 0.09 THEN 'other' ELSE 'own' END AS tenant, l_linestatus AS source"
register(
    "e6_retrieval",
    lambda s, d: evaluation.retrieved(s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS query_id", "l_linenumber * 1000000000L + l_partkey AS chunk_id", "l_extendedprice AS score", "CASE WHEN l_discount > 0.09 THEN 'other' ELSE 'own' END AS tenant", "l_linestatus AS source"), "own", "O", 3).select("query_id", "rank", F.round("score", 4).alias("score")),
    f"""WITH c AS (SELECT {CHUNK.replace('1000000000', '1000000000::BIGINT')} FROM lineitem), r AS (SELECT *, max(CASE WHEN tenant <> 'own' OR source <> 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS b,
row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM c) SELECT query_id, CAST(rn AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE b = 0 AND rn <= 3""",
)
