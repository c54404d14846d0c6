"""Registered queries of what services ask of the engine: pruned closed queries, publication, a sink, streams with state, orders and digests."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import digests, ordinals, surfaces
from tallyforge.functions.lineage import cut
from tallyforge.functions.text import MASKS
from tallyforge.operators import evaluation, graph, mining, prepare, profile, report, rules, sketches
from tallyforge.plans import bank_queries as bank
from tallyforge.plans import closed_queries, inspection
from tallyforge.plans import comparison as sql
from tallyforge.plans.catalogue import register
from tallyforge.plans.file_queries import folder
from tallyforge.sources import artifacts, coordination, files, sink, unions
from tallyforge.sources.canonical import cte, view
from tallyforge.sources.contracts import CONTRACTS
from tallyforge.streaming import stateful


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in folders by status, and a closed query whose cap only the scan of its own folder meets; without the filter it is refused."""
    root = folder(spark, "products")
    view(spark, sf_dir, "products").write.partitionBy("product_status").parquet(root)
    table = spark.read.parquet(root)
    cap = inspection.scan_bytes(table) - 1
    owner = table.where("product_status = 'F'").agg(F.min("customer_id")).first()[0]
    columns = (closed_queries.Column("product_id", "string"), closed_queries.Column("current_balance", "double", "financial"))
    sql = "SELECT product_id, current_balance FROM {products} WHERE customer_id = :customer_id%s ORDER BY product_id LIMIT 50"
    make = lambda more: closed_queries.Entry("settled_products", "1", "products", sql % more, (closed_queries.OWNER,), columns, max_bytes=cap)
    run = lambda entry: closed_queries.execute(spark, entry, table, {}, {"customer_id": owner}, "client")
    try:
        run(make(""))
    except closed_queries.Rejected as refused:
        rule = refused.rule
    else:
        rule = None
    return run(make(" AND product_status = 'F'")).withColumn("without_filter", F.lit(rule))


register(
    "q8_pruned_scan",
    pruned_scan,
    f"""WITH {cte('products')} SELECT product_id, current_balance, 'bytes_over_budget' AS without_filter FROM products
WHERE product_status = 'F' AND customer_id = (SELECT min(customer_id) FROM products WHERE product_status = 'F') ORDER BY product_id LIMIT 50""",
)


def contended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four publishers of one table with one expectation; the package that won as its readers see it, and how many won."""
    root = folder(spark, "contended")
    regions = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    names = [f"v{i}" for i in range(4)]
    for name in names:
        artifacts.write_package({"nodes": regions}, root, name)

    def publish(name: str) -> bool:
        try:
            return artifacts.promote(spark, root, name, None)["current"] == name
        except artifacts.Invalid:
            return False

    with ThreadPoolExecutor(len(names)) as pool:
        won = sum(pool.map(publish, names))
    lease = coordination.acquire(spark, f"{root}/lease", "later", 600)
    artifacts.promote(spark, root, names[0], artifacts.pointer(spark, root)["current"], lease)
    lease.release()
    return artifacts.current(spark, root)["nodes"].withColumn("winners", F.lit(won))


register("s16_contended", contended, "SELECT s_nationkey, count(*) AS suppliers, 1 AS winners FROM supplier GROUP BY 1")
RESULTS = """SELECT 'run-0000' || CAST(o_custkey % 40 AS STRING) AS run_id, CAST(o_orderkey AS STRING) AS fixture_id, lower(o_orderpriority) AS route, 'amount' AS metric, 'base' AS evaluator,
CAST(o_totalprice / 1000000 AS DOUBLE) AS score, o_totalprice > 100000 AS passed, 'deterministic' AS mode, 'informational' AS gate FROM"""


def sunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in overlapping batches, one of them half as a failed writer leaves it and one with an invalid row."""
    root = folder(spark, "results")
    rows = spark.sql(f"{RESULTS} {{o}}", o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    part = F.pmod(F.xxhash64("fixture_id"), F.lit(4))
    for batch in (rows.where(part < 2), rows.where(part == 1), rows.where(part > 0).withColumn("gate", F.lit("blocking")), rows, rows.unionAll(rows)):
        sink.write_once(batch, root)
    return spark.read.parquet(root).groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("insert_id").alias("ids"), F.round(F.sum("score"), 6).alias("score"))


register("s11_sink", sunk, f"SELECT run_id, count(*) AS n, count(DISTINCT fixture_id) AS ids, round(sum(score), 6) AS score FROM ({RESULTS} orders) GROUP BY 1")


def _two_runs(spark: SparkSession, rows: DataFrame, part: Column, made, key: str) -> DataFrame:
    """The stream over one half of the rows, stopped, and started again from its checkpoint once the other half has come."""
    root = folder(spark, "stateful")
    for i in (0, 1):
        rows.where(part == i).write.mode("append").parquet(f"{root}/in")
        stateful.run(made(spark.readStream.schema(rows.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint")
    return stateful.current(spark, f"{root}/out", key)


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of each conversation, kept by a stream that is stopped and goes on."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id AS thread", "turn", "role", "text")
    found = _two_runs(spark, turns, F.col("turn") % 2, lambda s: stateful.bounded_history(s, keep=5), "thread")
    return found.select(F.col("thread").alias("conv_id"), "turn", "role", F.length("text").alias("n_chars"))


register(
    "st_bounded_history",
    history_stream,
    "SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5",
)
CASE_EVENT = "CASE event_id % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'approve' WHEN 2 THEN 'deny' ELSE 'note' END"


def escalation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of escalations from events that come in any order within ten years."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS case_id", "CAST(ts AS TIMESTAMP) AS time", "event_id AS seq", f"{CASE_EVENT} AS event")
    found = _two_runs(spark, events, F.pmod(F.xxhash64("seq"), F.lit(2)), lambda s: stateful.escalations(s, "3650 days"), "case_id")
    return found.select("case_id", "state")


register(
    "st_escalations",
    escalation_stream,
    f"""WITH e AS (SELECT user_id AS case_id, ts, event_id AS seq, {CASE_EVENT} AS event FROM events), q AS (SELECT case_id, min((ts, seq)) FILTER (WHERE event = 'request') AS first FROM e GROUP BY 1),
d AS (SELECT e.case_id, arg_min(event, (ts, seq)) AS decision FROM e JOIN q USING (case_id) WHERE event IN ('approve', 'deny') AND (ts, seq) > first GROUP BY 1)
SELECT q.case_id, CASE WHEN first IS NULL THEN 'open' WHEN decision IS NULL THEN 'pending_approval' WHEN decision = 'approve' THEN 'escalated' ELSE 'denied' END AS state FROM q LEFT JOIN d USING (case_id)""",
)

# order, digests and surfaces
register(
    "l7_rule_ordinals",
    lambda s, d: ordinals.with_ordinals(
        bank.joined(bank.refined_rules(s, d), "antecedents"),
        [(F.col("lift"), False), (F.col("confidence"), False), (F.col("support"), False), (F.col("antecedents"), True), (F.col("consequent"), True)],
    ).select("ordinal", "antecedents", "consequent", "lift"),
    f"""{bank.MINED}, r AS (SELECT array_to_string(antecedents, ',') AS antecedents, consequent, support, confidence, lift FROM refined)
SELECT row_number() OVER (ORDER BY lift DESC, confidence DESC, support DESC, antecedents, consequent) - 1 AS ordinal, antecedents, consequent, lift FROM r""",
)
EDGE = "o_custkey AS source, o_orderkey AS target, o_orderpriority AS relation"
EDGE_ORDER = ("source", "target", "relation")


def edge_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of an edge table in its canonical order, by source, target and relation, and that of the same table the other way round."""
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*EDGE.split(", "))
    text = F.concat_ws("|", "source", "target", "relation")
    order = lambda up: [x for c in EDGE_ORDER for x in ((F.col(c).isNull(), True), (F.col(c), up))]  # nulls come last both ways
    found = [(name, ordinals.ordered_digest(edges, order(up), text, levels=1) or None) for name, up in (("rising", True), ("falling", False))]
    return spark.createDataFrame(found, "direction string, sha256 string")


def _digest_sql(name: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in EDGE_ORDER)
    return f"""SELECT '{name}' AS direction, sha256(string_agg(d, '' ORDER BY b)) AS sha256 FROM (SELECT n // {ordinals.FAN} AS b, sha256(string_agg(d, '' ORDER BY n)) AS d FROM
(SELECT row_number() OVER (ORDER BY {order}) - 1 AS n, sha256(concat_ws('|', source, target, relation)) AS d FROM e) GROUP BY 1)"""


register("l8_edge_digest", edge_digest, f"WITH e AS (SELECT {EDGE} FROM orders) {_digest_sql('rising', 'ASC')} UNION ALL {_digest_sql('falling', 'DESC')}")
#: A key for comparison only; a service's own comes from its secrets.
KEY = b"comparison key of the test tables"
PADDED = [bytes(x ^ pad for x in KEY.ljust(digests.BLOCK, b"\0")).hex() for pad in (0x36, 0x5C)]
register(
    "h1_keyed_digests",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", digests.keyed_digest(KEY, "c_name", "c_custkey").alias("digest")),
    f"""WITH m AS (SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}' AS j FROM customer)
SELECT c_custkey, translate(rtrim(to_base64(unhex(sha256(unhex('{PADDED[1]}') || unhex(sha256(unhex('{PADDED[0]}') || encode(j)))))), '='), '+/', '-_') AS digest FROM m""",
)


def numbered_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose surfaces were numbered: how many of each class, and whether the table of replacements gives back the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", surfaces.numbered(F.col("text"), "input").alias("m"))
    n = lambda kind: F.size(F.filter("m.replacements", lambda r: r["classification"] == kind)).alias(kind)
    return docs.select("doc_id", n("personal"), n("financial"), surfaces.restored(F.col("m")).eqNullSafe(F.col("text")).alias("restored"))


EMAIL, PHONE, ACCOUNT = (p.replace("(?i)", "") for p, _ in MASKS)
register(
    "t2_numbered_surfaces",
    numbered_surfaces,
    f"""WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}', 0, 'i')) AS e, regexp_replace(text, '{EMAIL}', '[[X]]', 'gi') AS t FROM documents),
b AS (SELECT doc_id, e + len(regexp_extract_all(t, '{PHONE}')) AS personal, regexp_replace(t, '{PHONE}', '[[X]]', 'g') AS t FROM a)
SELECT doc_id, CAST(personal AS INTEGER) AS personal, CAST(len(regexp_extract_all(t, '{ACCOUNT}')) AS INTEGER) AS financial, true AS restored FROM b""",
)

# sketches and unions
MONTHS = 3


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the medians and ninetieth percentiles of three months, merged from sketches of one, keep to the error that is stated."""
    rows = view(spark, sf_dir, "complaints").select("creation_date", "claimed_amount")
    merged = sketches.over_windows(cut(sketches.monthly(rows, "creation_date", "claimed_amount"), "monthly-sketches"), MONTHS)
    wanted = {"p50": 0.5, "p90": 0.9}
    found = cut(merged.select("month", *[sketches.quantile(F.col("sketch"), p).alias(c) for c, p in wanted.items()]), "sketched")
    off = sketches.rank_error(rows, "creation_date", "claimed_amount", found, MONTHS, wanted)
    return off.select("month", "n", *[(F.col(c) <= sketches.RANK_ERROR).alias(c) for c in wanted])


register(
    "a5_sketched_windows",
    sketched,
    f"""WITH {cte('complaints')}, m AS (SELECT CAST(date_trunc('month', creation_date) AS DATE) AS own FROM complaints WHERE claimed_amount IS NOT NULL AND creation_date IS NOT NULL),
w AS (SELECT CAST(own + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM m, range({MONTHS}) r(k)) SELECT month, count(*) AS n, true AS p50, true AS p90 FROM w WHERE month IN (SELECT own FROM m) GROUP BY 1""",
)


def relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, lines and events as one table of amounts: numbers and times of different types, columns that a block lacks."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)
    blocks = [
        read("orders", "CAST(o_orderkey AS INT) AS id", "CAST(o_totalprice AS DECIMAL(12, 2)) AS amount", "CAST(o_orderdate AS DATE) AS day", "o_orderstatus AS status"),
        read("lineitem", "CAST(l_orderkey AS BIGINT) AS id", "CAST(l_quantity AS INT) AS amount", "CAST(l_shipdate AS TIMESTAMP_NTZ) AS day", "l_returnflag AS flag"),
        read("events", "CAST(event_id % 100 AS TINYINT) AS id", "NULL AS amount", "ts AS day", "event_type AS status"),
    ]
    whole = unions.relaxed_union(*blocks)
    return whole.groupBy("status", "flag").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("amount").cast("double").alias("amount"), F.max("day").alias("last"))


register(
    "u1_relaxed_union",
    relaxed,
    """WITH u AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS flag FROM orders
UNION ALL SELECT l_orderkey, CAST(l_quantity AS INTEGER), l_shipdate, NULL, l_returnflag FROM lineitem UNION ALL SELECT event_id % 100, NULL, ts, event_type, NULL FROM events)
SELECT status, flag, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(amount) AS DOUBLE) AS amount, max(day) AS last FROM u GROUP BY 1, 2""",
)

# packages and hierarchies
VERSION = {"v1": "s_suppkey % 7 <> 0", "v2": "s_suppkey % 7 <> 1"}


def package_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two versions of a package do not share, read from the buckets that differ."""
    root = folder(spark, "versions")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "CAST(s_acctbal AS DOUBLE) AS balance")
    moved = F.when(F.col("id") % 11 != 0, F.col("nation")).otherwise(F.col("nation") + 1)
    for name, where in VERSION.items():
        own = rows.where(where.replace("s_suppkey", "id"))
        artifacts.write_package({"nodes": own.withColumn("nation", moved) if name == "v2" else own}, root, name, keys={"nodes": ["id"]})
    found = artifacts.package_diff(spark, root, "v1", "v2", "nodes")
    return found.select("id", "change", F.get_json_object("old", "$.nation").cast("int").alias("old"), F.get_json_object("new", "$.nation").cast("int").alias("new"))


register(
    "g9_package_diff",
    package_changes,
    f"""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier WHERE {VERSION['v1']}),
b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey ELSE s_nationkey + 1 END AS nation FROM supplier WHERE {VERSION['v2']})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.nation AS old, b.nation AS new
FROM a FULL JOIN b ON a.id = b.id WHERE a.nation IS DISTINCT FROM b.nation""",
)
LEVELS = (("case_type", "priority"), ("case_type", "subcategory"), ("priority", "subcategory"))


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without those that a more general one stands for, under a hierarchy of three levels."""
    return bank.joined(rules.without_generalized(bank.raw_rules(spark, sf_dir), LEVELS), "antecedents")


register("m12_three_levels", leveled, None)


def maximal_sets(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """Maximal sets by the search, or how they overlap with what Apriori lists."""
    rows = bank.baskets(spark, sf_dir, "complaints")
    found = cut(mining.maximal_search(rows, sql.SUPPORT, sql.LONGEST), "maximal-sets")
    if what == "sets":
        return bank.joined(found, "items")
    return mining.maximal_overlap(found, mining.apriori(rows, sql.SUPPORT, sql.LONGEST))


LISTED = f"{bank.MINED}, mx AS (SELECT a.items, a.n FROM sets a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(list_transform(items, lambda x: list_filter(items, lambda y: y <> x))) AS part FROM sets WHERE k > 1) p WHERE p.part = a.items))"
register("m9_maximal_search", lambda s, d: maximal_sets(s, d, "sets"), f"{LISTED} SELECT array_to_string(items, ',') AS items, n FROM mx")
register("m9_overlap", lambda s, d: maximal_sets(s, d, "overlap"), f"{LISTED} SELECT count(*) AS maximal, count(*) AS overlap, count(*) AS equal_counts FROM mx")

# report, suite, strict twin and checks
STATS = {"min": 0.0, "p50": 0.5, "p90": 0.9, "max": 1.0}


def _measures_sql(measures: tuple[str, ...]) -> str:
    parts = ["SELECT 'rule_count' AS measure, CAST(count(*) AS DOUBLE) AS value"]
    for m in measures:
        parts += [f"SELECT '{m}_{s}', round(round(quantile_cont({m}, {p}), 9), 6)" for s, p in STATS.items()] + [f"SELECT '{m}_mean', round(round(avg({m}), 9), 6)"]
    return "|".join(parts)


def _section_sql(section: str, name: str, group: str, measures: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, {x.removeprefix('SELECT ')} FROM en{group}" for x in _measures_sql(measures).split("|"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the complaints' rules and graph."""
    rows = bank.baskets(spark, sf_dir, "complaints")
    found = bank.refined_rules(spark, sf_dir, rows=rows)
    nodes, edges = bank.catalog_graph(spark, sf_dir, rows)
    return report.association(found).unionAll(report.graph_section(nodes, edges))


register(
    "g7_report",
    report_rows,
    f"""{bank.MINED}, en AS (SELECT antecedents, consequent, support, confidence, lift, CASE WHEN confidence < 1 - 1e-12 THEN round((1 - confidence / lift) / (1 - confidence), 6) END AS conviction,
round(support * (1 - 1 / lift), 6) AS leverage FROM refined), g AS (SELECT DISTINCT item, split_part(item, '=', 1) AS f FROM it)
{_section_sql('association', "'all'", '', ('support', 'confidence', 'lift', 'conviction', 'leverage'))}
UNION ALL {_section_sql('consequent', 'consequent', ' GROUP BY consequent', ('lift', 'confidence', 'support'))}
UNION ALL SELECT 'antecedent_length', CAST(len(antecedents) AS VARCHAR), 'rules', count(*) FROM en GROUP BY 2
UNION ALL SELECT 'feature', split_part(item, '=', 1), 'rules', count(*) FROM (SELECT unnest(antecedents) AS item FROM en) GROUP BY 2
UNION ALL SELECT 'nodes', kind, 'count', count(*) FROM (SELECT 'population' AS kind UNION ALL SELECT 'feature' FROM (SELECT DISTINCT f FROM g WHERE f <> 'status') UNION ALL SELECT CASE f WHEN 'status' THEN 'target' ELSE 'feature_value' END FROM g) GROUP BY 2
UNION ALL SELECT 'edges', relation, 'count', count(*) FROM (SELECT CASE f WHEN 'status' THEN 'has_target' ELSE 'has_value' END AS relation FROM g UNION ALL SELECT 'has_feature' FROM (SELECT DISTINCT f FROM g WHERE f <> 'status')) GROUP BY 2""",
)
#: A case's manifest, made of what its source holds.
MANIFEST = """SELECT 'C' || CAST(n % 5 + 1 AS STRING) AS case_id, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS total FROM {source} GROUP BY 1"""
CONTENT = """'{"case":"' || case_id || '","publication":"not_requested","row_count":' || row_count || ',"run_id":"r' || total || '","schema_version":"v1"}'"""


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS n")
    made = spark.sql(MANIFEST, source=orders).selectExpr("case_id", f"{CONTENT} AS content")
    return report.consolidated(made)


register(
    "n8_suite",
    suite,
    f"""WITH m AS ({MANIFEST.replace('{source}', '(SELECT o_orderkey AS n FROM orders)')}) SELECT case_id, 'consolidated' AS status, sha256({CONTENT}) AS sha256, 'r' || total AS run_id, 'v1' AS schema_version, NULL AS reason FROM m
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{c}', 'blocked', NULL, NULL, NULL, '{r}')" for c, r in report.BLOCKED.items())})""",
)
STRICT = "CAST(user_id AS STRING) AS interaction_id, CAST(event_id AS STRING) AS customer_id, date_trunc('day', ts) AS interaction_date, 'General' AS reason_category, event_type AS interaction_type, 'chat' AS channel, value > 50 AS requires_followup, value > 90 AS was_escalated, event_id AS source_row"


def strict_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one key and day, of which the strict preparation takes the last in source order."""
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in re.split(r", (?=[^()]*(?:\(|$))", STRICT)])
    return prepare.strictly_staged(calls, CONTRACTS["call_center_interactions"], "source_row").select("interaction_id", "customer_id", "interaction_type", "was_escalated")


register(
    "i6_strict_twin",
    strict_twin,
    f"""SELECT interaction_id, customer_id, interaction_type, was_escalated FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY interaction_date DESC, source_row DESC) AS rn
FROM (SELECT {STRICT.replace('STRING', 'VARCHAR')} FROM events)) WHERE rn = 1""",
)
RANGES = ((1, 7), (1, 5), (3, 6))


def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys with a score outside of each range; the contracted range, 1 to 7, has to hold for all."""
    rows = view(spark, sf_dir, "satisfaction_surveys")
    profile.require_range(rows, "main_score", *RANGES[0])
    found = [profile.outside(rows, "main_score", *r).agg(F.count("*").alias("n")).select(F.lit(r[0]).alias("least"), F.lit(r[1]).alias("most"), "n") for r in RANGES]
    return reduce(DataFrame.unionAll, found)


register(
    "f17_score_range",
    score_ranges,
    f"WITH {cte('satisfaction_surveys')} "
    + " UNION ALL ".join(f"SELECT {a} AS least, {b} AS most, count_if(main_score IS NULL OR main_score NOT BETWEEN {a} AND {b}) AS n FROM satisfaction_surveys" for a, b in RANGES),
)
register(
    "f7_is_false",
    lambda s, d: view(s, d, "complaints").withColumn("late", F.expr("CASE WHEN claimed_amount IS NOT NULL THEN sla_breached END")).groupBy("priority").agg(
        F.count_if(F.expr("late IS FALSE")).alias("is_false"), F.count_if(F.expr("late IS NOT FALSE")).alias("is_not_false"), F.count_if(F.expr("NOT late")).alias("not_late")
    ),
    f"""WITH {cte('complaints')}, c AS (SELECT priority, CASE WHEN claimed_amount IS NOT NULL THEN sla_breached END AS late FROM complaints)
SELECT priority, count_if(late IS FALSE) AS is_false, count_if(late IS NOT FALSE) AS is_not_false, count_if(NOT late) AS not_late FROM c GROUP BY 1""",
)

# graphs of the tables' own rows
TRADE = """SELECT DISTINCT c_nationkey AS source, s_nationkey AS target FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey"""
RISING = {"all": "true", "rising": "source < target", "rising but one": "source < target OR (source = 24 AND target = 0)"}


def trade_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trade between nations has a cycle: among all pairs, only from smaller to larger keys, and with one edge back."""
    names = re.findall(r"\{(\w+)\}", TRADE)
    edges = cut(spark.sql(TRADE, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}), "trade")
    return spark.createDataFrame([(k, graph.is_acyclic(edges.where(c))) for k, c in RISING.items()], "kind string, acyclic boolean")


_CLOSED = ", ".join(
    f"r{i}(a, b) AS (SELECT source, target FROM t WHERE {c} UNION SELECT r{i}.a, t.target FROM r{i} JOIN t ON r{i}.b = t.source WHERE {c})" for i, c in enumerate(RISING.values())
)
register(
    "g3_trade_cycles",
    trade_cycles,
    f"WITH RECURSIVE t AS ({re.sub(r'[{](\w+)[}]', r'\1', TRADE)}), {_CLOSED} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count_if(a = b) = 0 AS acyclic FROM r{i}" for i, k in enumerate(RISING)),
)
RUNS = "SELECT CASE n_regionkey % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'C3' ELSE 'C5' END AS case_id, n_name AS run_id, sha2(n_comment, 256) AS sha256 FROM {nation}"


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the runs that the tables hold for them; a run of a blocked case, or with another digest than its manifest's, is refused."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_regionkey", "n_name", "concat(n_name, '-', n_nationkey) AS n_comment")
    runs = spark.sql(RUNS, nation=nation).withColumn("manifest_sha256", F.col("sha256"))
    nodes, edges = bank.catalog_graph(spark, sf_dir)
    refused = 0
    for bad in (runs.withColumn("manifest_sha256", F.sha2("run_id", 256)), runs.withColumn("case_id", F.lit("C6"))):
        try:
            graph.with_cases(nodes, edges, bad)
        except ValueError:
            refused += 1
    made = [cut(x, "cases") for x in graph.with_cases(nodes, edges, runs)]
    found = reduce(DataFrame.unionAll, [graph.case_summary(*made, c) for c in ("C1", "C2", "C3", "C5", "C8")])
    return found.withColumn("refused", F.lit(refused))


register(
    "k1_run_summaries",
    run_summaries,
    f"""WITH n AS (SELECT n_regionkey, n_name, n_name || '-' || n_nationkey AS n_comment FROM nation), r AS ({RUNS.replace('{nation}', 'n').replace('sha2(n_comment, 256)', 'sha256(n_comment)')}),
c(case_id, predicts, status) AS (VALUES ('C1', 'sla_breached', 'exploratory_not_promoted'), ('C2', 'resolution_days', 'exploratory_not_promoted'), ('C3', 'is_fraud', 'exploratory_not_promoted'), ('C5', 'main_score', 'exploratory_not_promoted'), ('C8', NULL, 'blocked'))
SELECT 'case:' || c.case_id AS id, predicts, status, 'model_run:' || c.case_id || ':' || run_id AS run, sha256, 2 AS refused FROM c LEFT JOIN r ON c.case_id = r.case_id""",
)

# files and manifests
def copied_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file copied twice: the second time it is there already. The rows are the copy's."""
    root = folder(spark, "copies")
    said = [files.copy_once(spark, f"{sf_dir}/nation.parquet", f"{root}/nation.parquet") for _ in range(2)]
    return spark.read.parquet(f"{root}/nation.parquet").select("n_nationkey", "n_name", F.lit(said[0]).alias("first"), F.lit(said[1]).alias("second"))


register("s5_copied_once", copied_once, "SELECT n_nationkey, n_name, 'copied' AS first, 'present' AS second FROM nation")


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of evaluation results written as JSON lines and a summary; both read back."""
    root = folder(spark, "report")
    summary = artifacts.write_report(evaluation.evaluated(bank.contexts(spark, sf_dir)), root)
    lines = spark.read.schema("run_id long, metric string, passed boolean, score double, reason string").json(f"{root}/results")
    totals = lines.groupBy("metric").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))
    return totals.withColumns({f"all_{k}": F.lit(v).cast("long") for k, v in summary.items()})


_RESULTS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, coalesce({'same' if m == 'trajectory_in_order' else condition}, false) AS ok FROM c" for m, (condition, _) in evaluation.BASE_METRICS.items()
)
register(
    "s12_written_report",
    written_report,
    f"""WITH {bank.CONTEXTS}, r AS ({_RESULTS}), t AS (SELECT count(*) AS all_results, count_if(ok) AS all_passed, count_if(NOT ok) AS all_failed FROM r)
SELECT metric, count(*) AS n, count_if(ok) AS passed, any_value(all_results) AS all_results, any_value(all_passed) AS all_passed, any_value(all_failed) AS all_failed FROM r, t GROUP BY 1""",
)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preparation of complaints read and made, and that the same rows in another order have the same digests."""
    source, contract = view(spark, sf_dir, "complaints"), CONTRACTS["complaints"]
    out = cut(bank.staged(spark, sf_dir, "complaints"), "staged")  # read by each checksum and watermark
    first, again = (artifacts.lineage_manifest(s, o, contract.freshness, ["latest"]) for s, o in ((source, out), (source.orderBy("priority", "complaint_id"), out.repartition("customer_id"))))
    row = (first["source"]["rows"], first["output"]["rows"], first["freshness_watermark"][:10], first == again)
    return spark.createDataFrame([row], "source_rows long, output_rows long, watermark string, repeatable boolean")


register(
    "i9_lineage",
    lineage,
    f"WITH {cte('complaints')} SELECT count(*) AS source_rows, count(DISTINCT complaint_id) AS output_rows, strftime(max(creation_date), '%Y-%m-%d') AS watermark, true AS repeatable FROM complaints",
)
