"""The four contracted bank tables as views over the TPC-H-like test tables.

The same SQL text serves Spark, with DataFrames in place of {name}, and the comparison engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "transactions": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS transaction_id,
  CAST(o_custkey AS STRING) AS customer_id, l_shipdate AS transaction_date,
  p_type AS transaction_type, l_linestatus AS transaction_category,
  c_mktsegment AS channel, p_brand AS merchant_category, l_returnflag AS transaction_status,
  CAST(l_linenumber AS BIGINT) AS response_code, l_discount >= 0.09 AS is_fraud,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_discount * 100 END AS fraud_score,
  CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS amount,
  CASE c_nationkey % 3 WHEN 0 THEN 'PEN' WHEN 1 THEN 'MXN' ELSE 'COP' END AS currency,
  l_quantity AS tiebreak_1, l_partkey AS tiebreak_2, l_suppkey AS tiebreak_3
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {part} ON l_partkey = p_partkey""",
    "complaints": """
SELECT CAST(o_orderkey AS STRING) AS complaint_id, CAST(o_custkey AS STRING) AS customer_id,
  o_orderdate AS creation_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'Complaint' WHEN 1 THEN 'Claim' WHEN 2 THEN 'Request' ELSE 'Suggestion' END AS case_type,
  CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'O' THEN 'Open' ELSE 'In Process' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN o_orderkey % 3 < 2 THEN 'Transactions' ELSE 'Service' END AS category,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Cargo ' || CAST(o_custkey % 4 AS STRING) END AS subcategory,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS reception_channel,
  CASE c_nationkey % 3 WHEN 0 THEN 'PEN' WHEN 1 THEN 'MXN' ELSE 'COP' END AS currency,
  o_totalprice > 400000 AS sla_breached, o_custkey % 6 = 0 AS is_repeat_complainer,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS claimed_amount,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 31 AS DOUBLE) ELSE NULL END AS resolution_days
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "call_center_interactions": """
SELECT CAST(event_id AS STRING) AS interaction_id, CAST(user_id AS STRING) AS customer_id, ts AS interaction_date,
  CASE WHEN event_id % 2 = 0 THEN 'Transaccional' ELSE 'General' END AS reason_category,
  event_type AS interaction_type,
  CASE user_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'chat' ELSE NULL END AS channel,
  event_type = 'error' AS requires_followup, value > 90 AS was_escalated
FROM {events}""",
    "satisfaction_surveys": """
SELECT 'S' || CAST(event_id AS STRING) AS survey_id, CAST(event_id AS STRING) AS interaction_id,
  ts AS survey_date, CAST(1 + event_id % 7 AS BIGINT) AS main_score
FROM {events} WHERE event_id % 3 = 0""",
    "products": """
SELECT CAST(o_orderkey AS STRING) AS product_id, CAST(o_custkey AS STRING) AS customer_id,
  o_orderpriority AS product_type, 'PEN' AS currency, o_totalprice AS current_balance,
  o_orderstatus AS product_status, CAST(o_orderdate AS DATE) AS opening_date
FROM {orders}""",
}

#: Columns that decide between rows of one key and one freshness.
TIEBREAKS = {"transactions": ("tiebreak_1", "tiebreak_2", "tiebreak_3", "amount", "transaction_type")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = re.findall(r"\{(\w+)\}", VIEWS[name])
    return spark.sql(VIEWS[name], **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def cte(*names: str) -> str:
    """The views as common table expressions for the comparison engine."""
    return ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', lambda m: m[1], VIEWS[n])})" for n in names)
