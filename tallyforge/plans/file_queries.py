"""Registered queries that go through files, packages and streams, each beside the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.lineage import shared_folder
from tallyforge.operators import prepare, profile
from tallyforge.plans.catalogue import register
from tallyforge.sources import artifacts, files
from tallyforge.sources.canonical import TIEBREAKS, cte, view
from tallyforge.sources.contracts import CONTRACTS, schema_hash
from tallyforge.streaming import ingest


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV files, found under their folder, loaded with a malformed line too many left out."""
    root = folder(spark, "csv")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    rows.write.option("header", True).csv(f"{root}/orders")
    found = files.select_tables(files.discover_csv(spark, root), ["orders"])
    return files.read_csv(spark, found["orders"], schema=rows.schema)


register("s3_csv_load", csv_load, "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders by year and month; the folders' names come back as columns."""
    root = folder(spark, "partitioned")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    files.replace_table(rows, f"{root}/orders", ["year", "month"])
    return spark.read.parquet(f"{root}/orders").groupBy("year", "month").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


register("s4_partitioned", partitioned, "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1, 2")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row for each prepared table, appended one by one."""
    path = folder(spark, "audit")
    for name in ("complaints", "satisfaction_surveys"):
        source, contract = view(spark, sf_dir, name), CONTRACTS[name]
        out = prepare.staged(source, contract, TIEBREAKS.get(name, ()))
        row = {"run_id": "r1", "contract_version": "1", "table": name, "source_rows": source.count(), "curated_rows": out.count(), "schema_hash": schema_hash(out), "manifest": "-"}
        files.append_audit(spark, path, row)
    return spark.read.parquet(path).select("run_id", "table", "source_rows", "curated_rows")


register(
    "s10_audit",
    audit,
    f"""WITH {cte('complaints', 'satisfaction_surveys')} SELECT 'r1' AS run_id, 'complaints' AS "table", count(*) AS source_rows, count(DISTINCT complaint_id) AS curated_rows FROM complaints
UNION ALL SELECT 'r1', 'satisfaction_surveys', count(*), count(DISTINCT survey_id) FROM satisfaction_surveys""",
)


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in overlapping batches, one of them twice; null keys count as a key."""
    path = folder(spark, "append")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 1000).alias("key"))
    for low, high in ((0, 500), (250, 800), (250, 800)):
        files.append_new(rows.where(f"key IS NULL OR key BETWEEN {low} AND {high}"), path, ["key"])
    return spark.read.parquet(path)


register("s11_append", appended, "SELECT DISTINCT CASE WHEN event_id % 5 <> 0 THEN event_id % 1000 END AS key FROM events WHERE event_id % 5 = 0 OR event_id % 1000 <= 800")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a package: the pointer moves to the second, back, and the reader gets the first, checked."""
    root = folder(spark, "packages")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    for run_id, rows in (("v1", nations), ("v2", nations.where("n_nationkey > 3"))):
        artifacts.write_package({"nodes": rows}, root, run_id, {"source": "nation"})
        artifacts.promote(spark, root, run_id, artifacts.pointer(spark, root)["current"])
    artifacts.rollback(spark, root)
    return artifacts.current(spark, root)["nodes"]


register("s15_publish", published, "SELECT n_nationkey, n_name FROM nation")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON files, taken in by two runs of a stream from one checkpoint; the second finds what came later."""
    root = folder(spark, "stream")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    for part in (0, 1):
        new = rows.where(F.col("event_id") % 2 == part)
        new.unionAll(new.where(F.col("event_id") % 10 == part)).write.mode("append").json(f"{root}/in")
        read = ingest.read_increment(spark, f"{root}/in", "event_id long, ts string, user_id long, event_type string, value double", "ts", ["event_id"], "3650 days")
        ingest.ingest(read, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


register("st_stream_ingest", streamed, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")

register(
    "a7_key_profile",
    lambda s, d: profile.key_profile(view(s, d, "transactions"), "transaction_id"),
    f"WITH {cte('transactions')} SELECT count(*) AS row_count, count_if(transaction_id IS NULL) AS null_keys, count(transaction_id) - count(DISTINCT transaction_id) AS duplicate_keys FROM transactions",
)
COMPLAINT_FIELDS = CONTRACTS["complaints"].fields
register(
    "a9_quality",
    lambda s, d: profile.quality_profile(view(s, d, "complaints"), CONTRACTS["complaints"]),
    f"WITH {cte('complaints')}, q AS (SELECT count(*) AS row_count, count(*) - count(DISTINCT complaint_id) AS duplicates FROM complaints) "
    + " UNION ALL ".join(
        f"SELECT '{f.name}' AS field, {str(f.required).lower()} AS required, (SELECT count_if({f.name} IS NULL) FROM complaints) AS null_count, row_count, duplicates FROM q" for f in COMPLAINT_FIELDS
    ),
)
