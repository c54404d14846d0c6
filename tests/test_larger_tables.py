"""What only larger tables showed, on small ones with smaller limits."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import ordinals
from tallyforge.plans import bank_queries as bank
from tallyforge.plans import closed_queries, inspection, service_queries
from tallyforge.sources.canonical import view


@pytest.mark.parametrize("customer", ["77", "nobody"])
def test_a_table_beyond_the_cap_is_read_by_owner(spark, sf_dir, monkeypatch, customer):
    key, given = "recent_transactions@1", {"date_from": "1990-01-01", "date_to": "2030-12-31"}
    want = bank.closed(spark, sf_dir, key, given, customer).collect()
    entry = bank.CATALOG[key]
    size = inspection.scan_bytes(view(spark, sf_dir, entry.table))
    monkeypatch.setitem(bank.CATALOG, key, replace(entry, max_bytes=size - 1))
    found = bank.closed(spark, sf_dir, key, given, customer)
    assert found.collect() == want and bool(want) == (customer == "77")
    assert inspection.scan_bytes(found) < size / 2


def test_an_owner_beyond_the_cap_is_refused(spark, sf_dir):
    entry = replace(bank.CATALOG["recent_transactions@1"], max_bytes=50)
    session, given = {"customer_id": "77"}, {"date_from": "1990-01-01", "date_to": "2030-12-31"}
    table = view(spark, sf_dir, entry.table).where("customer_id = '77'")
    with pytest.raises(closed_queries.Rejected) as refused:
        closed_queries.execute(spark, entry, closed_queries.of_owner(entry, table, session), given, session, "client")
    assert refused.value.rule == "bytes_over_budget"


def test_an_edge_digest_has_two_levels_whatever_the_size(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(ordinals, "FAN", 4)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nulls = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")))  # nulls come last, rising and falling
    for name, rows in (("whole", orders), ("nulls", nulls), ("few", orders.limit(3)), ("none", orders.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW e AS SELECT {service_queries.EDGE} FROM '{tmp_path}/{name}/orders.parquet/*.parquet'")
        want = con.execute(f"{service_queries._digest_sql('rising', 'ASC')} UNION ALL {service_queries._digest_sql('falling', 'DESC')}").fetchall()
        assert sorted(map(tuple, service_queries.edge_digest(spark, f"{tmp_path}/{name}").collect()), key=str) == sorted(want, key=str)


def test_lineage_is_checked_in_orders_that_spread(spark, sf_dir, monkeypatch):
    """No task of a rearranged table may hold what one value of a column with few has."""
    seen = []
    real = service_queries.artifacts.lineage_manifest
    monkeypatch.setattr(service_queries.artifacts, "lineage_manifest", lambda s, o, *more: seen.extend((s, o)) or real(s, o, *more))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert service_queries.lineage(spark, sf_dir).first()["repeatable"]
        for df in seen[2:]:
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
