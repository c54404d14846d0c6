"""Baskets with weights stand for the rows, and a query prepares its rows once."""

from pyspark.sql import functions as F

from tallyforge.operators import items, mining
from tallyforge.plans import bank_queries as bank
from tallyforge.plans import comparison as sql
from tallyforge.plans import release_queries


def test_weighted_baskets_are_the_collapsed_rows(spark):
    p = items.Population("p", "k", "at", "t", ("c", "many"), ("b",), ("x", "y"))
    rows = spark.range(900).select(
        "id", F.col("id").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("T"), F.col("id") % 2).alias("t"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("c "), F.col("id") % 3)).alias("c"),
        F.col("id").cast("string").alias("many"), F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 4 > 0, F.col("id") % 11 - 5).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
    )
    found = items.weighted(rows, p, 30)
    want = items.collapsed(items.baskets(rows, p, 30))
    plain = lambda df: sorted((tuple(r["items"]), r["weight"]) for r in df.collect())
    assert plain(found) == plain(want) and items.size(found) == 900 and found.count() < 900
    assert mining._repeated(found).count() == 900


def test_summaries_of_cases_prepare_rows_once(spark, sf_dir, monkeypatch):
    calls = []
    real = bank.mining_rows
    monkeypatch.setattr(bank, "mining_rows", lambda *a: calls.append(a) or real(*a))
    assert release_queries.case_summaries(spark, sf_dir, "C1", "C9").count() == 2
    release_queries.rule_ids(spark, sf_dir)
    assert len(calls) == 2 and sql.MOST


def test_fpgrowth_reads_no_more_rows_than_baskets_ask_for(spark, monkeypatch):
    """Heavy baskets are scaled down for the search; sets and counts are those of all rows, at the threshold too."""
    rows = [(["a", "b"], 700_000), (["a", "b", "c"], 9), (["b", "c"], 299_991), (["c", "d"], 10_000), (["d", "e"], 1), (["e"], 9_999), (["f"], 9_999)]
    df = spark.createDataFrame(rows, "items array<string>, weight long")
    read, real = [], mining._repeated
    monkeypatch.setattr(mining, "_repeated", lambda x: read.append(real(x)) or read[-1])
    plain = lambda x: sorted((tuple(r["items"]), r["n"]) for r in x.collect())
    for support in (10_000 / 1_029_999, 10_001 / 1_029_999, 9_999 / 1_029_999, 0.3):
        assert plain(mining.fpgrowth(df, support, 3)) == plain(mining.apriori(df, support, 3))
    assert len(read) == 4 and all(x.count() <= (mining.COPIED + 2) * len(rows) + len(rows) for x in read)
