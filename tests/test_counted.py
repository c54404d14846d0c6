"""Tables are counted by their distinct values before they are taken apart."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import prepare, quantiles
from tallyforge.sources.contracts import CONTRACTS


def test_quantiles_of_counted_rows(spark):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), (None, 2.0, 1), (None, 4.0, 1), ("c", None, 9)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for most in (100, 0):
        assert {r["g"]: r["q"] for r in quantiles.counted_quantiles(df, ["g"], "v", "n", (0.5,), rows=most).collect()} == {"a": [1.0], None: [3.0], "c": None}


@pytest.mark.parametrize("mode", ["canonical", "strict"])
def test_preparation_writes_the_table_once(spark, monkeypatch, mode):
    """Medians come from counts: no step but the first writes as many rows as the table has."""
    written = []
    real = prepare.cut
    monkeypatch.setattr(prepare, "cut", lambda df, *name: written.append(real(df, *name)) or written[-1])
    contract = replace(CONTRACTS["complaints"], fields=tuple(f for f in CONTRACTS["complaints"].fields if f.name in ("complaint_id", "creation_date", "currency", "claimed_amount")))
    df = spark.range(4000).select(F.col("id").cast("string").alias("complaint_id"), F.lit(None).cast("timestamp_ntz").alias("creation_date"),
        F.when(F.col("id") % 4 > 0, F.lit("PEN")).otherwise(F.when(F.col("id") % 8 > 0, F.lit("USD"))).alias("currency"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("claimed_amount"))
    out = prepare.imputed(df, contract, (prepare.Rule("currency", "categorical"), prepare.Rule("claimed_amount", "numeric", ("currency",))), mode)
    assert out.count() == 4000 and out.where("claimed_amount IS NULL OR currency IS NULL").isEmpty()
    assert [x.count() for x in written if x.count() > 100] == [4000]
