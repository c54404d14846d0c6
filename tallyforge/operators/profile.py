"""Profiles of tables and numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.quantiles import quantiles
from tallyforge.sources.contracts import Contract


def source_profile(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: rows, distinct and surplus keys, freshness range, nulls of each field."""
    key = F.col(contract.primary_key)
    return df.agg(
        F.count("*").alias("row_count"),
        F.countDistinct(key).alias("distinct_primary_keys"),
        (F.count("*") - F.countDistinct(key)).alias("duplicate_primary_key_count"),
        F.min(contract.freshness).alias("freshness_min"),
        F.max(contract.freshness).alias("freshness_max"),
        *[F.count_if(F.col(f.name).isNull()).alias(f"null_{f.name}") for f in contract.fields],
    )


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """One row of a batch or a stream's batch: rows, rows without a key, and rows beyond the first of their key."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        (F.count(key) - F.countDistinct(key)).alias("duplicate_keys"),
    )


def quality_profile(df: DataFrame, contract: Contract) -> DataFrame:
    """One row a field: its nulls and whether the contract requires it; on every row the rows and surplus keys."""
    total = F.count("*").alias("row_count")
    surplus = (F.count("*") - F.countDistinct(contract.primary_key)).alias("duplicates")
    nulls = [F.count_if(F.col(f.name).isNull()).alias(f.name) for f in contract.fields]
    row = df.agg(total, surplus, *nulls)  # one row
    parts = [F.struct(F.lit(f.name).alias("field"), F.lit(f.required).alias("required"), F.col(f.name).alias("null_count")) for f in contract.fields]
    return row.select("row_count", "duplicates", F.explode(F.array(*parts)).alias("x")).select("x.field", "x.required", "x.null_count", "row_count", "duplicates")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: nulls, distinct values, range, quartiles and values outside 1.5 interquartile ranges."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    stats = long.groupBy("column").agg(
        F.count_if(F.col("v").isNull()).alias("null_count"),
        F.countDistinct("v").alias("distinct_count"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
    )
    stats = stats.join(quantiles(long, ["column"], "v", (0.25, 0.5, 0.75)), "column")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    outside = (F.col("v") < F.col("q")[0] - reach) | (F.col("v") > F.col("q")[2] + reach)
    # one row for each column given
    outliers = long.join(F.broadcast(stats.select("column", "q")), "column").groupBy("column").agg(F.count_if(outside).alias("outlier_count"))
    return stats.join(outliers, "column").select(
        "column", "null_count", "distinct_count",
        *[F.round(x, 6).alias(n) for x, n in ((F.col("min_value"), "min_value"), (F.col("q")[0], "q1"), (F.col("q")[1], "median"), (F.col("q")[2], "q3"), (F.col("max_value"), "max_value"))],
        "outlier_count",
    )


def outside(df: DataFrame, column: str, least: float, most: float) -> DataFrame:
    """Rows whose value is null or lies outside of a range, ends included."""
    return df.where(~F.coalesce(F.col(column).between(least, most), F.lit(False)))


def require_range(df: DataFrame, column: str, least: float, most: float) -> None:
    """An error if there is such a row; the first one found ends the search."""
    if not outside(df, column, least, most).isEmpty():
        raise ValueError(f"{column} has a value outside of {least} to {most}")
