"""Quantile sketches of months, merged for any window of months without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch (KLL); a sketch of any number of rows has a few thousand values.
K = 1024
#: By how much the rank of a sketched quantile may be off: twice what a sketch of this size keeps to in 99 of 100 cases.
RANK_ERROR = 2 * 2.296 / K**0.9021


def monthly(df: DataFrame, time: str, value: str) -> DataFrame:
    """(month date, n, sketch): the values of each month; null values and times are left out."""
    known = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.trunc(time, "MM").alias("month")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("sketch"))


def over_windows(sketches: DataFrame, months: int) -> DataFrame:
    """(month, n, sketch) of the windows of that many months that end with each month."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("ahead")
    dealt = sketches.select("*", ends).withColumn("month", F.add_months("month", F.col("ahead")))
    merged = dealt.groupBy("month").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.join(sketches.select("month"), "month", "left_semi")


def quantile(sketch: Column, p: float) -> Column:
    """A value whose rank is within RANK_ERROR of p."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p))


def rank_error(df: DataFrame, time: str, value: str, found: DataFrame, months: int, columns: dict[str, float]) -> DataFrame:
    """(month, n, <column>...): by how much the rank of each found quantile is off, against the rows themselves."""
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(F.trunc(time, "MM").alias("own"), F.col(value).cast("double").alias("v"))
    rows = rows.select("v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months("own", k))).alias("month"))
    met = rows.join(found, "month")
    sums = [x for c in columns for x in (F.count_if(F.col("v") < F.col(c)).alias(f"{c}_below"), F.count_if(F.col("v") <= F.col(c)).alias(f"{c}_upto"))]
    counts = met.groupBy("month").agg(F.count("*").alias("n"), *sums)
    # every rank between the two is the value's
    off = lambda c, p: F.greatest(F.lit(0.0), F.col(f"{c}_below") / F.col("n") - p, p - F.col(f"{c}_upto") / F.col("n"))
    return counts.select("month", "n", *[off(c, p).alias(c) for c, p in columns.items()])
