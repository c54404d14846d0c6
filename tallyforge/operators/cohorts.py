"""Median and ninetieth percentile by cohort, with coarser cohorts where a fine one is too small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import sanitized

LEVELS = (("priority", "reception_channel"), ("priority",), ())


def prepared(df: DataFrame, target: str = "resolution_days") -> DataFrame:
    names = LEVELS[0]
    return df.select(*[c for c in df.columns if c not in names], *[sanitized(F.col(c)).alias(c) for c in names]).withColumn("target", F.col(target).cast("double"))


def cohort_quantiles(training: DataFrame, least_rows: int) -> list[DataFrame]:
    """A table for each level: its columns, p50 and p90, for cohorts of least_rows rows at least."""
    out = []
    for names in LEVELS:
        q = F.percentile("target", F.array(F.lit(0.5), F.lit(0.9)))
        found = training.groupBy(*names).agg(F.count("*").alias("n"), q.alias("q"))
        if names:
            found = found.where(F.col("n") >= least_rows)
        out.append(found.select(*names, F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p90")))
    return out


def predictions(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with p50, p90 and cohort_level of the finest cohort there is; the tables hold one row a cohort."""
    fine, coarse, whole = (t.withColumnsRenamed({"p50": f"p50_{i}", "p90": f"p90_{i}"}) for i, t in enumerate(levels))
    out = rows.join(fine, list(LEVELS[0]), "left").join(coarse, list(LEVELS[1]), "left").join(F.broadcast(whole), F.lit(True))
    level = F.when(F.col("p50_0").isNotNull(), "priority_channel").when(F.col("p50_1").isNotNull(), "priority").otherwise("global")
    out = out.withColumn("cohort_level", level)
    for q in ("p50", "p90"):
        out = out.withColumn(q, F.coalesce(f"{q}_0", f"{q}_1", f"{q}_2")).drop(f"{q}_0", f"{q}_1", f"{q}_2")
    return out


def evaluation(predicted: DataFrame) -> DataFrame:
    t = F.col("target")
    return predicted.groupBy("cohort_level").agg(
        F.count("*").alias("row_count"),
        F.round(F.avg(F.abs(t - F.col("p50"))), 6).alias("mae_against_p50"),
        F.round(F.avg((t <= F.col("p50")).cast("double")), 6).alias("p50_empirical_coverage"),
        F.round(F.avg((t <= F.col("p90")).cast("double")), 6).alias("p90_empirical_coverage"),
    )
