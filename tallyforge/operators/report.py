"""The interpretability report of a release, and its suite of case manifests, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import rules as rule_ops

MEASURES = ("support", "confidence", "lift", "conviction", "leverage")
# fixed values: statistics of a distribution, and cases that have no manifest, with what each lacks
STATISTICS = {"min": 0.0, "p50": 0.5, "p90": 0.9, "max": 1.0}
SUITE = ("C1", "C2", "C3", "C4", "C5")
BLOCKED = {
    "C6": "missing complaint-to-transaction canonical relation",
    "C7": "missing merchant evidence and validated outcome",
    "C8": "missing payment-rail reconciliation evidence",
}


def _long(df: DataFrame, section: str, name, values: dict) -> DataFrame:
    """(section, name, measure, value) of one row, or of a row a name."""
    parts = [F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()]
    return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(F.array(*parts)).alias("x")).select("section", "name", "x.*")


def _distributions(enriched: DataFrame, by: list, section: str, measures: tuple[str, ...]) -> DataFrame:
    found = enriched.groupBy(*by).agg(
        F.count("*").alias("rule_count"),
        *[x for m in measures for x in (F.percentile(m, F.array(*map(F.lit, STATISTICS.values()))).alias(m), F.avg(m).alias(f"{m}_mean"))],
    )
    values = {"rule_count": F.col("rule_count")}
    for m in measures:
        values |= {f"{m}_{s}": F.round(F.round(F.col(m)[i], 9), 6) for i, s in enumerate(STATISTICS)} | {f"{m}_mean": F.round(F.round(f"{m}_mean", 9), 6)}
    return _long(found, section, F.col("consequent") if by else F.lit("all"), values)


def association(found: DataFrame) -> DataFrame:
    """The section of a rule set: distributions of its measures, in all and by consequent, antecedent lengths and features.

    Rules are few (what survives support, confidence and lift), so percentiles of each group are exact. A conviction without
    bound is left out of its distribution.
    """
    enriched = rule_ops.enriched(found)
    by_length = rule_ops.histogram(found)
    features = found.select(F.explode("antecedents").alias("item")).groupBy(F.split_part("item", F.lit("="), F.lit(1)).alias("feature")).agg(F.count("*").alias("n"))
    return reduce(
        DataFrame.unionAll,
        [
            _distributions(enriched, [], "association", MEASURES),
            _distributions(enriched, ["consequent"], "consequent", ("lift", "confidence", "support")),
            _long(by_length, "antecedent_length", F.col("antecedent_length").cast("string"), {"rules": F.col("n")}),
            _long(features, "feature", F.col("feature"), {"rules": F.col("n")}),
        ],
    )


def graph_section(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    b = edges.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    return _long(a, "nodes", F.col("name"), {"count": F.col("n")}).unionAll(_long(b, "edges", F.col("name"), {"count": F.col("n")}))


def supervised(metrics: DataFrame) -> DataFrame:
    """metrics (case_id, <numbers>...) -> a row for each case and metric."""
    return _long(metrics, "supervised", F.col("case_id"), {c: F.col(c) for c in metrics.columns if c != "case_id"})


def gaps(report: DataFrame) -> DataFrame:
    """Sections that a whole report has and this one lacks; none for a whole one."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(s,) for s in ("association", "consequent", "supervised", "nodes", "edges")], "section string")
    return wanted.join(report.select("section"), "section", "left_anti")


def consolidated(manifests: DataFrame) -> DataFrame:
    """manifests (case_id, content text): one row for each case of a release, (case_id, status, sha256, run_id, schema_version, reason).

    A case of the suite without its manifest, or with several, of another case, or with a publication requested is an error. Cases
    that have none are blocked, with a reason.
    """
    spark = manifests.sparkSession
    of = lambda name: F.get_json_object("content", f"$.{name}")
    read = manifests.select("case_id", "content", of("case").alias("case"), of("publication").alias("publication"), of("run_id").alias("run_id"), of("schema_version").alias("schema_version"))
    listed = spark.createDataFrame([(c,) for c in SUITE], "case_id string")
    counts = listed.join(read.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left").where("n IS NULL OR n <> 1")
    if not counts.isEmpty():
        raise ValueError(f"not one manifest each: {', '.join(sorted(r.case_id for r in counts.collect()))}")  # at most five
    own = read.join(listed, "case_id", "left_semi")
    valid = F.coalesce((F.col("case") == F.col("case_id")) & (F.col("publication") == "not_requested"), F.lit(False))
    if not own.where(~valid).isEmpty():
        raise ValueError("a manifest is of another case or asks for publication")
    blocked = spark.createDataFrame(list(BLOCKED.items()), "case_id string, reason string")
    none = F.lit(None).cast("string")
    done = own.select("case_id", F.lit("consolidated").alias("status"), F.sha2("content", 256).alias("sha256"), "run_id", "schema_version", none.alias("reason"))
    return done.unionAll(blocked.select("case_id", F.lit("blocked"), none, none, none, "reason"))
