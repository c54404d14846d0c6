"""Aggregate reports on complaints of one category in a half-open period."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("Resolved", "Closed")
PRIORITIES = ("Low", "Medium", "High", "Critical")
STATUSES = ("Open", "In Process", "Escalated", "Resolved", "Closed", "Rejected")
#: Columns that a report may not return.
PERSONAL = ("customer_id", "description", "agent_id", "resolution_text")


def population(complaints: DataFrame, start: str, end: str, category: str = "Transactions") -> DataFrame:
    created = F.col("creation_date")
    inside = (created >= F.lit(start).cast("timestamp_ntz")) & (created < F.lit(end).cast("timestamp_ntz"))
    return complaints.where((F.col("category") == category) & inside)


def motive_share(complaints: DataFrame) -> DataFrame:
    """Counts by motive and case type with their share of all; the total is one row, joined to the groups."""
    motive = F.coalesce("subcategory", F.lit("UNKNOWN")).alias("motive")
    counts = complaints.groupBy(motive, F.coalesce("case_type", F.lit("UNKNOWN")).alias("case_type")).agg(F.count("*").alias("complaint_count"))
    total = counts.agg(F.sum("complaint_count").alias("total"))
    out = counts.join(F.broadcast(total), F.lit(True))
    return out.select("motive", "case_type", "complaint_count", F.round(F.col("complaint_count") / F.col("total"), 6).alias("share"))


def denominators(complaints: DataFrame) -> DataFrame:
    counts = [F.count("*").alias("population_count")]
    counts += [F.count_if(F.col("priority") == p).alias(f"priority_{p.lower()}") for p in PRIORITIES]
    counts += [F.count_if(F.col("status") == s).alias(f"status_{s.lower().replace(' ', '_')}") for s in STATUSES]
    counts += [F.count_if(F.col("reception_channel").isNotNull()).alias("with_reception_channel")]
    if "origin_interaction_id" in complaints.columns:
        counts += [F.count_if(F.col("origin_interaction_id").isNotNull()).alias("with_origin_interaction")]
    return complaints.agg(*counts)


def monthly(complaints: DataFrame, zone: str = "America/Lima") -> DataFrame:
    month = F.date_format(F.from_utc_timestamp(F.col("creation_date").cast("timestamp"), zone), "yyyy-MM")
    return complaints.groupBy(month.alias("year_month")).agg(
        F.count("*").alias("volume"),
        F.count_if(F.col("priority").isin("High", "Critical")).alias("high_or_critical_count"),
        F.count_if(F.col("status") == "Escalated").alias("escalated_count"),
        F.count_if("sla_breached").alias("sla_breached_count"),
        F.round(F.avg(F.when(F.col("status").isin(*TERMINAL), F.col("resolution_days"))), 4).alias("mean_resolution_days_terminal"),
    )


def resolution_baseline(complaints: DataFrame, exact: bool = True) -> DataFrame:
    """exact percentiles keep a count for each distinct value; otherwise a sketch of bounded size is used."""
    days = F.col("resolution_days")
    quantile = (lambda q: F.percentile(days, q)) if exact else (lambda q: F.percentile_approx(days, q))
    terminal = complaints.where(F.col("status").isin(*TERMINAL) & days.isNotNull())
    return terminal.agg(
        F.count("*").alias("terminal_population"),
        F.count(days).alias("with_resolution_days"),
        F.round(F.avg(days), 6).alias("mean_resolution_days"),
        quantile(0.5).alias("p50_resolution_days"),
        quantile(0.9).alias("p90_resolution_days"),
        F.count_if("sla_breached").alias("sla_breached_count"),
        F.round(F.try_divide(F.count_if("sla_breached"), F.count("*")), 6).alias("sla_breach_rate"),
    )


def assert_aggregate_only(sql: str) -> str:
    """Refuse report SQL that names a personal column outside a comment."""
    body = re.sub(r"--[^\n]*", "", sql)
    named = [c for c in PERSONAL if re.search(rf"\b{c}\b", body, re.I)]
    if named:
        raise ValueError(f"the report names {', '.join(named)}")
    return sql
