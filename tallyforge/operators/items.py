"""Rows as sets of items: feature=VALUE in long form, never as a wide matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import sanitized
from tallyforge.operators.quantiles import quantiles


@dataclass(frozen=True)
class Population:
    name: str
    key: str
    time: str
    target: str
    categorical: tuple[str, ...]
    boolean: tuple[str, ...]
    numeric: tuple[str, ...]
    leaking: tuple[str, ...] = ()
    hierarchy: tuple[tuple[str, str], ...] = ()
    non_negative: tuple[str, ...] = ()


# fixed values: what each population is mined on
POPULATIONS = {
    "transactions": Population(
        "transactions",
        "transaction_id",
        "transaction_date",
        "transaction_status",
        ("transaction_type", "transaction_category", "channel", "merchant_category", "currency", "response_code"),
        ("is_fraud",),
        ("amount", "fraud_score"),
    ),
    "complaints": Population(
        "complaints",
        "complaint_id",
        "creation_date",
        "status",
        ("case_type", "category", "subcategory", "reception_channel", "priority"),
        ("sla_breached", "is_repeat_complainer"),
        ("claimed_amount", "resolution_days"),
        leaking=("sla_breached", "resolution_days"),
        hierarchy=(("category", "subcategory"),),
        non_negative=("claimed_amount",),
    ),
}

QUANTILES = (0.5, 0.9, 0.99)
BUCKETS = ("LOW", "MEDIUM", "HIGH", "EXTREME")


def admitted(df: DataFrame, population: Population, most: int) -> tuple[str, ...]:
    """The target and the categorical columns of at most `most` distinct values."""
    combined = df.select(*population.categorical).distinct()
    counts = combined.agg(*[F.countDistinct(c).alias(c) for c in population.categorical]).first()
    return (population.target, *[c for c in population.categorical if counts[c] <= most])


def bounds(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: for each column the quantiles of its size, null for a column without values."""
    parts = [F.struct(F.lit(c).alias("c"), F.abs(F.col(c).try_cast("double")).alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    found = quantiles(long, ["c"], "v", QUANTILES)
    return found.agg(*[F.max(F.when(F.col("c") == c, F.col("q"))).alias(f"__{c}") for c in columns])


def bucket(value: Column, limits: Column, names: tuple[str, ...] = BUCKETS) -> Column:
    """The first name whose limit the size of value does not exceed; the last without limit."""
    size = F.abs(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for i, name in enumerate(names[:-1]):
        out = out.when(size <= limits[i], name)
    return out.otherwise(names[-1])


def _numeric_items(column: str, non_negative: bool) -> list[Column]:
    value, limits = F.col(column).try_cast("double"), F.col(f"__{column}")
    known = value.isNotNull()
    sign = F.when(value < 0, "NEGATIVE") if non_negative else F.when(value < 0, "NEGATIVE").otherwise("NON_NEGATIVE")
    bounded = limits.isNotNull()
    return [
        F.when(~known, f"{column}=MISSING"),
        F.when(known & ~bounded, f"{column}=PRESENT"),
        F.when(known & bounded, F.concat(F.lit(f"{column}_bucket="), bucket(value, limits))),
        F.when(known & bounded, F.concat(F.lit(f"{column}_sign="), sign)),
    ]


def baskets(df: DataFrame, population: Population, most: int = 30) -> DataFrame:
    """(key, time, items): the sorted items of each row. Bounds are fitted on df itself."""
    bounded = df.join(F.broadcast(bounds(df, _mined_numbers(population))), F.lit(True), "left")  # one row
    items = _items(population, admitted(df, population, most))
    return bounded.select(F.col(population.key).alias("key"), F.col(population.time).alias("time"), items.alias("items"))


def weighted(df: DataFrame, population: Population, most: int = 30) -> DataFrame:
    """(items, weight): the distinct baskets() of the rows and how many rows have each.

    Rows are counted by their values, numbers by bucket and sign, before any item is named, so names are made once for each combination.
    """
    numeric = _mined_numbers(population)
    few = admitted(df, population, most)
    columns = dict.fromkeys((*few, *population.boolean))
    limits = F.broadcast(bounds(df, numeric))  # one row
    # one number of each bucket and sign stands for all of it
    sized = lambda c: F.struct(bucket(F.col(c).try_cast("double"), F.col(f"__{c}")), F.col(c).try_cast("double") < 0)
    alike = df.join(limits, F.lit(True), "left").groupBy(*columns, *[sized(c).alias(f"__like_{c}") for c in numeric])
    combined = alike.agg(*[F.max(c).alias(c) for c in numeric], F.count("*").alias("weight"))
    named = combined.join(limits, F.lit(True), "left").select(_items(population, few).alias("items"), "weight")
    return named.groupBy("items").agg(F.sum("weight").alias("weight"))


def _mined_numbers(population: Population) -> tuple[str, ...]:
    return tuple(c for c in population.numeric if c not in population.leaking)


def _items(population: Population, few: tuple[str, ...]) -> Column:
    """The sorted items of a row that stands beside the bounds of its numbers."""
    numeric = _mined_numbers(population)
    parts = [F.concat(F.lit(f"{c}="), sanitized(F.col(c))) for c in few]
    for c in population.boolean:
        if c not in population.leaking:
            parts.append(F.when(F.col(c).isNull(), f"{c}=UNKNOWN").when(F.col(c), f"{c}=TRUE").otherwise(f"{c}=FALSE"))
    for c in numeric:
        parts += _numeric_items(c, c in population.non_negative)
    return F.array_sort(F.array_compact(F.array(*parts)))


def _weight(rows: DataFrame) -> Column:
    return F.sum("weight") if "weight" in rows.columns else F.count("*")


def collapsed(rows: DataFrame) -> DataFrame:
    """(items, weight): equal baskets as one row, counted before the shuffle; rows may have weights of their own."""
    return rows.groupBy("items").agg(_weight(rows).alias("weight"))


def size(rows: DataFrame) -> int:
    """How many rows baskets stand for."""
    return rows.agg(F.coalesce(_weight(rows), F.lit(0)).alias("n")).first()["n"]


def support(rows: DataFrame) -> DataFrame:
    """(item, n, support) of every item that occurs."""
    total = rows.agg(_weight(rows).alias("total"))
    weight = ["weight"] if "weight" in rows.columns else []
    counts = rows.select(F.explode("items").alias("item"), *weight).groupBy("item").agg(_weight(rows).alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("item", "n", (F.col("n") / F.col("total")).alias("support"))
