"""Raw to staging, auxiliary and curated tables: typed, one row a key, null flags, imputed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.functions.text import normalized
from tallyforge.operators.quantiles import counted_quantiles
from tallyforge.sources.contracts import Contract


#: Repeated keys whose rows are picked out by a broadcast list of their hashes, 8 bytes a key.
LISTED = 100_000


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str  # categorical or numeric
    group_by: tuple[str, ...] = ()


# fixed values: the rules of the initial workflow; targets have none
RULES = {
    "transactions": (
        Rule("transaction_type", "categorical"),
        Rule("transaction_category", "categorical"),
        Rule("channel", "categorical"),
        Rule("merchant_category", "categorical"),
        Rule("currency", "categorical"),
        Rule("amount", "numeric", ("currency",)),
        Rule("fraud_score", "numeric", ("transaction_category",)),
    ),
    "complaints": (
        Rule("case_type", "categorical"),
        Rule("category", "categorical"),
        Rule("subcategory", "categorical", ("category",)),
        Rule("reception_channel", "categorical"),
        Rule("priority", "categorical"),
        Rule("claimed_amount", "numeric", ("currency",)),
    ),
    "call_center_interactions": (Rule("interaction_type", "categorical"), Rule("channel", "categorical")),
    "satisfaction_surveys": (),
}


def check_rules(rules: tuple[Rule, ...], contract: Contract) -> None:
    names = [r.column for r in rules]
    known = {f.name for f in contract.fields}
    if len(set(names)) < len(names):
        raise ValueError("a column has two rules")
    for rule in rules:
        if rule.column in (contract.primary_key, contract.freshness):
            raise ValueError(f"{rule.column} identifies rows and cannot be imputed")
        if rule.column not in known or not set(rule.group_by) <= known:
            raise ValueError(f"{rule.column}: no such column in {contract.name}")


def typed(name: str, types: tuple[str, ...]) -> Column:
    """A cast that gives null where a value does not fit; a field that accepts floats becomes double."""
    for accepted, target in (("TIMESTAMP", "timestamp_ntz"), ("BOOL", "boolean"), ("FLOAT64", "double"), ("INT64", "bigint")):
        if accepted in types:
            return F.col(name).try_cast(target).alias(name)
    return F.col(name).cast("string").alias(name)


def latest(df: DataFrame, key: str, freshness: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key with the greatest freshness; ties go to the greatest of the columns given.

    Keys are counted by their hashes first, which is a narrow pass. If few occur again, only their rows are ranked and the others are neither
    shuffled nor sorted; else ranked rows beyond the first are left out before the shuffle too. Only columns in use are carried.
    """
    known = df.where(F.col(key).isNotNull() & F.col(freshness).isNotNull())
    again = cut(known.groupBy(F.xxhash64(key).alias("__h")).agg(F.count("*").alias("__n")).where("__n > 1").select("__h"), "repeated-keys")
    several, single = known, None
    if (repeated := again.count()) <= LISTED:
        hashed = known.withColumn("__h", F.xxhash64(key))
        single = hashed.join(F.broadcast(again), "__h", "left_anti").drop("__h")
        if not repeated:
            return single
        several = hashed.join(F.broadcast(again), "__h", "left_semi").drop("__h")
    window = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in (freshness, *ties)])
    ranked = several.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
    return ranked if single is None else single.unionAll(ranked)


def staged(df: DataFrame, contract: Contract, ties: tuple[str, ...] = ()) -> DataFrame:
    return latest(df, contract.primary_key, contract.freshness, ties).select([typed(f.name, f.types) for f in contract.fields])


def flagged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return df.withColumns({f"{r.column}_is_null": F.col(r.column).isNull() for r in rules}) if rules else df


def modes(df: DataFrame, column: str, group_by: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent value of a column in each group, the smallest among equals."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group_by, column).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v")))["v"]
    return counts.groupBy(*group_by).agg(best.alias("mode_value"))


def imputed(df: DataFrame, contract: Contract, rules: tuple[Rule, ...], mode: str = "canonical") -> DataFrame:
    """The curated table: one step a rule, later steps see what earlier ones filled in.

    canonical: categories take their group's mode (the table's without a group), then UNKNOWN; numbers
    their group's median, then the table's median before filling. strict: ungrouped categories take
    UNKNOWN at once, and the table's median is taken after the groups' were filled in.

    A rule changes its own column only. All counts of categories come from the table's distinct combinations of them, medians from
    the distinct values of each group, both counted in a pass over the few columns they need; lookups are as small as the number
    of groups and are joined as such.
    """
    check_rules(rules, contract)
    out = df.select([f.name for f in contract.fields])
    for rule in rules:
        column = F.col(rule.column)
        out = out.withColumn(rule.column, normalized(column) if rule.kind == "categorical" else column.try_cast("double"))
    if not rules:
        return out
    out = cut(out.withColumns({f"{r.column}_was_imputed": F.col(r.column).isNull() for r in rules}), "normalized")
    plain = [r.column for r in rules if r.kind == "categorical" and not r.group_by]
    grouped = [r for r in rules if r.kind == "categorical" and r.group_by]
    counts = cut(_category_counts(out, plain, grouped), "category-counts")
    modes = _whole_modes(counts, plain).first().asDict() if plain and mode == "canonical" else {}  # one row
    fills = {c: F.lit("UNKNOWN" if modes.get(c) is None else modes[c]) for c in plain}
    out = out.withColumns({c: F.coalesce(c, fill) for c, fill in fills.items()})
    for rule in grouped:
        own = counts.where(F.col("c") == rule.column).select("v", "n", *[F.col("g")[i].alias(g) for i, g in enumerate(rule.group_by)])
        own = own.withColumns({g: F.coalesce(g, fills[g]) for g in rule.group_by if g in fills}).groupBy(*rule.group_by, "v").agg(F.sum("n").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("mode_value")
        out = out.join(own.where("v IS NOT NULL").groupBy(*rule.group_by).agg(best), list(rule.group_by), "left")
        out = out.withColumn(rule.column, F.coalesce(rule.column, "mode_value", F.lit("UNKNOWN"))).drop("mode_value")
    return _with_medians(out, [r for r in rules if r.kind == "numeric"], mode)


def _category_counts(df: DataFrame, plain: list[str], grouped: list[Rule]) -> DataFrame:
    """(c, g array, v, n): rows of each value of each ruled column, by the values of the rule's group. Equal combinations of
    all these columns are counted as one before they are taken apart."""
    text = "array<string>"
    parts = [F.struct(F.lit(c).alias("c"), F.array().cast(text).alias("g"), F.col(c).alias("v")) for c in plain]
    parts += [F.struct(F.lit(r.column).alias("c"), F.array(*[F.col(g) for g in r.group_by]).cast(text).alias("g"), F.col(r.column).alias("v")) for r in grouped]
    if not parts:
        return df.sparkSession.createDataFrame([], "c string, g array<string>, v string, n long")
    columns = dict.fromkeys([*plain, *[c for r in grouped for c in (*r.group_by, r.column)]])
    combined = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return combined.select(F.explode(F.array(*parts)).alias("x"), "n").select("x.*", "n").groupBy("c", "g", "v").agg(F.sum("n").alias("n"))


def _whole_modes(counts: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mode of each column."""
    best = counts.where(F.col("v").isNotNull() & (F.size("g") == 0)).groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v"))
    return best.agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])


def _with_medians(df: DataFrame, rules: list[Rule], mode: str) -> DataFrame:
    """Numbers filled by the median of their group, rows without a group being one group, then by that of the table."""
    out = df
    for rule in rules:
        group = [f"__{g}" for g in rule.group_by]
        counted = df.groupBy(*[F.col(g).alias(k) for g, k in zip(rule.group_by, group)], F.col(rule.column).alias("v")).agg(F.count("*").alias("n"))
        counted = cut(counted, "distinct-values")
        if group:
            own = cut(counted_quantiles(counted, group, "v", "n", (0.5,)).select(*group, F.col("q")[0].alias("__group")), "medians")
            same = reduce(and_, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(rule.group_by, group)])
            out = out.join(own, same, "left")
        if group and mode == "strict":
            counted = counted.alias("a").join(own.alias("b"), reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in group]))
            counted = cut(counted.groupBy(F.coalesce("v", "__group").alias("v")).agg(F.sum("n").alias("n")), "distinct-values")
        whole = counted_quantiles(counted, [], "v", "n", (0.5,)).select(F.col("q")[0].alias("m")).first()  # one row
        values = [*(["__group"] if group else []), F.lit(whole["m"] if whole else None).cast("double")]
        out = out.withColumn(rule.column, F.coalesce(rule.column, *values)).drop("__group", *group)
    return out.select(df.columns)


def last_of_key(df: DataFrame, key: str, freshness: str, order: str) -> DataFrame:
    """The strict twin of latest(): among rows of one key and freshness the last in source order wins; a null key is an error."""
    if not df.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in a row")
    return latest(df, key, freshness, (order,))


def strictly_staged(df: DataFrame, contract: Contract, order: str) -> DataFrame:
    """The strict twin of staged(): order is a column that numbers rows as their source holds them."""
    return last_of_key(df, contract.primary_key, contract.freshness, order).select([typed(f.name, f.types) for f in contract.fields])
