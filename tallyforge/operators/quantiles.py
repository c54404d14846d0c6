"""Exact quantiles of groups, with linear interpolation between neighbouring ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut

#: Distinct values of all groups up to which one aggregate a group may hold them; distinct values that are ranked by running sums.
ROWS, LEFT = 1_000_000, 1_000_000
#: Bins into which a round splits the distinct values that could hold a rank.
BINS = 64


def quantiles(df: DataFrame, by: list[str], column: str, probabilities: tuple[float, ...], rows: int = ROWS, left: int = LEFT) -> DataFrame:
    """(by..., q array<double>): exact quantiles of a column of doubles in each group; null values are left out, and
    q is null in a group without others."""
    counted = df.groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    return counted_quantiles(cut(counted, "distinct-values"), by, "__v", "__n", probabilities, rows, left)


def counted_quantiles(df: DataFrame, by: list[str], column: str, count: str, probabilities: tuple[float, ...], rows: int = ROWS, left: int = LEFT) -> DataFrame:
    """quantiles() over rows that each stand for a number of equal ones; df is read several times.

    Few distinct values take one aggregate. More never come together in a group: each round bins the
    distinct values that could hold a wanted rank, counts the rows of the bins and keeps the bins around the rank,
    until so few values are left that running sums find it.
    """
    if df.count() <= rows:
        q = F.percentile(column, F.array(*map(F.lit, probabilities)), F.col(count)).alias("q")
        return df.groupBy(*by).agg(q) if by else df.agg(q)
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    values = df.select(*by, group.alias("__g"), F.col(column).alias("__v"), F.col(count).alias("n"))
    counted = cut(values.where("__v IS NOT NULL").groupBy("__g", "__v").agg(F.sum("n").alias("n")), "counted-values")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    ranks = counted.groupBy("__g").agg(F.sum("n").alias("n")).select("__g", ((F.col("n") - 1) * 1.0).alias("last"), wanted.alias("x"))
    ranks = ranks.select("__g", "x.i", (F.col("last") * F.col("x.p")).alias("at"))
    keys = ["__g", "i"]
    held = counted.join(ranks, "__g").select(*keys, "at", "__v", "n", F.lit(0).cast("long").alias("below"))
    before_round = None
    while True:
        held = cut(held, "held-values")
        size = held.count()
        if size <= left or size == before_round:  # no round narrows what is down to the values around each rank
            break
        before_round = size
        cuts = held.groupBy(*keys).agg(F.percentile_approx("__v", [k / BINS for k in range(BINS + 1)], 1000).alias("cuts"))
        binned = held.join(cuts, keys).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("__v")))).drop("cuts")
        before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # at most BINS + 2 rows
        sizes = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("size"), F.max("at").alias("at"), F.max("below").alias("below"))
        sizes = sizes.withColumn("below", F.col("below") + F.coalesce(F.sum("size").over(before), F.lit(0)))
        near = sizes.where((F.col("below") + F.col("size") > F.floor("at")) & (F.col("below") <= F.ceil("at")))
        near = near.withColumn("below", F.min("below").over(W.partitionBy(*keys)))  # the two bins around a rank at most
        held = binned.drop("below").join(near.select(*keys, "bin", "below"), [*keys, "bin"]).drop("bin")
    running = W.partitionBy(*keys).orderBy("__v")  # at most `left` rows in all
    ranked = held.withColumn("end", F.col("below") + F.sum("n").over(running))
    value = lambda r: F.min(F.when(F.col("end") > r, F.col("__v")))
    found = ranked.groupBy(*keys).agg(F.max("at").alias("at"), value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    between = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"]).alias("q")
    out = found.groupBy("__g").agg(listed)
    if not by:
        return out.agg(F.first("q").alias("q"))
    return values.select(*by, "__g").distinct().join(out, "__g", "left").select(*by, "q")
