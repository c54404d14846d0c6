"""Frequent itemsets by four independent strategies, for consensus between them.

Results are (items array, n long): sorted items and in how many rows they occur together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut
from tallyforge.operators.items import collapsed
from tallyforge.operators.items import size as size_of


def least_count(total: int, min_support: float) -> int:
    return max(1, ceil(min_support * total - 1e-12))


def _frequent_baskets(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent single items, and baskets of only those, collapsed again."""
    weighted = collapsed(rows)
    single = weighted.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    single = single.where(F.col("n") >= least)
    kept = F.array_sort(F.array_agg("item"))  # the distinct frequent items, at most 1 / support for each feature
    known = single.agg(kept.alias("known"))
    slim = weighted.join(F.broadcast(known), F.lit(True)).select(F.array_intersect("items", "known").alias("items"), "weight")
    slim = slim.groupBy("items").agg(F.sum("weight").alias("weight")).where(F.size("items") > 0)
    return single.select(F.array("item").alias("items"), "n"), slim


def _coded(single: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of all frequent items in order, and (places, weight): baskets as rising places in it, which are smaller than names."""
    known = cut(single.agg(F.array_sort(F.collect_list(F.get("items", F.lit(0)))).alias("known")), "frequent-items")  # at most 1 / support for each feature
    places = F.array_sort(F.transform("items", lambda x: F.array_position("known", x).cast("int")))
    return known, cut(slim.join(F.broadcast(known), F.lit(True)).select(places.alias("places"), "weight"), "coded-baskets")


def apriori(rows: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Level by level: an itemset is extended by the later items of the baskets that hold it.

    Infrequent items leave the baskets first, and equal baskets count as one; both are exact. A basket travels with its sets,
    so a level needs no join but that with the frequent sets, which are few.
    """
    least = least_count(size_of(rows), min_support)
    single, slim = _frequent_baskets(rows, least)
    single = cut(single)
    known, coded = _coded(single, slim)
    level = coded.select("places", "weight", F.explode("places").alias("item")).select("places", "weight", F.array("item").alias("set"))
    longer_sets = []
    for _ in range(2, max_len + 1):
        later = F.filter("places", lambda x: x > F.element_at("set", -1))
        longer = level.select("places", "weight", "set", F.explode(later).alias("item")).select("places", "weight", F.array_append("set", F.col("item")).alias("set"))
        counts = cut(longer.groupBy("set").agg(F.sum("weight").alias("n")).where(F.col("n") >= least), "frequent-sets")
        level = longer.join(counts.select("set"), "set", "left_semi")
        longer_sets.append(counts)
    if not longer_sets:
        return single
    named = reduce(DataFrame.unionAll, longer_sets).join(F.broadcast(known), F.lit(True))
    return single.unionAll(named.select(F.transform("set", lambda p: F.element_at("known", p)).alias("items"), "n"))


def fpgrowth(rows: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Spark's FPGrowth; its threshold is moved half a row down so that rounding cannot move it.

    It knows no weights, so a basket is written out as often as its weight says. Where rows are many more than their baskets, each is
    written out in proportion to its weight instead, rounded up: every set that is frequent stays so, and those found are then counted
    by the weights themselves.
    """
    total = size_of(rows)
    if not total:
        return rows.select("items", F.lit(0).cast("long").alias("n"))
    from pyspark.ml.fpm import FPGrowth

    least = least_count(total, min_support)
    baskets = cut(collapsed(rows), "collapsed-baskets") if "weight" in rows.columns else rows
    share = max(1, total // (COPIED * max(1, baskets.count()))) if "weight" in rows.columns else 1
    lighter = baskets.withColumn("weight", F.expr(f"(weight + {share - 1}) div {share}")) if share > 1 else baskets
    threshold = (-(-least // share) - 0.5) / (size_of(lighter) if share > 1 else total)
    model = FPGrowth(itemsCol="items", minSupport=threshold, minConfidence=1.0).fit(_repeated(lighter))
    found = model.freqItemsets.where(F.size("items") <= max_len)
    found = cut(found.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "fp-sets")
    return found if share == 1 else cut(_counted(found.select("items"), baskets).where(F.col("n") >= least), "fp-sets")


def _counted(sets: DataFrame, baskets: DataFrame) -> DataFrame:
    """(items, n): the weight of the baskets that hold each set. A set meets the baskets that hold its first item."""
    spread = baskets.repartition(baskets.sparkSession.sparkContext.defaultParallelism, "items")  # few bytes, but each row meets many sets
    by_item = spread.select(F.col("items").alias("basket"), "weight", F.explode("items").alias("first"))
    met = sets.withColumn("first", F.get("items", F.lit(0))).join(by_item, "first").where(F.size(F.array_except("items", "basket")) == 0)
    return met.groupBy("items").agg(F.sum("weight").alias("n"))


#: Rows for each distinct basket that FPGrowth reads, on average, before they are scaled down.
COPIED = 20
#: Copies of a basket that are written out at a time.
COPIES = 1000


def _repeated(rows: DataFrame) -> DataFrame:
    """Each basket as often as its weight says, for an algorithm that knows no weights."""
    if "weight" not in rows.columns:
        return rows.select("items")
    parts = rows.select("items", "weight", F.explode(F.expr(f"sequence(0, (weight - 1) div {COPIES})")).alias("part"))
    spread = parts.repartition(F.xxhash64("items", "part"))  # a basket of many rows is dealt out
    return spread.select("items", F.explode(F.expr(f"sequence(1, least({COPIES}, weight - part * {COPIES}))"))).select("items")


def eclat(rows: DataFrame, min_support: float, max_len: int, base: int | None = None) -> DataFrame:
    """Vertical and depth-first: each item's class of sets is searched by itself, by intersecting the baskets of its items.

    A class is the baskets that hold its last item, cut down to the items before, equal ones as one with a weight. One of more
    than `base` rows is dealt out again by its next item, so classes of any size stay spread; all sets stay in tasks and tables.
    """
    least = least_count(size_of(rows), min_support)
    single, slim = _frequent_baskets(rows, least)
    known, coded = _coded(single, slim)
    open_ = _bases(coded.select(F.array().cast("array<int>").alias("head"), F.col("places").alias("prefix"), "weight"), least)
    found = []
    while True:
        large = _large(open_, base or BASE, max_len)
        small = open_.join(large, "head", "left_anti")
        found.append(small.groupBy("head").applyInArrow(_searched_base(_frequent, least, max_len), "places array<int>, n long"))
        if large.isEmpty():
            break
        found.append(large.select(F.col("head").alias("places"), "n"))
        open_ = _bases(open_.join(large.select("head"), "head", "left_semi"), least)
    named = reduce(DataFrame.unionAll, found).join(F.broadcast(known), F.lit(True))
    return cut(named.select(F.transform(F.array_sort("places"), lambda p: F.element_at("known", p)).alias("items"), "n"), "frequent-sets")


def _large(bases: DataFrame, most: int, max_len: int | None) -> DataFrame:
    """(head, n) of bases of more than `most` rows whose head may still grow."""
    sizes = bases.groupBy("head").agg(F.count("*").alias("rows"), F.sum("weight").alias("n"))
    return cut(sizes.where((F.col("rows") > most) & (F.size("head") < (max_len or 1 << 20))).select("head", "n"), "large-bases")


def _frequent(held: np.ndarray, weights: np.ndarray, least: int, most: int | None) -> Iterator[tuple[tuple[int, ...], int]]:
    """(columns, weight) of all sets of up to `most` columns that are frequent, the empty set among them."""
    todo = [((), np.arange(len(weights)), held.shape[1])]
    while todo:
        chosen, rows, below = todo.pop()
        yield chosen, int(weights[rows].sum())
        if most is None or len(chosen) < most:
            sums = weights[rows] @ held[rows, :below]
            todo += [((*chosen, t), rows[held[rows, t]], t) for t in np.flatnonzero(sums >= least).tolist()]


#: Baskets of a chunk, whose numbers within it make the lists of a set.
CHUNK = 4096


def hybrid(rows: DataFrame, min_support: float, max_len: int) -> DataFrame:
    """Single items by a pass over the rows, longer sets by the numbers of the baskets that hold them.

    Candidates come from the frequent sets of the level before, joined on all but their last item and kept if all
    of their subsets are frequent. A candidate's baskets are the intersection, chunk by chunk, of those of the set
    without its last item and of that item; all of it stays in tables.
    """
    least = least_count(size_of(rows), min_support)
    single, slim = _frequent_baskets(rows, least)
    single, slim = cut(single), cut(slim)
    # numbers are dealt by hash into chunks and counted within each, so that no task numbers all baskets
    total = slim.count()
    chunks = max(1, -(-2 * total // CHUNK))
    ordered = W.partitionBy("chunk").orderBy("items")  # about half of CHUNK rows
    numbered = slim.withColumn("chunk", F.expr(f"pmod(xxhash64(items), {chunks})")).withColumn("number", F.row_number().over(ordered))
    numbered = cut(numbered)
    weights = numbered.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "weight"))), lambda x: x["weight"]).alias("weights"))
    held = numbered.select("chunk", "number", F.explode("items").alias("item")).groupBy("chunk", "item").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    held = cut(held)
    level, frequent, found = held.select("chunk", F.array("item").alias("set"), "numbers"), single, [single]
    for size in range(2, max_len + 1):
        candidates = cut(_candidates(frequent.select("items"), size))
        shared = level.join(candidates.withColumnRenamed("prefix", "set"), "set").join(held.withColumnRenamed("numbers", "others"), ["chunk", "item"])
        shared = shared.select("chunk", F.concat("set", F.array("item")).alias("set"), F.array_intersect("numbers", "others").alias("numbers")).where(F.size("numbers") > 0)
        shared = cut(shared)
        sums = shared.join(weights, "chunk").select("set", F.aggregate("numbers", F.lit(0).cast("long"), lambda t, n: t + F.col("weights")[n - 1]).alias("n"))
        frequent = cut(sums.groupBy(F.col("set").alias("items")).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        found.append(frequent)
        level = shared.join(frequent.select(F.col("items").alias("set")), "set", "left_semi")
    return reduce(DataFrame.unionAll, found)


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """(prefix, item): sets of `size` items all of whose subsets of one item less are frequent."""
    short = frequent.select(F.slice("items", 1, size - 2).alias("start"), F.element_at("items", -1).alias("last"), "items")
    pairs = short.join(short.select("start", F.col("last").alias("item")), "start").where("last < item").select(F.col("items").alias("prefix"), "item")
    whole = F.concat("prefix", F.array("item"))
    parts = pairs.select("prefix", "item", F.explode(F.transform(whole, lambda x: F.array_remove(whole, x))).alias("items"))
    return parts.join(frequent, "items").groupBy("prefix", "item").agg(F.count("*").alias("k")).where(F.col("k") == size).select("prefix", "item")


def assert_parity(left: DataFrame, right: DataFrame) -> None:
    a, b = left.select("items", "n"), right.select("items", "n")
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("two strategies found different itemsets")


def maximal(itemsets: DataFrame) -> DataFrame:
    """Sets without a frequent superset of one more item: anti-joined to the subsets of the longer sets."""
    subsets = itemsets.where(F.size("items") > 1).select(
        F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items")
    )
    return itemsets.join(subsets.distinct(), "items", "left_anti")


#: Distinct rows of a conditional base up to which one task searches it.
BASE = 20_000


def maximal_search(rows: DataFrame, min_support: float, max_len: int | None = None, base: int = BASE) -> DataFrame:
    """Maximal frequent sets (items, n) without listing the frequent ones.

    Each frequent item, from the rarest, has a conditional base: the baskets that hold it, cut down to more frequent items, equal
    ones as one with a weight. A base is searched depth-first within a task; one of more than `base` rows is dealt out again by its next
    item. What a base calls maximal may still have a superset with a rarer item, which a join on the rarest item finds. With max_len,
    sets of that length count as maximal whatever holds them.
    """
    least = least_count(size_of(rows), min_support)
    single, slim = _frequent_baskets(rows, least)
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.get("items", F.lit(0)).alias("item")))), lambda x: x["item"])
    known = cut(single.agg(order.alias("known")), "frequent-items")  # one row, at most 1 / support for each feature
    places = F.array_sort(F.transform("items", lambda x: F.array_position("known", x).cast("int")))
    ranked = slim.join(F.broadcast(known), F.lit(True)).select(places.alias("prefix"), "weight")
    open_ = _bases(ranked.withColumn("head", F.array().cast("array<int>")), least)
    found = []
    while True:
        large = _large(open_, base, max_len)
        small = open_.join(large, "head", "left_anti")
        found.append(small.groupBy("head").applyInArrow(_searched_base(_deepest, least, max_len), "places array<int>, n long"))
        if large.isEmpty():
            break
        open_ = _bases(open_.join(large.select("head"), "head", "left_semi"), least)
        parents = open_.select(F.slice("head", 1, F.size("head") - 1).alias("head")).distinct()
        found.append(large.join(parents, "head", "left_anti").select(F.col("head").alias("places"), "n"))
    candidates = cut(reduce(DataFrame.unionAll, found).select(F.array_sort("places").alias("places"), "n"), "maximal-candidates")
    rarest = candidates.select("places", F.array_max("places").alias("rare"))
    holders = candidates.select(F.col("places").alias("wider"), F.explode("places").alias("rare"))
    inside = (F.size("wider") > F.size("places")) & (F.size(F.array_except("places", "wider")) == 0)
    covered = rarest.join(holders, "rare").where(inside).select("places").distinct()
    left = candidates.join(covered, "places", "left_anti").join(F.broadcast(known), F.lit(True))
    return left.select(F.array_sort(F.transform("places", lambda p: F.element_at("known", p))).alias("items"), "n")


def _bases(rows: DataFrame, least: int) -> DataFrame:
    """(head, prefix, weight) -> the same of each head with one more item of the prefix, if frequent; the prefix ends before that item."""
    at = rows.select("head", "prefix", "weight", F.posexplode("prefix").alias("k", "item"))
    longer = at.select(F.array_append("head", F.col("item")).alias("head"), F.expr("slice(prefix, 1, k)").alias("prefix"), "weight")
    longer = cut(longer.groupBy("head", "prefix").agg(F.sum("weight").alias("weight")), "bases")
    frequent = longer.groupBy("head").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).select("head")
    return longer.join(frequent, "head", "left_semi")


def _searched_base(search, least: int, max_len: int | None):
    """search() over a base, its sets joined with the base's head."""

    def run(table: pa.Table) -> pa.Table:
        head = table.column("head")[0].as_py()
        weights = table.column("weight").to_numpy()
        prefixes = table.column("prefix").combine_chunks()
        items = np.unique(prefixes.flatten().to_numpy())
        held = np.zeros((len(weights), len(items)), bool)
        held[np.repeat(np.arange(len(weights)), prefixes.value_lengths().to_numpy()), np.searchsorted(items, prefixes.flatten().to_numpy())] = True
        out = [(head + items[list(s)].tolist(), n) for s, n in search(held, weights, least, max_len and max_len - len(head))]
        return pa.table({"places": pa.array([p for p, _ in out], pa.list_(pa.int32())), "n": pa.array([n for _, n in out], pa.int64())})

    return run


def _deepest(held: np.ndarray, weights: np.ndarray, least: int, most: int | None) -> Iterator[tuple[tuple[int, ...], int]]:
    """(columns, weight) of sets of columns that are frequent and that no further column leaves so; up to `most` columns."""
    todo = [((), np.arange(len(weights)), held.shape[1])]
    while todo:
        chosen, rows, below = todo.pop()
        total = int(weights[rows].sum())
        if most is not None and len(chosen) >= most:
            yield chosen, total
            continue
        sums = weights[rows] @ held[rows]
        sums[list(chosen)] = 0
        wider = np.flatnonzero(sums >= least)
        tail = wider[wider < below].tolist()
        if not len(wider):
            yield chosen, total
        elif tail and (most is None or len(chosen) + len(tail) <= most):
            # one set of all that is left, if frequent, holds every other below this one
            whole = rows[held[np.ix_(rows, tail)].all(1)]
            n = int(weights[whole].sum())
            if n >= least:
                others = weights[whole] @ held[whole]
                others[[*chosen, *tail]] = 0
                if not (others >= least).any() or (most is not None and len(chosen) + len(tail) == most):
                    yield (*chosen, *tail), n
                continue
        todo += [((*chosen, t), rows[held[rows, t]], t) for t in tail]


def maximal_overlap(found: DataFrame, itemsets: DataFrame) -> DataFrame:
    """One row: how many maximal sets there are, and how many of them another strategy lists as frequent, with the same count."""
    return found.join(itemsets.select("items", F.col("n").alias("other")), "items", "left").agg(
        F.count("*").alias("maximal"), F.count_if(F.col("other").isNotNull()).alias("overlap"), F.count_if(F.col("other") == F.col("n")).alias("equal_counts")
    )
