"""Association rules: derivation, pruning, consensus, comparison, enrichment.

A rule is (antecedents array, consequent, support, confidence, lift), metrics rounded to six digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut

METRICS = ("support", "confidence", "lift")


def rules(itemsets: DataFrame, total: int, target: str, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules whose one consequent is a target item and whose antecedents are none.

    They are few and read many times by what prunes and compares them, so their lineage is cut.
    """
    is_target = lambda x: x.startswith(f"{target}=")
    whole = itemsets.where((F.size("items") > 1) & (F.size(F.filter("items", is_target)) == 1))
    whole = whole.select(
        F.filter("items", lambda x: ~is_target(x)).alias("antecedents"), F.get(F.filter("items", is_target), F.lit(0)).alias("consequent"), "n"
    )
    left = itemsets.select(F.col("items").alias("antecedents"), F.col("n").alias("n_left"))
    first = F.get("items", F.lit(0))
    right = itemsets.where((F.size("items") == 1) & is_target(first)).select(first.alias("consequent"), F.col("n").alias("n_right"))
    out = whole.join(left, "antecedents").join(right, "consequent")
    out = out.withColumn("c", F.col("n") / F.col("n_left"))
    out = out.withColumn("l", F.col("c") / (F.col("n_right") / F.lit(total)))
    out = out.where((F.col("c") >= min_confidence) & (F.col("l") >= min_lift))
    out = out.select(
        "antecedents", "consequent", F.round(F.col("n") / total, 6).alias("support"), F.round("c", 6).alias("confidence"), F.round("l", 6).alias("lift")
    )
    return cut(out)


def _feature(item):
    return F.split_part(item, F.lit("="), F.lit(1))


def without_hierarchy(found: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rules whose antecedents hold no feature together with one above it."""
    features = F.transform("antecedents", _feature)
    for above, below in pairs:
        found = found.where(~(F.array_contains(features, above) & F.array_contains(features, below)))
    return found


def without_descendants(found: DataFrame, pairs: tuple[tuple[str, str], ...], epsilon: float = 0.05) -> DataFrame:
    """Drop a rule when the rule with one feature generalized has nearly its confidence.

    Exact for hierarchies of one level: both sides are brought to a common form, joined on it, and the
    confidences compared.
    """
    for above, below in pairs:
        features = F.transform("antecedents", _feature)
        form = F.concat_ws("\x1f", F.array_sort(F.transform("antecedents", _generalizer(above, below))))
        wide = found.where(F.array_contains(features, above)).select(
            F.col("consequent").alias("wide_consequent"), form.alias("wide_form"), F.col("confidence").alias("wide_confidence")
        )
        narrow = found.withColumn("form", F.when(F.array_contains(features, below), form))
        near = F.abs(F.col("confidence") - F.col("wide_confidence")) <= epsilon
        same = (F.col("consequent") == F.col("wide_consequent")) & (F.col("form") == F.col("wide_form"))
        found = narrow.join(wide, same & near, "left_anti").drop("form")
    return found


def closure(pairs: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """All (feature, feature below it) that follow from direct pairs; a cycle is an error. Hierarchies are as small as schemas."""
    known = set(pairs)
    while more := {(a, d) for a, b in known for c, d in known if b == c} - known:
        known |= more
    if any(a == b for a, b in known):
        raise ValueError("a feature lies above itself")
    return tuple(sorted(known))


def _generalizations(found: DataFrame, pairs: tuple[tuple[str, str], ...], epsilon: float) -> DataFrame:
    """(wide, narrow) numbers of rules: wide comes first in the order of consequent, length and antecedents, each of its items equals or
    generalizes another item of narrow, and their confidences differ by epsilon at most.

    Rules meet on a common form in which items are replaced by a feature above them, or their own, with any value; a rule has few
    forms, so this is no product of rules. What meets is then matched item by item.
    """
    parents: dict[str, list[str]] = {}
    for above, below in pairs:
        parents.setdefault(below, []).append(above)
    top = F.array(*[F.lit(x) for x in sorted({a for a, _ in pairs})])
    ups = F.create_map(*[y for k, v in sorted(parents.items()) for y in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    none = F.array().cast("array<string>")
    star = lambda features: F.transform(features, lambda f: F.concat(f, F.lit("=*")))
    own = lambda x: F.when(F.array_contains(top, _feature(x)), star(F.array(_feature(x)))).otherwise(none)
    above = lambda x: star(F.coalesce(ups[_feature(x)], none))

    def forms(choices) -> DataFrame:
        """Every way to keep or replace the items, as a sorted text."""
        lists = F.transform("antecedents", lambda x: F.concat(F.array(x), choices(x)))
        product = F.aggregate(lists, F.array(none), lambda done, options: F.flatten(F.transform(done, lambda d: F.transform(options, lambda o: F.array_append(d, o)))))
        text = F.transform(product, lambda x: F.concat_ws("\x1f", F.array_sort(x)))
        return found.select("number", "antecedents", "consequent", "confidence", F.explode(F.array_distinct(text)).alias("form"))

    wide = forms(own).select(F.col("number").alias("wide"), F.col("antecedents").alias("wide_items"), "consequent", F.col("confidence").alias("wide_confidence"), "form")
    narrow = forms(above).withColumnRenamed("number", "narrow")
    near = F.abs(F.col("confidence") - F.col("wide_confidence")) <= epsilon
    met = narrow.join(wide, ["consequent", "form"]).where(near & (F.col("wide_items") < F.col("antecedents")) & (F.array_sort("wide_items") != F.array_sort("antecedents")))
    met = met.select("wide", "narrow", "wide_items", F.col("antecedents").alias("narrow_items")).distinct()
    # the items of the wide rule take the first that fits of what the others have left
    fits = lambda a, d: (a == d) | F.array_contains(F.coalesce(ups[_feature(d)], none), _feature(a))
    start = F.struct(F.lit(True).alias("ok"), F.col("narrow_items").alias("left"))

    def taken(state, item):
        at = F.array_position(F.transform(state["left"], lambda d: fits(item, d)), True)
        rest = F.filter(state["left"], lambda d, i: i + 1 != at)
        return F.struct((state["ok"] & (at > 0)).alias("ok"), rest.alias("left"))

    return met.where(F.aggregate("wide_items", start, taken, lambda s: s["ok"])).select("wide", "narrow")


def without_generalized(found: DataFrame, pairs: tuple[tuple[str, str], ...], epsilon: float = 0.05) -> DataFrame:
    """Drop rules that a rule which stays generalizes with nearly the same confidence, for hierarchies of any number of levels.

    The pairs are taken as given; closure() adds what follows from them. A rule that is dropped drops none itself, so rules are
    settled in rounds: who has no undecided or staying rule above stays, whom a staying rule generalizes goes. Each round settles
    a level, of which there are no more than the longest chain of rules.
    """
    if not pairs:
        return found
    numbered = cut(found.withColumn("number", F.monotonically_increasing_id()), "numbered-rules")
    edges = cut(_generalizations(numbered, pairs, epsilon), "rule-edges")
    open_, gone = edges, None
    while not open_.isEmpty():
        below = open_.select(F.col("narrow").alias("wide")).distinct()
        settled = open_.select("wide").distinct().join(below, "wide", "left_anti")  # nothing undecided stands above these: they stay
        fallen = cut(open_.join(settled, "wide", "left_semi").select("narrow").distinct(), "dropped-rules")
        gone = fallen if gone is None else gone.unionAll(fallen)
        left = open_.join(settled, "wide", "left_anti").join(fallen, "narrow", "left_anti")
        open_ = cut(left.join(fallen.select(F.col("narrow").alias("wide")), "wide", "left_anti").select("wide", "narrow"), "rule-edges")
    kept = numbered if gone is None else numbered.join(gone.select(F.col("narrow").alias("number")), "number", "left_anti")
    return kept.drop("number")


def _generalizer(above: str, below: str):
    return lambda x: F.when(_feature(x).isin(above, below), F.lit(f"{above}=*")).otherwise(x)


def without_supersets(found: DataFrame) -> DataFrame:
    """Drop a rule when fewer of its antecedents give the same consequent with the same metrics.

    Joined on proper subsets of the antecedents, of which there are few, rather than rule by rule.
    """
    key = lambda x: F.concat_ws("\x1f", x)
    n = F.size("antecedents")
    chosen = F.transform(
        F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 2).cast("int")),
        lambda mask: F.filter("antecedents", lambda x, i: F.getbit(mask, i) == 1),
    )
    longer = found.where(n > 1).select("antecedents", "consequent", *METRICS, F.explode(chosen).alias("part"))
    longer = longer.select(F.col("antecedents").alias("whole"), "consequent", *METRICS, key(F.col("part")).alias("part"))
    shorter = found.select(key(F.col("antecedents")).alias("part"), "consequent", *METRICS)
    redundant = longer.join(shorter, ["part", "consequent", *METRICS], "left_semi").select(F.col("whole").alias("antecedents"), "consequent").distinct()
    return found.join(redundant, ["antecedents", "consequent"], "left_anti")


def refined(found: DataFrame, pairs: tuple[tuple[str, str], ...], epsilon: float = 0.05) -> DataFrame:
    flat = without_hierarchy(found, pairs)
    settled = without_descendants(flat, pairs, epsilon) if len(pairs) < 2 else without_generalized(flat, pairs, epsilon)
    return cut(without_supersets(cut(settled)))


def consensus(*sets: DataFrame) -> DataFrame:
    """Rules that all strategies found with the same metrics."""
    out = sets[0].select("antecedents", "consequent", *METRICS)
    for other in sets[1:]:
        out = out.intersect(other.select(out.columns))
    return out


def strict_consensus(*sets: DataFrame) -> DataFrame:
    """As consensus, but rules that all strategies found with different metrics are an error."""
    keys = ["antecedents", "consequent"]
    everywhere = reduce(lambda x, y: x.intersect(y), [s.select(*keys) for s in sets])
    out = cut(consensus(*sets))
    if not everywhere.exceptAll(out.select(*keys)).isEmpty():
        raise ValueError("strategies found the same rule with different metrics")
    return out


def multi_jaccard(sets: list[DataFrame]) -> DataFrame:
    """One row: rules in all of the sets, rules in any of them, and their ratio; 1.0 if there are none."""
    tagged = [s.select("antecedents", "consequent", F.lit(i).alias("i")).distinct() for i, s in enumerate(sets)]
    seen = reduce(DataFrame.unionAll, tagged).groupBy("antecedents", "consequent").agg(F.count("*").alias("n"))
    out = seen.agg(F.count_if(F.col("n") == len(sets)).alias("shared"), F.count("*").alias("total"))
    return out.select("shared", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("shared") / F.col("total"), 6)).alias("jaccard"))


def histogram(found: DataFrame) -> DataFrame:
    """(antecedent_length, n) of a rule set."""
    return found.groupBy(F.size("antecedents").alias("antecedent_length")).agg(F.count("*").alias("n"))


def ordered(found: DataFrame) -> DataFrame:
    """The order in which rules are listed: lift, confidence and support falling, then their items."""
    return found.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequent")


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: shared and all rules of two sets by their antecedents and consequent; 1.0 for two empty sets."""
    keys = ["antecedents", "consequent"]
    both = left.select(*keys, F.lit(1).alias("l")).join(right.select(*keys, F.lit(1).alias("r")), keys, "full")
    out = both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"), F.count("*").alias("total"))
    return out.select("shared", "total", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("shared") / F.col("total"), 6)).alias("jaccard"))


def enriched(found: DataFrame) -> DataFrame:
    prevalence = F.col("confidence") / F.col("lift")
    return found.select(
        "antecedents", "consequent", *METRICS,
        F.round(prevalence, 6).alias("consequent_prevalence"),
        F.when(F.col("confidence") < 1 - 1e-12, F.round((1 - prevalence) / (1 - F.col("confidence")), 6)).alias("conviction"),
        F.round(F.col("support") * (1 - 1 / F.col("lift")), 6).alias("leverage"),
        F.size("antecedents").alias("antecedent_length"),
    )


def evaluated(found: DataFrame, rows: DataFrame, min_lift: float, max_delta: float) -> DataFrame:
    """Rules with their metrics on other rows, and whether they hold there.

    A rule meets the baskets that hold its first antecedent; equal baskets are one. The rows' number and
    the consequents' counts are joined by name, so an item that does not occur counts as zero.
    """
    from tallyforge.operators.items import collapsed

    baskets = cut(collapsed(rows))
    by_item = baskets.select("items", "weight", F.explode("items").alias("first"))
    ruled = found.withColumn("first", F.get("antecedents", F.lit(0)))
    met = ruled.join(by_item, "first").where(F.size(F.array_except("antecedents", "items")) == 0)
    counts = met.groupBy("antecedents", "consequent").agg(
        F.sum("weight").alias("n_left"), F.sum(F.when(F.array_contains("items", F.col("consequent")), F.col("weight")).otherwise(0)).alias("n_both")
    )
    total = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    right = baskets.select(F.explode("items").alias("consequent"), "weight").groupBy("consequent").agg(F.sum("weight").alias("n_right"))
    out = found.join(counts, ["antecedents", "consequent"], "left").join(right, "consequent", "left").join(F.broadcast(total), F.lit(True))
    zero = F.lit(0.0)
    out = out.withColumn("s", F.coalesce(F.try_divide("n_both", "total"), zero)).withColumn("c", F.coalesce(F.try_divide("n_both", "n_left"), zero))
    out = out.withColumn("l", F.coalesce(F.try_divide(F.col("c"), F.try_divide("n_right", "total")), zero))
    delta = F.abs(F.col("c") - F.col("confidence"))
    return out.select(
        "antecedents", "consequent", *[F.col(m).alias(f"train_{m}") for m in METRICS],
        F.round("s", 6).alias("holdout_support"), F.round("c", 6).alias("holdout_confidence"), F.round("l", 6).alias("holdout_lift"),
        F.round(delta, 6).alias("confidence_delta"), ((F.col("l") >= min_lift) & (delta <= max_delta)).alias("stable"),
    )


def mined(rows: DataFrame, population, min_support: float, max_len: int, min_confidence: float, min_lift: float, strategy) -> DataFrame:
    """Refined rules of one strategy."""
    from tallyforge.operators.items import size

    found = rules(strategy(rows, min_support, max_len), size(rows), population.target, min_confidence, min_lift)
    return refined(found, population.hierarchy)
