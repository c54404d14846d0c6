"""Maximal sets without the frequent ones, against lists of all of them."""

import itertools
import random

import pytest

from tallyforge.operators import mining


def brute(baskets, least, most):
    names = sorted({i for b in baskets for i in b})
    sets = {}
    for k in range(1, (most or len(names)) + 1):
        for s in itertools.combinations(names, k):
            n = sum(set(s) <= set(b) for b in baskets)
            if n >= least:
                sets[s] = n
    return sorted((s, n) for s, n in sets.items() if not any(set(s) < set(t) for t in sets if len(t) == len(s) + 1))


@pytest.mark.parametrize("most", [None, 2, 3])
@pytest.mark.parametrize("base", [20_000, 3])
def test_equals_brute_force(spark, most, base):
    rng = random.Random(most or 9)
    baskets = [sorted(rng.sample("abcdefgh", rng.randrange(1, 7))) for _ in range(50)] + [list("abc")] * 9 + [[]]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    found = mining.maximal_search(df, 0.12, most, base)
    got = sorted((tuple(r["items"]), r.n) for r in found.collect())
    assert got == brute(baskets, mining.least_count(len(baskets), 0.12), most)
    if most:
        listed = mining.maximal(mining.apriori(df, 0.12, most))
        assert got == sorted((tuple(r["items"]), r.n) for r in listed.collect())
        assert tuple(mining.maximal_overlap(found, mining.fpgrowth(df, 0.12, most)).first()) == (len(got),) * 3


def test_frequent_sets_that_could_not_be_listed(spark):
    names = [f"i{k:02d}" for k in range(60)]
    baskets = [names] * 30 + [[n for n in names if n != names[k]] for k in range(3)] + [["x", "y"]] * 20
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = sorted((len(r["items"]), r.n) for r in mining.maximal_search(df, 0.2).collect())
    assert got == [(2, 20), (60, 30)]  # 2^60 sets are frequent


def test_no_rows(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert mining.maximal_search(df, 0.1).collect() == []


@pytest.mark.parametrize("base", [20_000, 3])
def test_eclat_lists_what_apriori_lists(spark, base):
    rng = random.Random(5)
    baskets = [sorted(rng.sample("abcdefgh", rng.randrange(0, 7))) for _ in range(60)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    for most in (1, 2, 4):
        one, other = (sorted((tuple(r["items"]), r.n) for r in x.collect()) for x in (mining.eclat(df, 0.1, most, base), mining.apriori(df, 0.1, most)))
        assert one == other and len(one) > 3
    assert mining.eclat(df.limit(0), 0.1, 3).collect() == []
