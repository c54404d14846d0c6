"""Hand-made cases of the operators."""

import subprocess
import sys

import pytest

from tallyforge.operators import mining, prepare, rules
from tallyforge.plans import closed_queries
from tallyforge.sources.contracts import CONTRACTS

BASKETS = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
RULE = "antecedents array<string>, consequent string, support double, confidence double, lift double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(x,) for x in BASKETS], "items array<string>")


@pytest.mark.parametrize("strategy", [mining.apriori, mining.fpgrowth, mining.eclat, mining.hybrid])
def test_strategies_agree(rows, strategy):
    found = {tuple(r["items"]): r["n"] for r in strategy(rows, 0.4, 3).collect()}
    assert found == {("a",): 4, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("a", "c"): 3, ("b", "c"): 3, ("a", "b", "c"): 2}


def test_maximal(rows):
    assert [r["items"] for r in mining.maximal(mining.apriori(rows, 0.4, 3)).collect()] == [["a", "b", "c"]]


def test_enriched_rule(spark):
    found = rules.enriched(spark.createDataFrame([(["a"], "t=1", 0.02, 0.5, 10.0), (["b"], "t=1", 0.02, 1.0, 10.0)], RULE))
    a, b = sorted(found.collect(), key=lambda r: r["confidence"])
    assert (a["consequent_prevalence"], a["conviction"], a["leverage"]) == (0.05, 1.9, 0.018)
    assert b["conviction"] is None


def test_longer_rules_with_equal_metrics_go(spark):
    made = [(["p=1"], "t=1", 0.1, 0.5, 2.0), (["p=1", "q=2"], "t=1", 0.1, 0.5, 2.0), (["q=2"], "t=1", 0.1, 0.6, 2.0)]
    left = rules.without_supersets(spark.createDataFrame(made, RULE)).collect()
    assert sorted(r["antecedents"] for r in left) == [["p=1"], ["q=2"]]


def test_jaccard_of_empty_sets(spark):
    none = spark.createDataFrame([], RULE)
    assert rules.jaccard(none, none).first()["jaccard"] == 1.0


def test_latest_row_of_a_key(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "x"), ("j", None, "y")], "key string, at int, v string")
    assert [tuple(r) for r in prepare.latest(df, "key", "at").collect()] == [("k", 2, "new")]


def test_freshness_is_not_imputed():
    with pytest.raises(ValueError):
        prepare.check_rules((prepare.Rule("creation_date", "categorical"),), CONTRACTS["complaints"])


@pytest.mark.parametrize("ties", [["b", "a"], ["a", "b"]])
def test_mode_takes_the_smallest_of_equals(spark, ties):
    df = spark.createDataFrame([(x,) for x in [*ties, None]], "v string")
    assert prepare.modes(df, "v").first()["mode_value"] == "a"


def entry(sql):
    return closed_queries.Entry("q", "1", "products", sql, (closed_queries.OWNER,), (closed_queries.Column("product_id", "string"),))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id OR 1 = 1 LIMIT 5",
        "SELECT product_id FROM {products} LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 500",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id; DROP TABLE x",
        "SELECT product_id FROM other WHERE customer_id = :customer_id LIMIT 5",
    ],
)
def test_closed_queries_reject(sql):
    with pytest.raises(closed_queries.Rejected):
        closed_queries.check_sql(entry(sql))


def test_the_owner_comes_from_the_session(spark):
    table = spark.createDataFrame([("1", "p"), ("2", "q")], "customer_id string, product_id string")
    own = entry("SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5")
    assert [r[0] for r in closed_queries.execute(spark, own, table, {}, {"customer_id": "2"}, "client").collect()] == ["q"]
    with pytest.raises(closed_queries.Rejected):
        closed_queries.execute(spark, own, table, {"customer_id": "1"}, {"customer_id": "2"}, "client")


def test_queries_are_listed_without_a_session():
    """Importing the entry points makes no column and no session."""
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1] == "True"
