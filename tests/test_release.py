"""Hand-made cases of validation, graph, gate, baselines, closed queries and text functions."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import bayes, evaluation, graph, mining, prepare, rules, sampling
from tallyforge.plans import closed_queries as cq, inspection
from tallyforge.sources import contracts

RULE = "antecedents array<string>, consequent string, support double, confidence double, lift double"


def made(spark, *rows):
    return spark.createDataFrame([(a, c, *m) for a, c, *m in rows], RULE)


def test_strategies_that_disagree_are_an_error(spark):
    a = made(spark, (["p=1"], "t=1", 0.1, 0.5, 2.0), (["q=1"], "t=1", 0.1, 0.5, 2.0))
    b = made(spark, (["p=1"], "t=1", 0.1, 0.6, 2.0))
    assert rules.consensus(a, b).count() == 0
    with pytest.raises(ValueError):
        rules.strict_consensus(a, b)
    assert rules.strict_consensus(a, a.limit(1)).count() == 1
    rows = spark.createDataFrame([(["a", "b"],), (["a"],)], "items array<string>")
    with pytest.raises(ValueError):
        mining.assert_parity(mining.apriori(rows, 0.5, 2), mining.apriori(rows, 0.9, 2))


def test_jaccard_of_many_sets(spark):
    one, two = made(spark, (["p=1"], "t=1", 0.1, 0.5, 2.0)), made(spark, (["p=1"], "t=1", 0.2, 0.5, 2.0), (["q=1"], "t=1", 0.1, 0.5, 2.0))
    assert tuple(rules.multi_jaccard([one, two, two]).first()) == (1, 2, 0.5)
    assert rules.multi_jaccard([one.limit(0), one.limit(0)]).first()["jaccard"] == 1.0
    assert [r["antecedents"] for r in rules.ordered(two.withColumn("lift", F.when(F.col("support") > 0.1, 3.0).otherwise(2.0))).collect()] == [["p=1"], ["q=1"]]


def test_hybrid_is_not_another_strategy_and_agrees(spark):
    import random

    rng = random.Random(2)
    baskets = [(sorted(rng.sample("abcdefgh", rng.randrange(1, 7))),) for _ in range(300)]
    rows = spark.createDataFrame(baskets, "items array<string>")
    want = {}
    from itertools import combinations

    for (b,) in baskets:
        for k in range(1, 5):
            for c in combinations(b, k):
                want[c] = want.get(c, 0) + 1
    want = {c: n for c, n in want.items() if n >= 15}
    assert {tuple(r["items"]): r["n"] for r in mining.hybrid(rows, 0.05, 4).collect()} == want
    mining.assert_parity(mining.hybrid(rows, 0.05, 4), mining.eclat(rows, 0.05, 4))


def test_graph_checks(spark):
    edges = lambda *pairs: spark.createDataFrame(pairs, "source string, target string")
    assert graph.is_acyclic(edges(("a", "b"), ("b", "c"), ("a", "c")))
    assert not graph.is_acyclic(edges(("a", "b"), ("b", "c"), ("c", "b")))
    assert graph.is_acyclic(edges(("a", "b")).limit(0))
    nodes = spark.createDataFrame([("x", "feature"), ("x", "rule"), ("y", "rule")], "id string, kind string")
    assert [r["id"] for r in graph.conflicts(nodes).collect()] == ["x"]
    catalog = spark.createDataFrame([("p=1",), ("q=1",), ("t=1",)], "item string")
    good = (["p=1", "q=1"], "t=1", 0.1, 0.5, 2.0)
    assert graph.checked_consensus(made(spark, good), catalog).count() == 1
    for bad in ((["q=1", "p=1"], "t=1", 0.1, 0.5, 2.0), (["p=2"], "t=1", 0.1, 0.5, 2.0), (["p=1"], "t=1", 1.1, 0.5, 2.0), (["p=1"], "t=1", 0.1, 0.5, float("inf")), ([], "t=1", 0.1, 0.5, 2.0)):
        with pytest.raises(ValueError):
            graph.checked_consensus(made(spark, good, bad), catalog)
    for rows in ((good, good), ()):
        with pytest.raises(ValueError):
            graph.checked_consensus(made(spark, *rows), catalog)
    assert graph.canonical_rule_id("p", ["a=1"], "t=1", 0.1, 0.5, 2.0) == graph.with_rule_id(made(spark, (["a=1"], "t=1", 0.1, 0.5, 2.0)), "p").first()["rule_id"]


def test_runs_that_are_not_what_their_manifest_says(spark):
    nodes = spark.createDataFrame([], "id string, kind string, population string, feature string, value string")
    edges = spark.createDataFrame([], "source string, target string, relation string")
    runs = lambda *r: spark.createDataFrame(r, "case_id string, run_id string, sha256 string, manifest_sha256 string")
    assert graph.with_cases(nodes, edges, runs(("C1", "r", "a", "a")))[0].count() == 9
    for bad in (("C1", "r", "a", "b"), ("C7", "r", "a", "a"), ("C9", "r", "a", "a"), ("C1", "r", None, "a")):
        with pytest.raises(ValueError):
            graph.with_cases(nodes, edges, runs(bad))


def test_gate(spark):
    a = made(spark, (["p=1"], "t=1", 0.1, 0.5, 2.0))
    b = made(spark, (["q=1"], "t=1", 0.1, 0.5, 2.0))
    counts = lambda n: spark.createDataFrame([("x", n)], "population string, row_count long")
    near, far = graph.row_deltas(counts(100), counts(105)), graph.row_deltas(counts(100), counts(300))
    assert near.first()["ratio"] == 0.05
    ok = graph.gate(graph.difference(a, a), near).first()
    assert ok["passed"] and ok["jaccard"] == 1.0
    assert not graph.gate(graph.difference(a, a), far).first()["passed"]
    other = graph.gate(graph.difference(a, b), near).first()
    assert (other["passed"], other["added"], other["removed"]) == (False, 1, 1)
    held = spark.createDataFrame([("x", True), ("x", False), ("x", False)], "population string, stable boolean")
    assert not graph.gate(graph.difference(a, a), near, held).first()["passed"]


ENTRY = dict(query_id="q", version="1", table="products", parameters=(cq.OWNER,), columns=(cq.Column("product_id", "string"),))
SQL = "SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5"


def test_a_query_over_the_byte_cap_does_not_run(spark, tmp_path):
    spark.createDataFrame([("1", "p")], "customer_id string, product_id string").write.parquet(f"{tmp_path}/products")
    table = spark.read.parquet(f"{tmp_path}/products")
    run = lambda most: cq.execute(spark, cq.Entry(sql=SQL, max_bytes=most, **ENTRY), table, {}, {"customer_id": "1"}, "client")
    assert run(10**6).count() == 1 and inspection.scan_bytes(table) > 10
    with pytest.raises(cq.Rejected):
        run(10)


@pytest.mark.parametrize(
    "sql",
    [
        "DELETE FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id -- note\nLIMIT 5",
        "SELECT product_id FROM {products} /* note */ WHERE customer_id = :customer_id LIMIT 5",
        "WITH x AS (SELECT 1) SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id UNION SELECT product_id FROM {products} LIMIT 5",
        "SELECT product_id FROM {products} JOIN other WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE product_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id AND product_id = :other LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id",
    ],
)
def test_shapes_that_are_rejected_and_take_the_catalog_with_them(sql):
    good = cq.Entry(sql=SQL, **ENTRY)
    with pytest.raises(cq.Rejected):
        cq.load([good, cq.Entry(sql=sql, **{**ENTRY, "version": "2"})])
    with pytest.raises(cq.Rejected):
        cq.load([good, good])
    assert cq.listing(cq.load([good]), "client") == ["q@1"] and cq.listing(cq.load([good]), "guest") == []


@pytest.mark.parametrize(
    "parameter, value",
    [
        (cq.Parameter("x", "identifier"), "a b"), (cq.Parameter("x", "identifier"), "a" * 65), (cq.Parameter("x", "int"), True), (cq.Parameter("x", "int", 1, 5), 6),
        (cq.Parameter("x", "float", 0.5), 0.1), (cq.Parameter("x", "date"), "2024-02-30"), (cq.Parameter("x", "string", allowed=("a",)), "b"), (cq.Parameter("x", "bool"), 1),
    ],
)
def test_values_that_do_not_bind(parameter, value):
    entry = cq.Entry(sql=SQL, **{**ENTRY, "parameters": (cq.OWNER, parameter)})
    with pytest.raises(cq.Rejected):
        cq.bind(entry, {"x": value}, {"customer_id": "1"})
    with pytest.raises(cq.Rejected):
        cq.bind(entry, {}, {"customer_id": "1"})


def test_values_that_bind():
    entry = cq.Entry(sql=SQL, **{**ENTRY, "parameters": (cq.OWNER, cq.Parameter("n", "int", 1, 5), cq.Parameter("day", "date"))})
    found = cq.bind(entry, {"n": 5, "day": "2024-02-29"}, {"customer_id": "a-1"})
    assert found["n"] == 5 and found["day"].isoformat() == "2024-02-29"


def test_evidence_carries_the_highest_class(spark):
    entry = cq.Entry(sql=SQL, max_rows=2, **{**ENTRY, "columns": (cq.Column("a", "string"), cq.Column("b", "double", "financial"))})
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "a string, b double")
    assert cq.evidence(entry, rows.limit(2))["classification"] == "financial"
    with pytest.raises(cq.Rejected):
        cq.evidence(entry, rows)


def test_older_plans(spark):
    table = spark.createDataFrame([("t", str(i)) for i in range(20)] + [("u", "0")], "tenant_id string, k string")
    plan = cq.Plan("p", "rows", "SELECT k FROM {rows} WHERE tenant_id = :tenant_id AND k >= :low", ("low",))
    assert cq.execute_plan(spark, plan, table, {"low": "0"}, "t").count() == 8
    for given in ({}, {"low": "0", "more": "1"}):
        with pytest.raises(cq.Rejected):
            cq.execute_plan(spark, plan, table, given, "t")
    for bad in ("SELECT k FROM {rows} WHERE k >= :low", "SELECT * FROM {rows} WHERE tenant_id = :tenant_id AND k >= :low", "SELECT k FROM other WHERE tenant_id = :tenant_id AND k >= :low"):
        with pytest.raises(cq.Rejected):
            cq.check_plan(cq.Plan("p", "rows", bad, ("low",)))


def test_naive_bayes_with_population_priors_and_weights(spark):
    rows = [(str(i), i % 2 == 0, "channel", "APP" if i % 2 == 0 else "BRANCH") for i in range(4)]
    records = spark.createDataFrame(rows, "key string, label boolean, feature string, value string")
    found = {r["key"]: r["probability"] for r in bayes.predict(records, *bayes.fit(records, population={True: 10, False: 90})).where("class").collect()}
    assert found["0"] > found["1"]
    prior = {r["label"]: r["log_prior"] for r in bayes.fit(records, population={True: 10, False: 90})[0].collect()}
    assert math.isclose(math.exp(prior[True]), 11 / 102)


def test_platt_is_the_optimum_of_its_objective(spark):
    data = [(True, 0.9, 3.0), (True, 0.6, 3.0), (False, 0.4, 1.0), (False, 0.7, 1.0), (True, 0.3, 2.0), (False, 0.1, 1.0)]
    scored = spark.createDataFrame(data, "label boolean, probability double, w double")
    for weight in ("w", None):
        a, b = bayes.platt(scored, weight)
        c = [(math.log(p / (1 - p)), y, w if weight else 1.0) for y, p, w in data]
        x, y0 = 0.0, 0.0  # Newton on slope and intercept of the weighted logistic loss with next to no penalty
        for _ in range(50):
            g = [x / 1e6, 0.0]
            h = [[1 / 1e6, 0.0], [0.0, 0.0]]
            for t, y, w in c:
                p = 1 / (1 + math.exp(-(x * t + y0)))
                g[0] += w * (p - y) * t
                g[1] += w * (p - y)
                h[0][0] += w * p * (1 - p) * t * t
                h[0][1] += w * p * (1 - p) * t
                h[1][1] += w * p * (1 - p)
            det = h[0][0] * h[1][1] - h[0][1] ** 2
            x, y0 = x - (h[1][1] * g[0] - h[0][1] * g[1]) / det, y0 - (h[0][0] * g[1] - h[0][1] * g[0]) / det
        assert math.isclose(a, x, rel_tol=1e-4) and math.isclose(b, y0, rel_tol=1e-4, abs_tol=1e-5)


def test_average_precision_over_many_partitions(spark):
    import random

    rng = random.Random(1)
    data = [(rng.random() < 0.3, round(rng.random(), 2), rng.choice([1.0, 2.5])) for _ in range(400)]
    scored = spark.createDataFrame(data, "label boolean, probability double, w double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = bayes.binary_metrics(scored, "w").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    positive = sum(w for y, _, w in data if y)
    area = all_ = hit = 0.0
    for p in sorted({p for _, p, _ in data}, reverse=True):
        new = sum(w for y, q, w in data if y and q == p)
        all_ += sum(w for _, q, w in data if q == p)
        hit += new
        area += new * hit / all_
    assert math.isclose(found["pr_auc"], area / positive, abs_tol=1e-6)


def test_quotas_and_splits(spark):
    assert sampling.quotas(500, 200, 800) == (100, 400)
    for bad in ((500, 0, 800), (500, 100, 100)):
        with pytest.raises(ValueError):
            sampling.quotas(*bad)
    rows = spark.range(10).selectExpr("CAST(concat('2023-0', 1 + id % 9, '-15') AS TIMESTAMP_NTZ) AS t")
    early, late = sampling.split(rows, "t", "2023-01-01", "2023-10-01", 0.2)
    assert early.count() + late.count() == 10 and early.count() and late.count()


def test_strict_twin_keeps_the_last_of_equals(spark):
    rows = spark.createDataFrame([("k", 1, 0, "a"), ("k", 2, 1, "b"), ("k", 2, 2, "c"), ("j", 1, 3, "d")], "key string, at int, n int, v string")
    assert sorted(r["v"] for r in prepare.last_of_key(rows, "key", "at", "n").collect()) == ["c", "d"]
    with pytest.raises(ValueError):
        prepare.last_of_key(rows.withColumn("key", F.when(F.col("n") > 0, F.col("key"))), "key", "at", "n")


def test_schema_drift(spark):
    contract = contracts.CONTRACTS["satisfaction_surveys"]
    good = spark.createDataFrame([], "survey_id string, interaction_id string, survey_date timestamp, main_score bigint, more string")
    assert contracts.require_valid(good, contract) is good
    for bad in (good.drop("survey_date"), good.withColumn("main_score", F.lit("x"))):
        with pytest.raises(ValueError):
            contracts.require_valid(bad, contract)
    assert contracts.schema_hash(good) == contracts.schema_hash(good.select(*reversed(good.columns)))


def test_text_functions_match_plain_python(spark):
    texts = ["ﬁne ½ Ａ", "Qué es este cargo", "Quiero HABLAR con un asesor", "hola", "quiero abrir uma disputa", "me estafaron", "el clima de hoy", "saldo 12", None, "", "una pregunta larga"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", T.nfkc("t").alias("n"), T.folded("t").alias("f")).withColumn("intent", T.intent(F.col("f"))).orderBy("i").collect()

    def plain(t):
        if t is None:
            return "answerable"
        has = lambda lists: any(re.search(p, t) for p in lists)
        if has(T.OUT_OF_DOMAIN):
            return "out_of_domain"
        if has(T.HUMAN + T.CLAIM):
            return "escalate"
        if 0 < len(t.strip()) < 8 and not re.search(r"\d", t):
            return "ambiguous"
        return "ledger" if has(T.LEDGER) else "answerable"

    for r in rows:
        want = None if r["t"] is None else "".join(c for c in unicodedata.normalize("NFD", r["t"].lower()) if not "̀" <= c <= "ͯ")
        assert r["n"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"])) and r["f"] == want
        assert r["intent"] == plain(want)


def test_totals_and_completeness(spark):
    results = spark.createDataFrame([(True,), (False,), (None,)], "passed boolean")
    assert tuple(evaluation.matrix_totals(results).first()) == (3, 1, 2)
    runs = spark.createDataFrame([("r", "baseline", *[None] * len(evaluation.COMPLETENESS))], "run_id string, pipeline string, " + ", ".join(f"{c} boolean" for c in evaluation.COMPLETENESS))
    assert evaluation.completeness(runs).where("passed").count() == 0
