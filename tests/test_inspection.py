"""Closed queries are judged by their plans."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import closed_queries as cq
from tallyforge.plans import inspection

COLUMN = (cq.Column("product_id", "string"),)


def entry(sql, columns=COLUMN, **more):
    return cq.Entry("q", "1", "products", sql, (cq.OWNER,), columns, **more)


def run(spark, e, table, owner="1"):
    return cq.execute(spark, e, table, {}, {"customer_id": owner}, "client")


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("products"))
    rows = spark.range(6000).select((F.col("id") % 50).cast("string").alias("customer_id"), F.sha2(F.col("id").cast("string"), 256).alias("product_id"), (F.col("id") % 3).alias("day"))
    rows.write.partitionBy("day").parquet(f"{folder}/t")
    return spark.read.parquet(f"{folder}/t")


@pytest.mark.parametrize(
    "sql",
    [
        # each of these satisfies the checks on the text
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id IS NOT NULL LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id = true LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id || '' LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id BETWEEN false AND true LIMIT 5",
        "SELECT DISTINCT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT max(product_id) AS product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT explode(array(product_id)) AS product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} TABLESAMPLE (50 PERCENT) WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} LATERAL VIEW explode(array(1, 2)) x AS y WHERE customer_id = :customer_id LIMIT 5",
        "SELECT product_id FROM {products} WHERE customer_id = :customer_id AND product_id > (TABLE {products} |> AGGREGATE max(product_id)) LIMIT 5",
        "SELECT max(product_id) FILTER (WHERE true) AS product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5",
        "SELECT first(product_id) AS product_id FROM {products} WHERE customer_id = :customer_id GROUP BY day LIMIT 5",
    ],
)
def test_the_plan_refuses_what_the_text_lets_through(spark, products, sql):
    try:
        cq.check_sql(entry(sql))
    except cq.Rejected:
        pytest.fail("this text should pass the first check")
    with pytest.raises(cq.Rejected) as refused:
        run(spark, entry(sql), products)
    assert refused.value.rule == "plan_not_allowed"


def test_plain_queries_pass(spark, products):
    sql = "SELECT p.product_id FROM {products} p WHERE customer_id = :customer_id AND day >= 1 ORDER BY day, product_id LIMIT 5"
    assert run(spark, entry(sql), products).count() == 5
    over = products.where("day < 2").join(products.select("customer_id").distinct(), "customer_id")  # what stands behind the table is its own affair
    assert run(spark, entry(sql), over).count() == 5


def test_a_filter_on_a_partition_lowers_the_bytes(spark, products):
    whole, one = (inspection.scan_bytes(products.where(c)) for c in ("true", "day = 1"))
    assert 0 < one < whole / 2
    sql = "SELECT product_id FROM {products} WHERE customer_id = :customer_id AND day = 1 LIMIT 5"
    assert run(spark, entry(sql, max_bytes=one), products).count() == 5
    for e in (entry(sql, max_bytes=one - 1), entry(sql.replace(" AND day = 1", ""), max_bytes=one)):
        with pytest.raises(cq.Rejected) as refused:
            run(spark, e, products)
        assert refused.value.rule == "bytes_over_budget"


def test_bytes_of_sources_without_files(spark, products, tmp_path):
    rows = spark.createDataFrame([("1", "p", 0)], products.schema.simpleString()[7:-1].replace(":", " "))
    sql = "SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5"
    assert inspection.scan_bytes(rows) == 0 and run(spark, entry(sql), rows).count() == 1
    stream = spark.sql("SELECT * FROM {p} WHERE day > (SELECT avg(day) FROM {p})", p=products)
    assert inspection.scan_bytes(stream) is None  # what a subquery reads is not known before it is planned
    with pytest.raises(cq.Rejected) as refused:
        run(spark, entry(sql), stream)
    assert refused.value.rule == "bytes_unknown"


def test_declared_columns_and_types(spark, products):
    sql = "SELECT product_id FROM {products} WHERE customer_id = :customer_id LIMIT 5"
    for columns, rule in (((cq.Column("other", "string"),), "schema_column_mismatch"), ((cq.Column("product_id", "bigint"),), "schema_type_mismatch")):
        with pytest.raises(cq.Rejected) as refused:
            run(spark, entry(sql, columns), products)
        assert refused.value.rule == rule
