"""Files, packages and streams: what goes wrong and what is repeated."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import profile, quantiles
from tallyforge.sources import artifacts, files
from tallyforge.streaming import ingest


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def test_tables_are_found_by_folder_or_stem(spark, tmp_path, root):
    for name in ("orders/year=2023/a.csv", "orders/b.CSV", "people.csv", "notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n1\n")
    found = files.discover_csv(spark, root)
    assert {k: len(v) for k, v in found.items()} == {"orders": 2, "people": 1}
    assert list(files.select_tables(found, ["people"])) == ["people"]
    with pytest.raises(ValueError):
        files.select_tables(found, ["absent"])
    (tmp_path / "no-name.csv").write_text("x\n")
    with pytest.raises(ValueError):
        files.discover_csv(spark, root)


def test_malformed_lines(spark, tmp_path, root):
    (tmp_path / "t.csv").write_text("a,b\n1,x\nnot a number,y\n3,z\n")
    read = lambda most: files.read_csv(spark, [f"{root}/t.csv"], schema=spark.createDataFrame([], "a int, b string").schema, max_bad_records=most)
    assert sorted(map(tuple, read(1).collect())) == [(1, "x"), (3, "z")]
    with pytest.raises(ValueError):
        read(0)
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "year=2024").mkdir()
    (tmp_path / "u" / "year=2024" / "p.csv").write_text("a\n5\n")
    assert [tuple(r) for r in files.read_csv(spark, [f"{root}/u/year=2024"], base=f"{root}/u").collect()] == [(5, 2024)]


def test_a_file_is_copied_once(spark, tmp_path, root):
    (tmp_path / "a").write_text("one")
    assert files.copy_once(spark, f"{root}/a", f"{root}/b") == "copied"
    assert files.copy_once(spark, f"{root}/a", f"{root}/b") == "present"
    (tmp_path / "a").write_text("longer")
    assert files.copy_once(spark, f"{root}/a", f"{root}/b") == "size_differs" and (tmp_path / "b").read_text() == "one"


def test_append_is_repeatable(spark, root):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a"), (2, None)], "k int, v string")
    for _ in range(2):
        files.append_new(rows, f"{root}/t", ["k"])
    assert spark.read.parquet(f"{root}/t").count() == 3
    files.append_new(spark.createDataFrame([(1, "new")], "k int, v string"), f"{root}/t", ["k"], since=F.col("v") == "none")
    assert spark.read.parquet(f"{root}/t").count() == 4


def test_audit_rows_are_whole(spark, root):
    row = {"run_id": "r", "contract_version": "1", "table": "t", "source_rows": 1, "curated_rows": 1, "schema_hash": "h", "manifest": "m"}
    files.append_audit(spark, f"{root}/audit", row)
    with pytest.raises(ValueError):
        files.append_audit(spark, f"{root}/audit", row | {"manifest": None})
    assert spark.read.parquet(f"{root}/audit").count() == 1


def test_packages(spark, tmp_path, root):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert artifacts.checksum(rows) == artifacts.checksum(rows.orderBy(F.desc("k")).repartition(3))
    assert artifacts.checksum(rows) != artifacts.checksum(rows.unionAll(rows.limit(1)))
    artifacts.write_package({"nodes": rows}, root, "v1", {"from": "x"})
    with pytest.raises(artifacts.Invalid):
        artifacts.write_package({"nodes": rows}, root, "v1")
    with pytest.raises(artifacts.Invalid):
        artifacts.current(spark, root)
    assert artifacts.promote(spark, root, "v1") == {"current": "v1", "previous": None}
    artifacts.write_package({"nodes": rows.limit(1)}, root, "v2")
    with pytest.raises(artifacts.Invalid):
        artifacts.promote(spark, root, "v2", expected=None)
    artifacts.promote(spark, root, "v2", expected="v1")
    assert artifacts.current(spark, root)["nodes"].count() == 1
    artifacts.write_package({"nodes": rows}, root, "v3")
    artifacts.promote(spark, root, "v3", expected="v2")
    assert artifacts.retain(spark, root) == ["v1"] and artifacts.versions(spark, root) == ["v2", "v3"]
    assert artifacts.rollback(spark, root)["current"] == "v2"
    with pytest.raises(artifacts.Invalid):
        artifacts.rollback(spark, root)
    rows.write.mode("append").parquet(f"{root}/packages/v2/nodes")
    with pytest.raises(artifacts.Invalid):
        artifacts.current(spark, root)
    with pytest.raises(artifacts.Invalid):
        artifacts.read_package(spark, root, "v3", provenance={"from": "y"})
    assert not list(tmp_path.glob("*.tmp"))


def test_a_small_file_is_replaced_whole(spark, tmp_path, root):
    for text in (b"first", b"second"):
        artifacts.write_file(spark, f"{root}/x.json", text)
        assert artifacts.read_file(spark, f"{root}/x.json") == text
    assert artifacts.canonical_json({"b": 1, "a": [1.5, None, "é"]}) == '{"a":[1.5,null,"é"],"b":1}'.encode()
    with pytest.raises(ValueError):
        artifacts.canonical_json(float("nan"))


def test_settings_have_closed_keys():
    known = {"mine.support": float, "mine.length": int}
    assert artifacts.settings("[mine]\nsupport = 0.01\nlength = 4\n", known) == {"mine.support": 0.01, "mine.length": 4}
    for text in ("[mine]\nsupport = 0.01\n", "[mine]\nsupport = 0.01\nlength = 4\nmore = 1\n", "[mine]\nsupport = 'x'\nlength = 4\n"):
        with pytest.raises(artifacts.Invalid):
            artifacts.settings(text, known)


def test_lineage_and_reports(spark, tmp_path, root):
    source = spark.createDataFrame([("k", "2024-01-02"), ("k", "2024-01-01")], "k string, at string")
    found = artifacts.lineage_manifest(source, source.limit(1), "at", ["x"])
    assert found["source"]["rows"] == 2 and found["freshness_watermark"] == "2024-01-02"
    assert found == artifacts.lineage_manifest(source, source.limit(1), "at", ["x"])
    results = spark.createDataFrame([("m", True), ("n", False)], "metric string, passed boolean")
    assert artifacts.write_report(results, f"{root}/report") == {"failed": 1, "passed": 1, "results": 2}
    assert json.loads((tmp_path / "report" / "summary.json").read_text())["failed"] == 1


def test_a_stream_takes_each_row_once(spark, tmp_path, root):
    (tmp_path / "in").mkdir()
    line = lambda i, t: json.dumps({"id": i, "at": t}) + "\n"
    (tmp_path / "in" / "a.json").write_text(line(1, "2024-01-01 10:00:00") + line(1, "2024-01-01 10:00:00") + line(2, "2024-01-01 10:05:00"))
    for _ in range(2):
        ingest.ingest(ingest.read_increment(spark, f"{root}/in", "id long, at string", "at", ["id"]), f"{root}/out", f"{root}/checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2]
    (tmp_path / "in" / "b.json").write_text(line(2, "2024-01-01 10:05:00") + line(3, "2024-01-01 10:20:00"))
    ingest.ingest(ingest.read_increment(spark, f"{root}/in", "id long, at string", "at", ["id"]), f"{root}/out", f"{root}/checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3]


def test_a_repeated_batch_replaces_what_it_left(spark, root):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    for df in (rows.limit(1), rows):
        files.append_batch(df, f"{root}/out", 7)
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_windows_of_a_stream(spark, root):
    rows = spark.createDataFrame([("2024-01-01 10:01:00",), ("2024-01-01 10:14:00",), ("2024-01-01 10:16:00",)], "at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    query = ingest.windowed_volume(stream, "at").writeStream.format("memory").queryName("volume").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("volume").collect()) == [1, 2]


@pytest.mark.parametrize("left", [10**6, 50, 5])
def test_quantiles_of_large_tables_are_exact(spark, left):
    import random

    rng = random.Random(left)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random() * 100, 7.0, float(rng.randrange(5)), None])) for _ in range(700)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = (0.0, 0.25, 0.5, 0.9, 1.0)
    for by in (["g"], []):
        want = {tuple(r[c] for c in by): r["q"] for r in quantiles.quantiles(df, by, "v", probabilities).collect()}
        got = {tuple(r[c] for c in by): r["q"] for r in quantiles.quantiles(df, by, "v", probabilities, rows=0, left=left).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == (None if want[k] is None else pytest.approx(want[k]))


def test_key_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert tuple(profile.key_profile(df, "k").first()) == (3, 1, 1)
