"""Every row of the sink is there once."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import inspection
from tallyforge.sources import sink


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/r"


def results(spark, run, low, high, **change):
    rows = spark.range(low, high).select(
        F.lit(f"run-{run:08d}").alias("run_id"), F.col("id").cast("string").alias("fixture_id"), F.lit("r").alias("route"), F.lit("m").alias("metric"), F.lit("e").alias("evaluator"),
        F.lit(0.5).alias("score"), F.lit(True).alias("passed"), F.lit("llm").alias("mode"), F.lit("informational").alias("gate"),
    )
    return rows.withColumns({k: F.lit(v) for k, v in change.items()})


def ids(spark, root):
    return sorted(r[0] for r in spark.read.parquet(root).select("insert_id").collect())


def test_replays_and_partial_failures_leave_each_id_once(spark, root):
    rows = results(spark, 1, 0, 40)
    assert sink.write_once(rows, root) == sink.Outcome("ok", 40, 40)
    assert sink.write_once(rows, root) == sink.Outcome("ok", 40, 0)
    assert sink.write_once(rows.unionAll(results(spark, 1, 30, 60)), root) == sink.Outcome("ok", 70, 20)
    # a commit that moved some of its files and died
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root[7:]) for f in names if f.endswith(".parquet"))
    os.remove(files[0])
    again = sink.write_once(results(spark, 1, 0, 60), root)
    assert again.status == "ok" and again.written > 0 and len(set(ids(spark, root))) == len(ids(spark, root)) == 60


@pytest.mark.parametrize("change", [{"score": 1.5}, {"score": None}, {"score": float("nan")}, {"run_id": "short"}, {"gate": "blocking"}, {"mode": "x"}, {"route": None}, {"passed": None}])
def test_one_invalid_row_and_nothing_is_written(spark, root, change):
    rows = results(spark, 1, 0, 5).unionByName(results(spark, 1, 5, 6, **{k: v for k, v in change.items() if v is not None}).withColumns({k: F.lit(None).cast("string") for k, v in change.items() if v is None}))
    assert sink.write_once(rows, root) == sink.Outcome("failed", 6, 0, "sink_invalid_record")
    assert not os.path.exists(root[7:])


def test_lookups_read_their_own_folders(spark, root):
    for run in range(3):
        sink.write_once(results(spark, run, 0, 50), root)
    first = "run-00000000"
    own = spark.range(1).select(sink.bucket_of(F.lit(first))).first()[0]
    before = inspection.scan_bytes(sink.lookup(spark, root, "run_id", [own], [first]))
    others = [run for run in range(3, 40) if spark.range(1).select(sink.bucket_of(F.lit(f"run-{run:08d}"))).first()[0] != own][:6]
    for run in others:
        sink.write_once(results(spark, run, 0, 500), root)
    found = sink.lookup(spark, root, "run_id", [own], [first])
    assert inspection.scan_bytes(found) == before and found.count() == 50
    assert "In(run_id" in found._jdf.queryExecution().toString() or "EqualTo(run_id" in found._jdf.queryExecution().toString()


def test_failures_have_codes_and_no_messages(spark, root, tmp_path):
    (tmp_path / "r").write_text("a file")
    outcome = sink.write_once(results(spark, 1, 0, 5), root)
    assert outcome.status == "failed" and outcome.written == 0 and outcome.reason in {*sink.REASONS, "sink_unavailable"}
    assert sink._reason(PermissionError("Permission denied: secret")) == "sink_permission_denied"
    assert sink._reason(RuntimeError("secret")) == "sink_unavailable"
    assert sink.write_once(results(spark, 1, 0, 5).select("run_id"), root).reason in {*sink.REASONS, "sink_unavailable"}
    assert stat.S_ISREG(os.stat(tmp_path / "r").st_mode)


def test_repeated_rows_of_a_batch_and_empty_batches(spark, root):
    rows = results(spark, 1, 0, 5)
    assert sink.write_once(rows.unionAll(rows.withColumn("score", F.lit(0.25))), root) == sink.Outcome("ok", 10, 5)
    assert sink.write_once(rows.limit(0), root) == sink.Outcome("ok", 0, 0)
    assert sink.as_row(spark, sink.Outcome("ok", 1, 1)).first()["written"] == 1
