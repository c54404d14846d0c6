"""Streams with state: restarted in the middle they equal the batch rows."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tallyforge.operators import evaluation, sampling
from tallyforge.streaming import stateful

START = dt.datetime(2026, 1, 1)


def test_history_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(t, n, rng.choice("ab"), f"t{n}") for t in range(12) for n in range(rng.randrange(1, 60))] + [(None, 3, "a", "x"), (1, None, "a", None)]
    rng.shuffle(rows)
    schema = "thread long, turn long, role string, text string"
    for i in range(3):
        spark.createDataFrame(rows[i::3] + rows[:5], schema).write.mode("append").parquet(f"{tmp_path}/in")
        made = stateful.bounded_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stateful.run(made, f"{tmp_path}/out", f"{tmp_path}/check")
    got = stateful.current(spark, f"{tmp_path}/out", "thread").select("thread", "turn", "role", "text")
    want = sampling.last_turns(spark.createDataFrame(rows, schema).where("turn IS NOT NULL AND thread IS NOT NULL").distinct(), "thread", "turn").select("thread", "turn", "role", "text")
    assert sorted(map(tuple, got.where("thread IS NOT NULL").collect())) == sorted(map(tuple, want.collect()))
    assert want.groupBy("thread").count().agg(F.max("count")).first()[0] == 20


def test_turns_are_forgotten(spark, tmp_path):
    schema = "thread long, turn long, role string, text string"
    for i, rows in enumerate(([(1, 1, "a", "x"), (1, 2, "b", "y")], [(1, 3, "a", "z")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.run(stateful.bounded_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), seconds=2), f"{tmp_path}/out", f"{tmp_path}/check")
        time.sleep(3 * (i == 0))
    assert [r.turn for r in stateful.current(spark, f"{tmp_path}/out", "thread").collect()] == [3]


def test_escalations_equal_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(25), START + dt.timedelta(minutes=rng.randrange(300)), i, rng.choice(["request", "approve", "deny", "note"])) for i in range(120)]
    schema = "case_id long, time timestamp, seq long, event string"
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.run(stateful.escalations(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
    got = stateful.current(spark, f"{tmp_path}/out", "case_id").select("case_id", "state")
    batch = spark.createDataFrame(rows, schema).select("case_id", F.struct("time", "seq").alias("at"), "event")
    want = evaluation.escalation_states(batch).select("case_id", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped_and_waiting_decisions_let_go(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    parts = [
        [(1, at(0), 1, "approve"), (2, at(1), 2, "deny")],
        [(3, at(50), 3, "note")],  # the watermark passes what came before
        [(3, at(51), 4, "note")],
        [(1, at(-1), 5, "request"), (2, at(52), 6, "request")],  # too late; and a request after its decision
    ]
    schema = "case_id long, time timestamp, seq long, event string"
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.run(stateful.escalations(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.case_id: r.state for r in stateful.current(spark, f"{tmp_path}/out", "case_id").collect()}
    assert got == {1: "open", 2: "pending_approval", 3: "open"}
