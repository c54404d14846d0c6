"""Keys that occur once are neither shuffled nor sorted to find their latest row."""

from tallyforge.operators import prepare


def test_only_rows_of_repeated_keys_are_ranked(spark, monkeypatch):
    rows = spark.range(400).selectExpr("CAST(CASE WHEN id < 40 THEN id % 7 WHEN id < 390 THEN id END AS STRING) AS key", "CASE WHEN id < 380 THEN id % 5 END AS at", "id AS tie", "id * 2 AS v")
    found = {}
    for listed in (0, 7, 100):
        monkeypatch.setattr(prepare, "LISTED", listed)
        df = prepare.latest(rows, "key", "at", ("tie",))
        found[listed] = sorted(map(tuple, df.collect()))
        ranked = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x]
        assert df.columns == rows.columns and ranked
    best = {}
    for r in rows.where("key IS NOT NULL AND at IS NOT NULL").collect():
        best[r["key"]] = max(best.get(r["key"], (-1, -1, None)), (r["at"], r["tie"], tuple(r)))
    assert found[0] == found[7] == found[100] == sorted(x for *_, x in best.values()) and len(best) == 347
    unique = prepare.latest(rows.where("id >= 40"), "key", "at")
    assert "Window" not in unique._jdf.queryExecution().optimizedPlan().toString() and unique.count() == 340
