"""Orders, digests, surfaces, sketches, unions, package differences and hierarchies against plain Python."""

import base64
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import digests, ordinals, surfaces
from tallyforge.functions.text import MASKS
from tallyforge.operators import rules, sketches
from tallyforge.plans import inspection
from tallyforge.sources import artifacts, unions


def test_ordinals_have_no_gaps_and_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice("abc"), i % 40) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    found = sorted(ordinals.with_ordinals(df, [(F.col("a"), True), (F.col("b"), False)]).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in found] == list(range(500))
    keys = [(-1 if r.a is None else r.a, -ord(r.b)) for r in found]
    assert keys == sorted(keys) and sorted((r.a or 0, r.b, r.c) for r in found) == sorted((a or 0, b, c) for a, b, c in rows)
    assert ordinals.with_ordinals(df.limit(0), [(F.col("a"), True)]).collect() == []


def test_a_digest_depends_on_order_and_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "FAN", 4)
    rows = [(i, f"t{i}") for i in range(90)]
    make = lambda rows, parts: ordinals.ordered_digest(spark.createDataFrame(rows, "n int, t string").repartition(parts), [(F.col("n"), True)], F.col("t"))
    level = [hashlib.sha256(t.encode()).hexdigest() for _, t in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert make(rows, 1) == make(rows[::-1], 5) == level[0]
    swapped = [(n, {3: "t4", 4: "t3"}.get(n, t)) for n, t in rows]
    assert make(swapped, 3) != level[0] and make(rows[:-1], 3) != level[0]
    assert make([], 1) == ""


def test_hmac_and_base64url(spark):
    rng = random.Random(2)
    texts = ["", "é", "x" * 500, *["".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(90))) for _ in range(40)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"", b"k", rng.randbytes(64), rng.randbytes(65), rng.randbytes(200)):
        got = {r.t: (bytes(r.m), r.u) for r in df.select("t", digests.hmac_sha256(F.col("t"), key).alias("m"), digests.base64url(digests.hmac_sha256(F.col("t"), key)).alias("u")).collect()}
        for t in texts:
            want = hmac.new(key, t.encode(), hashlib.sha256).digest()
            assert got[t] == (want, base64.urlsafe_b64encode(want).decode().rstrip("="))
    row = spark.createDataFrame([(2, "a\"b", None)], "z int, a string, n string").select(digests.canonical_json("z", "n", "a").alias("j"), digests.keyed_digest(b"k", "z", "a").alias("d")).first()
    body = json.dumps({"z": 2, "a": 'a"b'}, sort_keys=True, separators=(",", ":"))
    assert row.j == body and row.d == base64.urlsafe_b64encode(hmac.new(b"k", body.encode(), hashlib.sha256).digest()).decode().rstrip("=")
    assert spark.range(1).select(digests.hmac_sha256(F.lit(None).cast("string"), b"k")).first()[0] is None


def brute_surfaces(text):
    n, entries = max([0, *map(int, re.findall(r"\[\[PII_INPUT_(\d{1,15})\]\]", text))]), []
    for pattern, safe in MASKS:
        def token(match):
            nonlocal n
            n += 1
            entries.append((f"[[PII_INPUT_{n}]]", safe, match[0]))  # noqa: B023
            return entries[-1][0]

        text = re.sub(pattern, token, text, flags=re.A)
    return text, entries


def test_surfaces_are_numbered_and_restored(spark):
    parts = ["ana@mail.pe", "+51 987 654 321", "123456789012", "call", "x@y.z", "[[PII_INPUT_7]]", "5 de mayo", "é", "555-1234-5678", "A.B@C-D.ORG", "", "\n"]
    rng = random.Random(3)
    texts = ["", *parts, *[" ".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(80)]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", surfaces.numbered(F.col("t"), "input").alias("m"))
    for r in df.select("t", "m", surfaces.restored(F.col("m")).alias("back"), surfaces.safe(F.col("m")).alias("safe")).collect():
        assert r.back == r.t
        if r.t is not None:
            want, entries = brute_surfaces(r.t)
            assert (r.m.content, [(e.token, e.safe_value, e.original) for e in r.m.replacements]) == (want, entries)
            assert "@mail" not in r.safe


def test_sketches_keep_to_their_error(spark):
    rng = random.Random(4)
    rows = [(f"2024-{rng.randrange(1, 7):02d}-11", rng.choice([None, rng.gauss(0, 9), rng.random() ** 9, 5.0])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.to_date("d"))
    merged = sketches.over_windows(sketches.monthly(df, "d", "v"), 3)
    found = merged.select("month", *[sketches.quantile(F.col("sketch"), p).alias(c) for c, p in (("a", 0.1), ("b", 0.9))])
    off = sketches.rank_error(df, "d", "v", found, 3, {"a": 0.1, "b": 0.9}).collect()
    assert len(off) == 6 and all(max(r.a, r.b) <= sketches.RANK_ERROR for r in off)
    wrong = sketches.rank_error(df, "d", "v", found.withColumn("a", F.col("b")), 3, {"a": 0.1}).collect()
    assert min(r.a for r in wrong) > 10 * sketches.RANK_ERROR
    assert sketches.rank_error(df.limit(0), "d", "v", found, 3, {"a": 0.1}).collect() == []


def test_relaxed_unions(spark):
    a = spark.createDataFrame([(1, 2.5, [1], (1, "x"))], "i tinyint, f float, l array<int>, s struct<p: int, q: string>")
    b = spark.createDataFrame([(2**40, None, [2**40], (2**40, 3))], "i bigint, f void, l array<bigint>, s struct<p: bigint, r: int>").withColumn("more", F.lit("m"))
    out = unions.relaxed_union(a, b)
    assert [f"{n} {t}" for n, t in out.dtypes] == ["i bigint", "f float", "l array<bigint>", "s struct<p:bigint,q:string,r:int>", "more string"]
    rows = sorted((r.i, r.f, tuple(r.l), tuple(r.s), r.more) for r in out.collect())
    assert rows == [(1, 2.5, (1,), (1, "x", None), None), (2**40, None, (2**40,), (2**40, None, 3), "m")]
    kinds = lambda x, y: unions.common_type(*(spark.sql(f"SELECT CAST(NULL AS {k}) AS c").schema["c"].dataType for k in (x, y))).simpleString()
    want = {("int", "double"): "double", ("bigint", "float"): "double", ("int", "decimal(6,4)"): "decimal(14,4)", ("date", "timestamp"): "timestamp", ("decimal(9,2)", "decimal(5,4)"): "decimal(11,4)", ("float", "decimal(9,2)"): "double"}
    for (x, y), kind in want.items():
        assert kinds(x, y) == kinds(y, x) == kind
    for x, y in (("int", "string"), ("boolean", "int"), ("timestamp", "timestamp_ntz"), ("array<int>", "int"), ("bigint", "decimal(38,30)"), ("struct<a: int>", "struct<a: string>")):
        with pytest.raises(unions.Conflict):
            kinds(x, y)


def test_package_diffs_read_what_differs(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    rows = [(i, f"v{i}", None if i % 3 else 1.5) for i in range(400)] + [(None, "n", None)]
    schema = "id long, v string, w double"
    other = [(i, v, w) for i, v, w in rows if i != 5]
    other = [(i, "new" if i == 7 else v, 2.5 if i == 8 else w) for i, v, w in other] + [(1000, "a", None)]
    for name, own in (("v1", rows), ("v2", other), ("v3", list(reversed(other)))):
        artifacts.write_package({"nodes": spark.createDataFrame(own, schema)}, root, name, keys={"nodes": ["id"]})
        assert artifacts.read_package(spark, root, name)["nodes"].columns == ["id", "v", "w"]
    found = {r.id: (r.change, r.old, r.new) for r in artifacts.package_diff(spark, root, "v1", "v2", "nodes").collect()}
    assert found == {5: ("removed", '{"v":"v5"}', None), 7: ("changed", '{"v":"v7"}', '{"v":"new"}'), 8: ("changed", '{"v":"v8"}', '{"v":"v8","w":2.5}'), 1000: ("added", None, '{"v":"a"}')}
    assert artifacts.package_diff(spark, root, "v2", "v3", "nodes").count() == 0 and artifacts.package_summary(spark, root, "v2", "v3")["identical"]
    summary = artifacts.package_summary(spark, root, "v1", "v2")
    assert not summary["identical"] and summary["tables"]["nodes"] == {"from_rows": 401, "to_rows": 401, "identical": False}
    old, _, _ = artifacts._differing(spark, root, "v1", "v2", "nodes")
    whole = spark.read.parquet(f"{root}/packages/v1/nodes")
    assert inspection.scan_bytes(old) < inspection.scan_bytes(whole) / 8
    assert inspection.scan_bytes(artifacts._differing(spark, root, "v2", "v3", "nodes")[0]) == 0
    artifacts.write_package({"nodes": spark.createDataFrame(rows, schema)}, root, "plain")
    with pytest.raises(artifacts.Invalid):
        artifacts.package_diff(spark, root, "v1", "plain", "nodes")


def greedy(found, pairs, epsilon):
    """Rule by rule in order; those that stay drop what they generalize."""

    def general(wide, narrow):
        left = list(narrow)
        if len(wide) != len(narrow) or set(wide) == set(narrow):
            return False
        for a in wide:
            at = next((i for i, d in enumerate(left) if a == d or (a.split("=")[0], d.split("=")[0]) in pairs), None)
            if at is None:
                return False
            left.pop(at)
        return True

    kept = []
    for rule in sorted(found, key=lambda r: (r[1], len(r[0]), tuple(r[0]))):
        if not any(k[1] == rule[1] and general(k[0], rule[0]) and abs(k[2] - rule[2]) <= epsilon for k in kept):
            kept.append(rule)
    return sorted(map(str, kept))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("closed", [True, False])
def test_hierarchies_of_three_levels_equal_the_greedy_loop(spark, seed, closed):
    rng = random.Random(seed)
    pairs = (("a", "b"), ("b", "d"), ("a", "c"), ("z", "y"))  # z sorts behind what lies below it
    pairs = rules.closure(pairs) if closed else pairs
    made = set()
    while len(made) < 160:
        features = rng.sample(["a", "b", "c", "d", "e", "y", "z"], rng.randrange(1, 4))
        made.add((tuple(sorted(f"{f}={rng.choice('12')}" for f in features)), rng.choice(["t=1", "t=2"])))
    rows = [(list(a), c, round(rng.choice([0.3, 0.34, 0.38, 0.6]), 6)) for a, c in sorted(made)]
    df = spark.createDataFrame([(a, c, 0.1, conf, 1.5) for a, c, conf in rows], "antecedents array<string>, consequent string, support double, confidence double, lift double")
    got = rules.without_generalized(df, pairs, 0.05).collect()
    assert sorted(str((r.antecedents, r.consequent, r.confidence)) for r in got) == greedy(rows, set(pairs), 0.05)
    assert len(got) < len(rows) and rules.without_generalized(df, ()).count() == len(rows)


def test_closure():
    assert rules.closure((("a", "b"), ("b", "c"), ("c", "d"))) == (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"))
    with pytest.raises(ValueError):
        rules.closure((("a", "b"), ("b", "a")))
