"""Versioned packages of tables: checked on reading, published by moving a pointer, kept for one step back.

A package is a folder of its own with its tables as Parquet and a manifest of their checksums. Tables
never pass through the driver; the manifest and the generations of the pointer are small canonical JSON files that appear whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
import tomllib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import coordination


class Invalid(ValueError):
    pass


def canonical_json(value) -> bytes:
    """Sorted keys, no spaces, no values that JSON has no form for."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def read_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file: written beside its place, then renamed over what is there, so that readers see either."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(data))
    out.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf)
    names = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(names, 1)
    options[0] = names.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(p), options)


def checksum(df: DataFrame) -> dict:
    """Rows, columns and a checksum of a table that no order or partitioning changes."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns))
    row = df.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).agg(
        F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "ab" for k, f in (("x", F.bit_xor), ("s", lambda c: F.sum(F.pmod(c, F.lit(1 << 31)))))]
    ).first()
    types = {name: kind for name, kind in df.dtypes}
    body = {"columns": [[c, types[c]] for c in columns], "parts": [row.xa, row.sa, row.xb, row.sb], "rows": row.n}
    return {"columns": body["columns"], "rows": row.n, "sha256": digest(canonical_json(body))}


#: Hash buckets of a table whose keys are known: each has a checksum and a folder of its own.
BUCKETS = 64
BUCKET = "__bucket"


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))


def bucket_checksums(df: DataFrame) -> dict[str, list]:
    """Rows and two order-free checksums of each bucket; at most BUCKETS lines come to the driver."""
    columns = sorted(c for c in df.columns if c != BUCKET)
    text = F.to_json(F.struct(*columns))
    rows = df.select(BUCKET, F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).groupBy(BUCKET)
    sums = [f(c) for c in ("a", "b") for f in (F.bit_xor, lambda x: F.sum(F.pmod(x, F.lit(1 << 31))))]
    return {str(r[0]): list(r[1:]) for r in rows.agg(F.count("*"), *sums).collect()}


def write_package(tables: dict[str, DataFrame], root: str, run_id: str, provenance: dict | None = None, keys: dict[str, list[str]] | None = None) -> dict:
    """A folder that may not exist yet; its manifest is written last, so a folder without one is no package.

    A table whose keys are given is dealt into hash buckets with a checksum each, by which package_diff() tells where two versions differ.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root}/packages/{run_id}"
    if exists(spark, folder):
        raise Invalid(f"{run_id} exists")
    sums = {}
    for name, df in sorted(tables.items()):
        own = (keys or {}).get(name)
        if own:
            _bucketed(df, own).hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{folder}/{name}")
        else:
            df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        written = spark.read.schema(df.schema if not own else _bucketed(df, own).schema).parquet(f"{folder}/{name}")
        sums[name] = checksum(written.drop(BUCKET))
        if own:
            sums[name] |= {"keys": own, "buckets": bucket_checksums(written)}
    manifest = {"provenance": provenance or {}, "run_id": run_id, "tables": sums}
    write_file(spark, f"{folder}/manifest.json", canonical_json(manifest))
    return manifest


def read_manifest(spark: SparkSession, root: str, run_id: str) -> dict:
    path = f"{root}/packages/{run_id}/manifest.json"
    if not exists(spark, path):
        raise Invalid(f"{run_id} is no package")
    return json.loads(coordination.read_small(spark, path))


def read_package(spark: SparkSession, root: str, run_id: str, provenance: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a package, if every checksum and the provenance, where given, are those of the manifest."""
    folder = f"{root}/packages/{run_id}"
    manifest = read_manifest(spark, root, run_id)
    if manifest["run_id"] != run_id or (provenance is not None and manifest["provenance"] != provenance):
        raise Invalid(f"{run_id}: provenance differs")
    tables = {name: spark.read.parquet(f"{folder}/{name}").drop(BUCKET) for name in manifest["tables"]}
    for name, df in tables.items():
        if checksum(df) != {k: v for k, v in manifest["tables"][name].items() if k not in ("keys", "buckets")}:
            raise Invalid(f"{run_id}: {name} is not what the manifest describes")
    return tables


def package_summary(spark: SparkSession, root: str, before: str, after: str) -> dict:
    """What manifests alone say of two versions: rows of each table, and whether the tables are the same."""
    a, b = (read_manifest(spark, root, x)["tables"] for x in (before, after))
    lines = {n: {"from_rows": a.get(n, {}).get("rows"), "to_rows": b.get(n, {}).get("rows"), "identical": a.get(n, {}).get("sha256") == b.get(n, {}).get("sha256")} for n in sorted({*a, *b})}
    return {"from": before, "to": after, "identical": all(x["identical"] for x in lines.values()), "tables": lines}


def _differing(spark: SparkSession, root: str, before: str, after: str, table: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows of both versions in those buckets alone whose checksums differ, and the table's keys."""
    a, b = (read_manifest(spark, root, x)["tables"].get(table) for x in (before, after))
    if not a or not b or a.get("keys") != b.get("keys") or not a.get("keys") or a["columns"] != b["columns"]:
        raise Invalid(f"{table} is not a table with one key and schema in both packages")
    buckets = [int(x) for x in {*a["buckets"], *b["buckets"]} if a["buckets"].get(x) != b["buckets"].get(x)]
    sides = [spark.read.parquet(f"{root}/packages/{x}/{table}").where(F.col(BUCKET).isin(buckets)).drop(BUCKET) for x in (before, after)]
    return sides[0], sides[1], a["keys"]


def package_diff(spark: SparkSession, root: str, before: str, after: str, table: str) -> DataFrame:
    """(keys..., change, old, new): rows of a table that were added, removed or changed, both forms as JSON.

    Keys are unique in a version, null keys included. Buckets with equal checksums are not read.
    """
    old, new, keys = _differing(spark, root, before, after, table)
    rest = [c for c in old.columns if c not in keys]
    form = lambda df, name: df.select(*keys, F.to_json(F.struct(F.lit(1).alias("_"), *rest)).alias(name), F.lit(True).alias(f"in_{name}"))
    a, b = form(old, "old"), form(new, "new").toDF(*[f"__{k}" for k in keys], "new", "in_new")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = a.join(b, same, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    named = [F.when(F.col("in_old").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    body = lambda c: F.regexp_replace(c, '^[{]"_":1,?', "{").alias(c)
    return both.select(*named, change.alias("change"), body("old"), body("new")).where("change IS NOT NULL")


#: Generations of the pointer that are kept, for readers that have listed them and not read them yet.
GENERATIONS = 16


def _pointed(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The latest generation of the pointer and what it says."""
    for _ in range(10):
        numbers = coordination.numbered(spark, f"{root}/pointers")
        if not numbers:
            return 0, {"current": None, "fence": 0, "previous": None}
        try:
            return numbers[-1], json.loads(coordination.read_small(spark, coordination.number_path(f"{root}/pointers", numbers[-1])))
        except Exception as error:
            if "FileNotFound" not in str(error):  # else so many generations have come since that this one is gone
                raise
    raise Invalid("the pointer moves faster than it can be read")


def _moved(spark: SparkSession, root: str, generation: int, body: dict) -> bool:
    """Compare and swap: the next generation is a file that only one of those who saw this one can make."""
    folder = f"{root}/pointers"
    if not coordination.create_exclusively(spark, coordination.number_path(folder, generation + 1), canonical_json(body)):
        return False
    for old in coordination.numbered(spark, folder)[:-GENERATIONS]:
        p, fs = _fs(spark, coordination.number_path(folder, old))
        fs.delete(p, False)
    return True


def pointer(spark: SparkSession, root: str) -> dict:
    """{current, previous}: names of packages, null before the first publication."""
    body = _pointed(spark, root)[1]
    return {name: body[name] for name in ("current", "previous")}


def promote(spark: SparkSession, root: str, run_id: str, expected: str | None = None, lease: coordination.Lease | None = None) -> dict:
    """Point to a package that reads without fault. Fails if another one than `expected` is current, or the lease is lost.

    Of several publishers with one expectation exactly one succeeds. The holder of a lease first puts its fencing number into the
    pointer; from then on an earlier holder, whatever it has checked before, meets a generation it has not seen.
    """
    generation, before = _pointed(spark, root)
    if lease:
        lease.check()
        if before["fence"] > lease.number:
            raise Invalid(f"lease {before['fence']} has published, {lease.number} is an earlier one")
        if before["fence"] < lease.number:
            if not _moved(spark, root, generation, {**before, "fence": lease.number}):
                raise Invalid("another publisher was first")
            generation += 1
    read_package(spark, root, run_id)
    if before["current"] != expected:
        raise Invalid(f"{before['current']} is current")
    if lease:
        lease.check()
    after = {"current": run_id, "previous": before["current"]}
    if not _moved(spark, root, generation, {**after, "fence": lease.number if lease else before["fence"]}):
        raise Invalid("another publisher was first")
    return after


def rollback(spark: SparkSession, root: str) -> dict:
    generation, before = _pointed(spark, root)
    if not before["previous"]:
        raise Invalid("there is no package to go back to")
    read_package(spark, root, before["previous"])
    after = {"current": before["previous"], "previous": None}
    if not _moved(spark, root, generation, {**after, "fence": before["fence"]}):
        raise Invalid("another publisher was first")
    return after


def versions(spark: SparkSession, root: str) -> list[str]:
    p, fs = _fs(spark, f"{root}/packages")
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if exists(spark, f"{s.getPath()}/manifest.json"))


def retain(spark: SparkSession, root: str) -> list[str]:
    """Remove all packages but the current and the previous one; the names of those removed."""
    kept = set(pointer(spark, root).values())
    gone = [v for v in versions(spark, root) if v not in kept]
    for name in gone:
        p, fs = _fs(spark, f"{root}/packages/{name}")
        fs.delete(p, True)
    return gone


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    run_id = pointer(spark, root)["current"]
    if run_id is None:
        raise Invalid("nothing is published")
    return read_package(spark, root, run_id)


def settings(text: str, known: dict[str, type]) -> dict:
    """TOML with exactly the keys given (dotted for tables), each of its type."""
    flat: dict[str, object] = {}

    def walk(prefix: str, node: dict) -> None:
        for key, value in node.items():
            name = f"{prefix}{key}"
            if isinstance(value, dict):
                walk(f"{name}.", value)
            else:
                flat[name] = value

    walk("", tomllib.loads(text))
    if flat.keys() != known.keys():
        raise Invalid(f"keys differ: {sorted(flat.keys() ^ known.keys())}")
    for name, kind in known.items():
        if type(flat[name]) is not kind and not (kind is float and type(flat[name]) is int):
            raise Invalid(f"{name} is not of type {kind.__name__}")
    return flat


def lineage_manifest(source: DataFrame, out: DataFrame, freshness: str, rules: list[str]) -> dict:
    """What a preparation read and made: row counts, checksums of both tables and the watermark, the greatest freshness."""
    watermark = out.agg(F.max(F.col(freshness).cast("string"))).first()[0]
    body = {"freshness_watermark": watermark, "output": checksum(out), "rules": rules, "source": checksum(source)}
    return body | {"content_sha256": digest(canonical_json(body))}


def write_report(results: DataFrame, path: str, passed: str = "passed") -> dict:
    """Results as JSON lines in a folder, beside a summary of their number and how many passed."""
    results.write.mode("errorifexists").json(f"{path}/results")
    row = results.agg(F.count("*").alias("results"), F.count_if(passed).alias("passed")).first()
    summary = {"failed": row.results - row.passed, "passed": row.passed, "results": row.results}
    write_file(results.sparkSession, f"{path}/summary.json", canonical_json(summary))
    return summary
