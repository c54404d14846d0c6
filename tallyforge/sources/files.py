"""Files in and out: CSV tables, partitioned folders, audited and idempotent appends."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut, drop_cut

TABLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,127}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discover_csv(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """CSV files under root by table: the first folder below root, or the stem of a file that lies in root."""
    _, p, fs = _fs(spark, root)
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    found: dict[str, list[str]] = {}
    listing = fs.listFiles(p, True)
    while listing.hasNext():
        path = listing.next().getPath().toString()
        if path.lower().endswith(".csv"):
            inner = path[len(base) :].split("/")
            name = inner[0] if len(inner) > 1 else inner[0][:-4]
            if not TABLE_NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no table name")
            found.setdefault(name, []).append(path)
    return {k: sorted(v) for k, v in sorted(found.items())}


def select_tables(found: dict[str, list[str]], wanted: list[str] | None) -> dict[str, list[str]]:
    if missing := sorted(set(wanted or ()) - set(found)):
        raise ValueError(f"no files for {', '.join(missing)}")
    return {k: v for k, v in found.items() if not wanted or k in wanted}


def read_csv(spark: SparkSession, paths: list[str], base: str | None = None, schema=None, max_bad_records: int = 0) -> DataFrame:
    """One header line, inferred types or a schema; year=/month= folders below base become columns.

    More malformed lines than max_bad_records fail the load; fewer are left out. Lines are parsed once (twice if
    types are inferred): the parsed rows are written to the shared folder, and malformed ones counted there.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if base:
        reader = reader.option("basePath", base)
    if schema is None:
        schema = reader.option("inferSchema", True).csv(paths).schema
    if "_bad" not in schema.names:
        schema = type(schema)([*schema.fields]).add("_bad", "string")
    rows = cut(reader.schema(schema).csv(paths), "csv")
    bad = rows.where(F.col("_bad").isNotNull()).count()
    if bad > max_bad_records:
        drop_cut(rows)
        raise ValueError(f"{bad} malformed lines, {max_bad_records} allowed")
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def copy_once(spark: SparkSession, source: str, target: str) -> str:
    """Copy a file unless the target exists: copied, present, or size_differs; nothing is overwritten."""
    jvm, s, fs = _fs(spark, source)
    _, t, out = _fs(spark, target)
    if out.exists(t):
        return "present" if out.getFileStatus(t).getLen() == fs.getFileStatus(s).getLen() else "size_differs"
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s, out, t, False, False, spark.sparkContext._jsc.hadoopConfiguration())
    return "copied"


def list_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    rows = sorted((database, t.name, t.tableType) for t in spark.catalog.listTables(database))
    return spark.createDataFrame(rows, "dataset string, table string, type string")


AUDIT = "run_id string, contract_version string, table string, source_rows long, curated_rows long, schema_hash string, manifest string"


def append_audit(spark: SparkSession, path: str, row: dict) -> None:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    if missing := [n for n in names if row.get(n) is None]:
        raise ValueError(f"the audit row lacks {', '.join(missing)}")
    spark.createDataFrame([tuple(row[n] for n in names)], AUDIT).write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], since: Column | None = None) -> None:
    """Append rows whose keys the target does not hold yet, null keys included; running it again adds nothing.

    since, a condition on the target, bounds what of it is read, for batches whose keys cannot be older.
    """
    fresh = df.dropDuplicates(keys)
    _, p, fs = _fs(df.sparkSession, path)
    if fs.exists(p):
        there = df.sparkSession.read.parquet(path)
        there = (there if since is None else there.where(since)).select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        fresh = fresh.join(there, same, "left_anti")
    fresh.write.mode("append").parquet(path)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a batch of a stream into a folder of its own; a batch that is repeated replaces what it left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
