"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in a local session."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        _own_folder[key] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return _own_folder[key]


def cut(df: DataFrame, name: str = "step", row_group: int | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    The copy outlives any executor, so what follows never recomputes what
    came before. release() removes the copies once results are written. Wide rows
    may ask for smaller row groups, which a task holds in memory; by names a column
    whose values have a folder each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("parquet.block.size", row_group) if row_group else df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df_or_none: DataFrame | None) -> None:
    """Remove the written copy behind a DataFrame that cut() returned and nothing reads any more."""
    if df_or_none is None:
        return
    spark = df_or_none.sparkSession
    kept = _written.get(spark.sparkContext.applicationId, [])
    for folder in {f.rsplit("/", 1)[0] for f in df_or_none.inputFiles()}:
        for path in [p for p in kept if folder.endswith(p.rsplit("/", 1)[1])]:
            delete(spark, path)
            kept.remove(path)


def release(spark: SparkSession) -> None:
    """Remove every copy that cut() has written in this application."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect its garbage once lineage was cut: Spark removes shuffle files only when nothing refers to the
    plans that wrote them, which a driver with room to spare would put off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Copies that cut() writes within go when it ends; what was read from them must be written elsewhere by then."""
    before = set(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        kept = _written.get(spark.sparkContext.applicationId, [])
        for path in [p for p in kept if p not in before]:
            delete(spark, path)
            kept.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
