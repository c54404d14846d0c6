"""Reading tables, handing texts to Python workers; lineage is cut through a folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions.lineage import collect_garbage, cut, delete, drop_cut, release, scratch, shared_folder

__all__ = ["collect_garbage", "cut", "delete", "drop_cut", "release", "scratch", "shared_folder", "small_batches", "table"]

#: Bytes of an Arrow batch, about; Spark's own bounds, 10,000 rows and 64 MB, let each task hold several times that in buffers outside the heap.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers in batches of BATCH bytes; a smaller bound of the user's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < held <= BATCH:
        spark.conf.set(name, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
