"""Places of rows in a total order, and digests that depend on that order alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut, drop_cut

#: Rows, or digests of a level, under one digest of the next.
FAN = 1024
_IN_PART = 33  # bits that monotonically_increasing_id() has for the place within a partition


def with_ordinals(df: DataFrame, order: list[tuple[Column, bool]], name: str = "ordinal") -> DataFrame:
    """Rows with their place, from 0 without gaps, in an order of (column, whether it rises); nulls come first where it rises.

    Rows equal in it are told apart by the hash of all columns. Rows are range-partitioned and sorted, and each partition starts
    at the number of rows before it, so no task sees more than its partition. Equal rows get places next to each other.
    """
    columns = df.columns
    keys = [*order, (F.xxhash64(*columns), True)]
    keyed = df.select("*", *[k.alias(f"__k{i}") for i, (k, _) in enumerate(keys)])
    directed = [F.col(f"__k{i}").asc() if rising else F.col(f"__k{i}").desc() for i, (_, rising) in enumerate(keys)]
    ordered = keyed.repartitionByRange(*directed).sortWithinPartitions(*directed)
    placed = cut(ordered.select(*columns, F.monotonically_increasing_id().alias("__at")), "ordered")
    placed = placed.withColumn("__part", F.shiftright("__at", _IN_PART))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))  # one row a partition
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    return placed.join(F.broadcast(starts), "__part").select(*columns, place.alias(name))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the digests of all batches, of which one is held at a time."""
    whole, any_ = hashlib.sha256(), False
    for batch in batches:
        any_ = any_ or batch.num_rows > 0
        whole.update("".join(batch.column(0).to_pylist()).encode())
    if any_:
        yield pa.RecordBatch.from_pydict({"d": [whole.hexdigest()]})


def ordered_digest(df: DataFrame, order: list[tuple[Column, bool]], text: Column, levels: int | None = None) -> str:
    """SHA-256 over the texts of all rows in order: the same for any partitioning, another one when two rows change places.

    Digests of FAN rows in a row are joined and digested again, level by level, until one is left. With levels there are as many of
    these, and what they leave is digested as one, however much it is: sorted on disk and streamed through a task that holds a batch.
    """
    level = with_ordinals(df.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("d"), *[k.alias(f"o{i}") for i, (k, _) in enumerate(order)]), [(F.col(f"o{i}"), up) for i, (_, up) in enumerate(order)])
    level = level.select("ordinal", "d")
    done = 0
    while levels is None or done < levels:
        block = F.expr(f"ordinal div {FAN}").alias("ordinal")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "d"))), lambda x: x["d"]), "")
        done += 1
        above = cut(level.groupBy(block).agg(F.sha2(joined, 256).alias("d")), "digests")
        level = above
        if levels is None and len(rows := above.limit(2).collect()) <= 1:
            drop_cut(above)
            return rows[0]["d"] if rows else ""
    last = level.repartition(1).sortWithinPartitions("ordinal").select("d").mapInArrow(_streamed, "d string").first()
    return last["d"] if last else ""
