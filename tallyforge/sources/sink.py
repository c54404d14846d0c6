"""A sink that holds every row once, however often and however far a batch is written.

Rows carry their id in the files that hold them, so there is no moment at which a row is there and its id is not. The target
is dealt into folders by a hash of the leading key, for results the run, and a batch looks up its own folders and keys only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.lineage import cut, drop_cut
from tallyforge.sources.artifacts import exists

#: Folders of a target; leading keys up to which their values go into the lookup's filter.
BUCKETS, LISTED = 256, 1000

# fixed values: what a result has to be, by column, and the columns of its id
RESULT_KEYS = ("run_id", "fixture_id", "route", "metric", "evaluator")
RESULT_RULES = {
    "run_id": "run_id RLIKE '^[A-Za-z0-9][A-Za-z0-9._-]{7,63}$'",
    "fixture_id": "fixture_id IS NOT NULL",
    "route": "route IS NOT NULL",
    "metric": "metric IS NOT NULL",
    "evaluator": "evaluator IS NOT NULL",
    "score": "score BETWEEN 0 AND 1 AND NOT isnan(score)",
    "passed": "passed IS NOT NULL",
    "mode": "mode IN ('deterministic', 'jev', 'llm')",
    "gate": "gate = 'informational'",
}
# fixed values: reasons for a failure; messages of the storage are never passed on, as they could hold values of rows
REASONS = {
    "sink_permission_denied": ("Permission denied", "AccessControlException", "AccessDenied", "Forbidden"),
    "sink_auth_failed": ("Unauthorized", "credentials"),
    "sink_not_found": ("FileNotFound", "PATH_NOT_FOUND", "No such bucket", "NoSuchBucket"),
    "sink_rejected_rows": ("CANNOT_WRITE", "INCOMPATIBLE", "DATATYPE_MISMATCH", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_MERGE_SCHEMA"),
}


@dataclass(frozen=True)
class Outcome:
    status: str
    attempted: int
    written: int
    reason: str | None = None


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def lookup(spark: SparkSession, root: str, key: str, buckets: list[int], values: list | None) -> DataFrame:
    """(bucket, insert_id) of the rows that a batch could repeat: its folders, and in them the files that hold its leading keys."""
    there = spark.read.parquet(root).where(F.col("bucket").isin(buckets))
    if values is not None:
        there = there.where(F.col(key).isin(values))
    return there.select("bucket", "insert_id")


def write_once(batch: DataFrame, root: str, keys: tuple[str, ...] = RESULT_KEYS, rules: dict[str, str] | None = None, buckets: int = BUCKETS) -> Outcome:
    """Write the rows of a batch that the target does not hold yet; one row that breaks a rule, and nothing is written.

    A row's id is its keys joined by colons; of rows of one id in a batch the one with the least hash is taken. After any
    failure the same batch may be written again. Two batches that share ids must not run at once: their writer holds a lease.
    """
    attempted, held, fresh = 0, None, None
    rules = RESULT_RULES if rules is None else rules
    spark = batch.sparkSession
    try:
        # what is checked is what is written, even if the source changes meanwhile
        held = cut(batch, "sink-batch")
        valid = F.lit(True)
        for rule in [*rules.values(), *[f"{k} IS NOT NULL" for k in keys]]:
            valid = valid & F.coalesce(F.expr(rule), F.lit(False))
        attempted, invalid = held.agg(F.count("*"), F.count_if(~valid)).first()
        if invalid:
            return Outcome("failed", attempted, 0, "sink_invalid_record")
        named = held.withColumns({"insert_id": F.concat_ws(":", *keys), "bucket": bucket_of(F.col(keys[0]), buckets)})
        names = held.columns
        one = named.groupBy("bucket", "insert_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r")).select("bucket", "insert_id", "r.*")
        if exists(spark, root):
            touched = [r[0] for r in named.select("bucket").distinct().collect()]  # at most `buckets`
            leading = [r[0] for r in named.select(keys[0]).distinct().limit(LISTED + 1).collect()]
            there = lookup(spark, root, keys[0], touched, leading if len(leading) <= LISTED else None)
            one = one.join(there, ["bucket", "insert_id"], "left_anti")
        fresh = cut(one, "sink-rows")
        written = fresh.count()
        if written:
            fresh.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(root)
        return Outcome("ok", attempted, written)
    except Exception as error:  # never raised further: a result that cannot be kept changes no evaluation
        return Outcome("failed", attempted, 0, _reason(error))
    finally:
        drop_cut(held)
        drop_cut(fresh)


def _reason(error: Exception) -> str:
    text = f"{type(error).__name__} {error}"
    return next((reason for reason, marks in REASONS.items() if any(m in text for m in marks)), "sink_unavailable")


def as_row(spark: SparkSession, outcome: Outcome) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(outcome).values())], "status string, attempted long, written long, reason string")
