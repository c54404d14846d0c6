"""From raw documents to packed training sequences, one operator a stage.

Every stage works on all rows that the one before kept. Rows with nulls, empty texts, repeated rows
and further columns pass through each stage as its operator defines them; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, langid, near_copies as copies, packing, pii
from tallyforge.llm.common import delete, scratch, shared_folder, table

#: A text whose best language is less probable than this has no language that could be told.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without a language: no text, no letter, or no language of some probability.

    The model learns from the labelled rows of docs. Without any, it cannot tell languages, and only
    rows without text or letters go.
    """
    model = langid.train(docs)
    found = langid.with_language(docs, model, lang_out="__lang", score_out="__score")
    if model is None:
        told = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    else:
        told = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    return found.where(told).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of texts with a 5-word shingle similarity of 0.8 or more.

    Covering SimHash proposes the closest copies. It cannot reach a similarity of 0.8, where fingerprints differ in 10 bits on
    average, so MinHash bands propose most pairs; whole shingle sets decide all of them. A pair at 0.8 exactly is missed with a probability
    of 0.0007.
    """
    return copies.one_of_each_class(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a benchmark item leaked."""
    return decontaminate.with_leak(docs, table(spark, sf_dir, "benchmark"), out="__leaked").where("NOT __leaked").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by pseudonyms; n_chars follows the text."""
    masked = pii.pseudonymise(docs, pii.session_key(spark))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of all documents into sequences of 2048 tokens."""
    import public_tokenizers

    packed = packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: SQL has no form of these stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote goes once the next one is written, and the result stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
