"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal, McMahan et al., 2013) with elastic-net
penalties, then calibrated by one temperature on rows that training has not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import small_batches, table

#: Hashed n-gram features, and the n of the n-grams.
FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: Characters hashed at a time, so that a very long text needs no more memory than this.
STEP = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """per_language bounds the labelled rows that weights are fitted on; frequencies cover all rows.

    most_languages bounds the model; a table with more labels than that is an error.
    """

    per_language: int = 600
    most_languages: int = 1000
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1e-3
    calibration_share: int = 5  # one sampled row of a language in so many, at least 2, sets the temperature


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray  # (FEATURES,)
    weights: np.ndarray  # (FEATURES, languages)
    bias: np.ndarray  # (languages,)
    temperature: float


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _codes(points: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of a run of code points."""
    mixed = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            return
        mixed = mixed[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            yield ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32)


def term_counts(text: str | None) -> np.ndarray:
    """How often each feature occurs in one whole text, lower-cased, runs of white space as one space."""
    clean = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(FEATURES, np.int64)
    reach = max(ORDERS) - 1
    for at in range(0, len(points), STEP):
        for n, codes in zip(ORDERS, _codes(points[max(0, at - reach) : at + STEP])):
            # grams that end before this step were counted in the step before
            fresh = codes[max(0, min(at, reach) - (n - 1)) :] if at else codes
            counts += np.bincount(fresh, minlength=FEATURES)
    return counts


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each feature occurs, and the number of rows, over all of docs.

    Each task adds its rows up and hands on one row per feature that it met.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                seen += term_counts(x.as_py()) > 0
                rows += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *found.tolist()], pa.int32()), pa.array([rows, *seen[found].tolist()], pa.int64())], ["feature", "n"]
        )

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(added, "feature int, n long")
    out, rows = np.zeros(FEATURES, np.int64), 0
    for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most FEATURES + 1 rows
        if r.feature < 0:
            rows = r.n
        else:
            out[r.feature] = r.n
    return out, rows


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, settings: Settings) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of a bounded, repeatable sample: about per_language rows of each.

    Rows are taken by a hash of id and text, so the same table gives the same sample, the least hashes first.
    """
    per = {r[0]: r[1] for r in docs.groupBy(lang_col).count().limit(settings.most_languages + 1).collect()}
    if len(per) > settings.most_languages:
        raise ValueError(f"more than {settings.most_languages} languages")
    if not per:
        return []
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, settings.per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col), F.crc32(F.col(text_col).cast("binary"))), F.lit(1 << 30)) / (1 << 30)
    drawn = docs.where(draw < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, at in zip(*[c.to_pylist() for c in batch.columns]):
                counts = term_counts(text)
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]),
                        pa.array([at]),
                        pa.array([found.astype("<i4").tobytes()]),
                        pa.array([counts[found].astype("<i4").tobytes()]),
                    ],
                    ["lang", "draw", "features", "counts"],
                )

    rows = drawn.mapInArrow(counted, "lang string, draw double, features binary, counts binary")
    order = ["draw", "lang", "features", "counts"]
    rows = rows.orderBy(*order).limit(2 * settings.per_language * len(per)).collect()
    return [(r.lang, np.frombuffer(r.features, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows]


def _vector(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = np.log1p(counts) * idf[features]
    norm = np.sqrt(value @ value)
    return value / norm if norm else value


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(-1, keepdims=True))
    return out / out.sum(-1, keepdims=True)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, rows: int, settings: Settings) -> Model:
    languages = sorted({lang for lang, _, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    idf = np.where(frequency > 0, np.log((1 + rows) / (1 + frequency)) + 0.1, 0.0)
    data = [(number[lang], f, _vector(f, c, idf)) for lang, f, c in sample]
    # every so many a row of a language sets the temperature, never its first
    met, held, used = Counter(), [], []
    for x in data:
        met[x[0]] += 1
        (used if met[x[0]] % settings.calibration_share else held).append(x)
    held = held or data
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def leader(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= settings.l1
        step = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * settings.l1) / step)

    rng = np.random.default_rng(0)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(used)):
            label, features, value = used[i]
            at, x = np.append(features, FEATURES), np.append(value, 1.0)
            w = leader(at)
            error = _softmax(x @ w)
            error[label] -= 1.0
            g = np.outer(x, error)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    weights = leader(np.arange(FEATURES + 1))
    logits = np.array([value @ weights[features] + weights[FEATURES] for _, features, value in held])
    labels = np.array([label for label, _, _ in held])
    return Model(languages, idf, weights[:-1], weights[-1], _temperature(logits, labels))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Fit on the labelled rows of docs; rows without text or label teach nothing. None if there are none."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sample = training_sample(labelled, id_col, text_col, lang_col, settings)
    if not sample:
        return None
    frequency, rows = document_frequencies(labelled, text_col)
    return fit(sample, frequency, rows, settings)


def predict(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0
    counts = term_counts(text)
    features = np.flatnonzero(counts)
    value = _vector(features, counts[features], model.idf)
    p = _softmax((value @ model.weights[features] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability to every row of docs.

    Null texts and texts without a letter are `und` with score 0; so is everything when there was
    no labelled row to learn from. Columns of docs with the new names are replaced.
    """
    small_batches(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages, whatever the corpus

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        found = [predict(handed.value, None if x is None or x is pd.NA else x) for x in texts]
        return pd.DataFrame(found, columns=["lang", "score"])

    found = docs.drop(lang_out, score_out).withColumn("__found", predicted(F.col(text_col).cast("string")))
    return found.withColumn(lang_out, F.col("__found.lang")).withColumn(score_out, F.col("__found.score")).drop("__found")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def op8_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learnt from those whose fold is not 2.

    Null texts and texts without a letter are `und` with score 0. Repeated rows get the same
    answer. An empty table gives no rows; other columns than doc_id, text and lang are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold() != 2))
    slim = docs.select("doc_id", (fold() == 2).alias("held_out"), "text")
    return with_language(slim, model).select("doc_id", "held_out", "lang_pred", "score")
