"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Seeds of the items and n-grams of the documents are tables that Spark joins; a filter of fixed size
keeps n-grams that are no item's from the shuffle. Texts and items of equal words are met once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import collect_garbage, cut, small_batches, table

WORD = re.compile(r"\w+")
#: Words whose hashes a Python worker remembers; rows of a batch handed on.
REMEMBERED, HANDED = 1_000_000, 1 << 16
#: Bits of one row of Spark's bitmap aggregate.
CHUNK = 32_768


@dataclass(frozen=True)
class Settings:
    """score: the least share of an item's best possible alignment score that counts as a leak.

    An n-gram is rare when it takes no more than `rare` of all places of the corpus, or `few` places. An item's
    rarest half of n-grams are seeds in any case, so that an item of common words has seeds too; that the
    item itself leaked often does not make it common. An alignment worth long_words matches is a leak of any
    item, however long. Items of fewer than least_words words are found as whole word sequences only.
    filter_bits is the size of the filter that each task holds, whatever the benchmark's size.
    """

    n: int = 3
    rare: float = 1e-6
    few: int = 100
    score: float = 0.5
    long_words: int = 40
    least_words: int = 5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    filter_bits: int = 1 << 24


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_codes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit number for the n words that start at each place."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def smith_waterman(query: np.ndarray, target: np.ndarray, settings: Settings) -> tuple[int, int]:
    """Best local alignment score of two word sequences with linear gaps, and its end in target.

    A row of the table at a time; the gap along a row is a running maximum.
    """
    best, end = 0, 0
    slope = -settings.gap * np.arange(len(target) + 1)
    row = np.zeros(len(target) + 1, np.int64)
    for w in query:
        step = np.where(target == w, settings.match, settings.mismatch)
        fresh = np.maximum(row + settings.gap, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + step)
        row = np.maximum.accumulate(fresh + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _aligned(item: np.ndarray, text: np.ndarray, starts: np.ndarray, settings: Settings) -> tuple[float, int, int] | None:
    """(score, first word, word after the last) of an item's best alignment around the starts, if it is a leak."""
    if len(item) < max(settings.least_words, settings.n):
        at = [a for a in starts.tolist() if np.array_equal(text[a : a + len(item)], item)]
        return (1.0, at[0], at[0] + len(item)) if at else None
    slack = len(item) // 2 + 1
    lo, hi = np.maximum(starts - slack, 0), np.minimum(starts + len(item) + slack, len(text))
    begin, stop, best = None, 0, (0, 0, 0)
    for a, b in [*zip(lo.tolist(), hi.tolist()), (None, None)]:
        if begin is not None and (a is None or a > stop):
            score, end = smith_waterman(item, text[begin:stop], settings)
            if score > best[0]:
                best = (score, begin, begin + end)
            begin = None
        if a is not None:
            begin, stop = (a, b) if begin is None else (begin, max(stop, b))
    share = best[0] / (settings.match * len(item))
    if share < settings.score and best[0] < settings.match * settings.long_words:
        return None
    _, length = smith_waterman(item[::-1], text[best[1] : best[2]][::-1], settings)
    return share, best[2] - length, best[2]


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item long, class_item long): every item with a word, and the smallest id (nulls last) of the items of equal words."""
    worded = _worded(benchmark, id_col, text_col)
    classes = worded.groupBy("k1", "k2").agg(F.min("item").alias("class_item"))
    return worded.join(classes, ["k1", "k2"]).select("item", "class_item")


def _worded(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, k1, k2, words): the words of each item, one space between them, and two hashes of these."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [" ".join(words_of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.string())], ["item", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(split, "item long, words string")
    return rows.where("words <> ''").select("item", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "words")


def _seeds(items: DataFrame, settings: Settings) -> DataFrame:
    """(code, k1, k2, place): each n-gram of each item; of a short item all of its words as one."""
    least = max(settings.least_words, settings.n)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for k1, k2, words in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = words.split(" ")
                codes = gram_codes(hashes.of(words), settings.n if len(words) >= least else len(words)).view(np.int64)
                size = len(codes)
                columns = [pa.array(codes), pa.array(np.full(size, k1)), pa.array(np.full(size, k2)), pa.array(np.arange(size, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["code", "k1", "k2", "place"])

    return items.select("k1", "k2", "words").mapInArrow(grams, "code long, k1 long, k2 long, place int")


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value that the low bits of a seed take; at most bits / CHUNK rows come to the driver."""
    value = F.pmod("code", F.lit(bits)) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(value).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        own = np.frombuffer(r.bits, np.uint8)
        at = (r.chunk - 1) * (CHUNK // 8)
        out[at : at + len(own)] = own[: len(out) - at]
    return out


def _hits(source: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """(h1, h2, code, place, n): the n-grams of all texts that pass the filter, n is 1.

    Each batch adds a row without hashes whose n is its number of words.
    """
    handed = source.sparkSession.sparkContext.broadcast(bitmap)  # settings.filter_bits

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = _Hashes(), np.uint64(len(handed.value) * 8 - 1)
        names, types = ["h1", "h2", "code", "place", "n"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def packed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), types)], names)

        for batch in batches:
            parts, held, total = [], 0, 0
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                total += len(words)
                own = hashes.of(words)
                for n in lengths:
                    codes = gram_codes(own, n)
                    low = codes & last
                    at = np.flatnonzero(handed.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        size = len(at)
                        parts.append([np.full(size, h1), np.full(size, h2), codes[at].view(np.int64), at, np.ones(size, np.int64)])
                        held += size
                if held > HANDED:
                    yield packed(parts)
                    parts, held = [], 0
            if parts:
                yield packed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, total], types)], names)

    return source.select("h1", "h2", "text").mapInArrow(found, "h1 long, h2 long, code long, place int, n long")


def _kept_seeds(seeds: DataFrame, hits: DataFrame, total: int, settings: Settings) -> DataFrame:
    """The rare seeds and the rarest half of each item's, by how often their n-gram occurs in all texts."""
    counts = hits.groupBy("code").agg(F.sum("n").alias("n"))
    counted = seeds.join(counts, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    half = counted.groupBy("k1", "k2").agg(F.percentile("n", 0.5).alias("half"))
    rare = F.col("n") <= max(settings.rare * total, settings.few)
    return counted.join(half, ["k1", "k2"]).where("n > 0").where(rare | (F.col("n") <= F.col("half"))).select("code", "k1", "k2", F.col("place").alias("own"))


def _aligner(settings: Settings):
    fields = ["h1", "h2", "item", "n_items", "n_words", "score", "first_word", "end_word"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h1, h2, text, pairs in zip(*[batch.column(c) for c in ("h1", "h2", "text", "pairs")]):
                numbers: dict[str, int] = {}
                words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text.as_py())]
                target = np.array(words, np.int64)
                for pair in pairs.as_py():
                    item = np.array([numbers.get(w, -1) for w in pair["words"].split(" ")], np.int64)
                    leak = _aligned(item, target, np.sort(np.array(pair["starts"], np.int64)), settings)
                    if leak:
                        rows.append((h1.as_py(), h2.as_py(), pair["item"], pair["n_items"], len(item), *leak))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)

    return aligned


def text_leaks(source: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, settings: Settings) -> DataFrame:
    """(h1, h2, text) -> (h1, h2, item, n_items, n_words, score, first_word, end_word), once for each distinct text."""
    small_batches(source.sparkSession)
    worded = _worded(benchmark, item_col, item_text_col)
    items = worded.groupBy("k1", "k2").agg(F.min("item").alias("item"), F.count("*").alias("n_items"), F.first("words").alias("words"))
    items = cut(items, "items")
    seeds = cut(_seeds(items, settings), "seeds")
    least = max(settings.least_words, settings.n)
    size = F.size(F.split("words", " "))
    short = items.select(size.alias("n")).where(F.col("n") < least).distinct().collect()  # fewer than least
    lengths = sorted({settings.n, *(r.n for r in short)})
    collect_garbage(source.sparkSession)
    raw = cut(_hits(source, lengths, _filter(seeds, settings.filter_bits)), "hits")
    total = raw.where("h1 IS NULL").agg(F.sum("n")).first()[0] or 0
    hits = raw.where("h1 IS NOT NULL").groupBy("h1", "h2", "code", "place").agg(F.sum("n").alias("n"))
    kept = cut(_kept_seeds(seeds, hits, total, settings), "rare-seeds")
    pairs = hits.join(kept, "code").groupBy("h1", "h2", "k1", "k2").agg(F.collect_set(F.col("place") - F.col("own")).alias("starts"))
    pairs = pairs.join(items, ["k1", "k2"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("item", "n_items", "words", "starts")).alias("pairs"))
    pairs = cut(pairs, "seeded")
    texts = source.join(pairs.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    schema = "h1 long, h2 long, item long, n_items long, n_words int, score double, first_word int, end_word int"
    return cut(texts.join(pairs, ["h1", "h2"]).mapInArrow(_aligner(settings), schema), "leaks")


def _hashed(docs: DataFrame, text_col: str) -> tuple[DataFrame, list]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return text, [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """(id, item, n_items, score, first_word, end_word): items of the benchmark that leaked into rows of docs.

    Words are runs of letters, digits and underscores, lower-cased. n_items items of equal words are one, under
    their smallest id (null if all of theirs are null); item_classes() lists them. Items without a word take no
    part. Rows of docs without a word, or with null text, leak nothing; repeated rows give repeated results.
    """
    text, keys = _hashed(docs, text_col)
    found = text_leaks(docs.select(*keys, text.alias("text")), benchmark, item_col, item_text_col, settings)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *keys)
    return rows.join(found, ["h1", "h2"]).select("id", "item", "n_items", "score", "first_word", "end_word")


def with_leak(
    docs: DataFrame,
    benchmark: DataFrame,
    out: str = "leaked",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """docs with a boolean column: whether a benchmark item leaked into the row's text, as leaks() finds it.

    Items of fewer than least_words words do not count here, as ordinary text holds them by chance.
    """
    text, keys = _hashed(docs, text_col)
    found = text_leaks(docs.select(*keys, text.alias("text")), benchmark, item_col, item_text_col, settings)
    bad = found.where(F.col("n_words") >= settings.least_words).select(F.col("h1").alias("__1"), F.col("h2").alias("__2"), F.lit(True).alias("__bad")).distinct()
    marked = docs.withColumns({"__h1": keys[0], "__h2": keys[1]})
    joined = marked.join(bad, (F.col("__h1") == F.col("__1")) & (F.col("__h2") == F.col("__2")), "left")
    return joined.withColumn(out, F.coalesce("__bad", F.lit(False))).drop("__1", "__2", "__h1", "__h2", "__bad")


def op2_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of benchmark items into documents: doc_id, item_id, n_items, score, first_word, end_word.

    One row for each document and class of items of equal words whose alignment reaches half of the item's best
    possible score. Null and empty texts on either side give none; an empty table on either side gives no rows.
    """
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_items", F.round("score", 6).alias("score"), "first_word", "end_word")
