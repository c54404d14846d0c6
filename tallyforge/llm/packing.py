"""Best-fit packing of token pieces into sequences with several capacities at once."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, small_batches, table

#: Words whose ids a Python worker remembers at a time, about; longer words are not remembered. Words of a text met at a time.
REMEMBERED, LONGEST, MET = 700_000, 64, 1 << 14
#: A token of its own between words that are encoded together; words that hold it are encoded alone.
BETWEEN = b"~"
#: Pieces that one task packs together, about.
GROUP = 16_384


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds: tokens, pieces, and attention cost, the sum of squared piece lengths.

    The registered query's contract bounds tokens alone. Its other two capacities follow from that bound (2048 pieces
    of one token, one piece of 2048), so they shape the residual norm but never refuse a piece; smaller ones do.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)


class WordIds:
    """Token ids of whole texts as little-endian 32-bit bytes, word by word.

    The tokenizer lower-cases and never joins characters across white space. So a text's ids
    are the ids of its words in order, and a word met before is looked up. Words are remembered in two halves: once
    the newer one is full it becomes the older one, and words met again move back. One of these lives
    as long as a worker, which holds it through all that the worker does later.
    """

    _by_path: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.between = self._each([BETWEEN])[0]

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def bytes_of(self, text: bytes) -> bytes:
        # A-Z and ASCII white space; capitals keep a text apart from the name of a special token
        words = (text if b"<|" in text else text.lower()).split()
        return b"".join(self._met(words[at : at + MET]) for at in range(0, len(words), MET))

    def _met(self, words: list[bytes]) -> bytes:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for word in set(words).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        together = [w for w in new if BETWEEN not in w]
        known.update(zip(together, self._together(together)))
        alone = [w for w in new if BETWEEN in w]
        known.update(zip(alone, self._each(alone)))
        out = b"".join(itemgetter(*words)(known) if len(words) > 1 else [known[w] for w in words])
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return out

    def _each(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, from one text that holds them all, which costs less than a text each."""
        if len(self.between) != 4 or len(words) < 2:
            return self._each(words)
        text = (b" " + BETWEEN + b" ").join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.between, "<u4")) * 4
        if len(ends) != len(words) - 1:  # a word has that token in its ids
            return self._each(words)
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(whole)])]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, tokens: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, at) for every row of docs.

    A document is its ids and then end_id; null text is empty. Only documents of more than
    `tokens` ids are cut. `at` numbers the rows of a task, to deal pieces out evenly.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        at = 0
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = words.bytes_of(text.as_py() or b"") + end
                for piece, first in enumerate(range(0, len(whole), tokens * 4)):
                    part = whole[first : first + tokens * 4]
                    rows.append((key, piece, first // 4, len(part) // 4, zlib.crc32(part), at))
                    at += 1
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "piece", "start", "length", "ids_crc32", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(cut_up, "id long, piece int, start long, length long, ids_crc32 long, at long")


def best_fit(lengths: np.ndarray, capacities: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, longest first.

    A piece goes to the open bin that keeps every capacity and whose residual after it has
    the smallest weighted norm, each residual as a share of its capacity; ties go to the bin
    opened first. A bin that the shortest piece no longer fits is closed.
    """
    room = (float(capacities.tokens), float(capacities.documents), float(capacities.attention))
    weights = [w / r**2 for w, r in zip(capacities.weights, room)]
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = float(lengths.min()) if len(lengths) else 0.0
    left = np.empty((3, 1024))  # a row for each capacity, a column for each open bin
    names = np.empty(1024, np.int64)
    opened = held = 0
    for k in order:
        length = float(lengths[k])
        need = (length, 1.0, length * length)
        if any(n > r for n, r in zip(need, room)):
            raise ValueError(f"a piece of {lengths[k]} tokens exceeds the capacities")
        slot = -1
        if held:
            after = [left[c, :held] - need[c] for c in range(3)]
            fits = np.flatnonzero((after[0] >= 0) & (after[1] >= 0) & (after[2] >= 0))
            if len(fits):
                norm = sum(w * a[fits] ** 2 for w, a in zip(weights, after))
                slot = int(fits[norm.argmin()])
        if slot < 0:
            if held == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            slot, held = held, held + 1
            left[:, slot], names[slot] = room, opened
            opened += 1
        bins[k], offsets[k] = names[slot], capacities.tokens - left[0, slot]
        left[:, slot] -= need
        if left[0, slot] < least or left[1, slot] < 1 or left[2, slot] < least * least:
            left[:, slot : held - 1], names[slot : held - 1] = left[:, slot + 1 : held].copy(), names[slot + 1 : held].copy()
            held -= 1
    return bins, offsets


def pack(pieces: DataFrame, capacities: Capacities = Capacities(), group_size: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows of (id, piece, start, length, ids_crc32, at).

    Pieces are dealt evenly to groups of about group_size, and a task packs one group, so
    the sequences left part-filled are a few in each group. A sequence holds pieces of one group.
    Pieces as long as a sequence go through the same rule and fill one each.
    """
    pieces = cut(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("part", F.expr(f"pmod(xxhash64(at, id, piece, ids_crc32), {groups})"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *[(c, "ascending") for c in ("ids_crc32", "id", "piece", "at")]]
        rows = rows.sort_by(order).drop_columns(["at", "part"])
        bins, offsets = best_fit(rows.column("length").to_numpy(), capacities)
        rows = rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32)))
        return rows.append_column("offset", pa.array(offsets))

    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInArrow(packed, schema)


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Capacities = Capacities(),
    end_id: int = 0,
) -> DataFrame:
    return pack(token_pieces(docs, id_col, text_col, tokenizer_path, capacities.tokens, end_id), capacities)


def op10_best_fit(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens.

    Null and empty texts are one piece of one token. Repeated rows and rows with a null id are
    packed like any other. An empty table gives no rows; only doc_id and text are read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path).withColumnRenamed("id", "doc_id")
